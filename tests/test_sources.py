"""Array files in pieces, results by fingerprint, runs that own their files, scoring batches."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill import session
from quillmill.operators import scoring
from quillmill.plans import curation
from quillmill.session import materialize, run_scope, scratch_path
from quillmill.sources import io, json_arrays
from quillmill.sources.versions import Versions

SCHEMA = "id long, text string, parts array<struct<k: string, v: array<double>>>"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(n, seed=2):
    draw = random.Random(seed)
    alphabet = [",", '"', "\\", "[", "]", "{", "}", "é", "日", "\U0001f600", " ", "\n", "a", "\\\"", "],"]
    for i in range(n):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        yield {"id": i, "text": text, "parts": [
            {"k": ",".join("ab" * (i % 3)), "v": [0.5] * (i % 4)}, {"k": "[{", "v": []}][:i % 3]}


def read_both(spark, path):
    key = lambda df: sorted(str(r) for r in df.collect())
    return (key(json_arrays.read_arrays(spark, path, SCHEMA)),
            key(io.read_documents(spark, path, SCHEMA, whole_file=True)))


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (None, False), (2, False)])
def test_arrays_equal_whole_files(spark, small_splits, tmp_path, indent, ascii_only):
    for name, n in (("a", 300), ("b", 1), ("c", 0), ("d", 77)):
        with open(tmp_path / f"{name}.json", "w") as file:
            json.dump(list(rows(n, n)), file, indent=indent, ensure_ascii=ascii_only)
    (tmp_path / "blank.json").write_text("  \n")
    pieces = json_arrays.pieces(spark, str(tmp_path))
    assert pieces.select("file", "block").distinct().count() > 30  # one file, many tasks
    got, want = read_both(spark, str(tmp_path))
    assert len(want) == 378 and got == want


def test_write_and_read(spark, small_splits):
    path = scratch_path(spark, "arrays")
    df = spark.createDataFrame([json.dumps(r) for r in rows(200)], "string").select(
        F.from_json("value", SCHEMA).alias("r")).select("r.*").repartition(3)
    json_arrays.write_array(df, path)
    got, want = read_both(spark, path)
    assert got == want == sorted(str(r) for r in df.collect())
    json_arrays.write_array(df.limit(0), path + "-none")
    assert json_arrays.read_arrays(spark, path + "-none", SCHEMA).count() == 0


def test_results_by_fingerprint(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    calls = []

    def compute():
        calls.append(1)
        return spark.read.parquet(source).selectExpr(f"id + {len(calls)} AS id")

    def ids(parameters, schema="id long"):
        got = io.reuse_result(spark, path, [source], parameters, schema, compute)
        return sorted(r["id"] for r in got.collect())

    assert ids({"k": 1}) == ids({"k": 1}) == [1, 2, 3, 4, 5] and len(calls) == 1
    assert ids({"k": 2}) == [2, 3, 4, 5, 6]  # another parameter
    spark.range(7).write.mode("overwrite").parquet(source)
    assert len(ids({"k": 1})) == 7 and len(calls) == 3  # changed input
    spark.range(1).write.parquet(f"{path}/_writing-crashed")
    assert len(ids({"k": 1})) == 7 and len(calls) == 3


def test_two_writers_of_one_result(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)

    def get(compute):
        return io.reuse_result(spark, path, [source], {}, "id long", compute)

    def late():  # while this one computes, another finishes
        assert get(lambda: spark.range(3)).count() == 3
        return spark.range(9)

    assert get(late).count() == 3
    assert not [f for f in os.listdir(path) if f.startswith("_writing")]


def records(spark, n=40):
    text = lambda i: " ".join(f"w{(i * 7 + j) % 97}" for j in range(60 + i))
    return spark.createDataFrame(
        [(i, text(i), 'About "Audit Rights"' if i % 2 else 'About "Governing Law"', ([f"answer {i}\nmore"],))
         for i in range(n)], io.QA_SCHEMA)


def test_a_run_owns_its_files(spark, tmp_path):
    path, before = str(tmp_path / "out"), set(os.listdir(session.shared_dir(spark) + "/quillmill"))
    folder = curation.publish_curation(records(spark), path, "d")
    assert set(os.listdir(session.shared_dir(spark) + "/quillmill")) == before
    out = Versions(spark, path)
    assert out.names() == [folder]
    whole = curation.curate(records(spark))
    for split in io.SPLITS:
        got = sorted(r["sample_id"] for r in out.read(split).collect())
        assert got == sorted(r["sample_id"] for r in whole.where(F.col("split") == split).collect())
    card = out.read("card").first()
    assert card["splits"]["total"] == whole.count() and card["dataset"] == "d"


def test_a_failing_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    first = curation.publish_curation(records(spark), path, "d")
    before = set(os.listdir(session.shared_dir(spark) + "/quillmill"))
    bad = lambda rows, name: rows.select(F.raise_error(F.lit("no card")).alias("x"))
    monkeypatch.setattr(curation, "dataset_card", bad)
    with pytest.raises(Exception, match="no card"):
        curation.publish_curation(records(spark), path, "d")
    assert Versions(spark, path).names() == [first] and os.listdir(f"{path}/data") == [first]
    assert set(os.listdir(session.shared_dir(spark) + "/quillmill")) == before
    monkeypatch.undo()
    second = curation.publish_curation(records(spark, 60), path, "d")
    assert Versions(spark, path).names() == [first, second]
    with pytest.raises(FileNotFoundError):
        Versions(spark, path + "x").read("train")


def test_runs_inside_runs_share_files(spark):
    with run_scope(spark) as outer:
        with run_scope(spark) as inner:
            kept = materialize(spark.range(3), "x")
        assert inner == outer and kept.count() == 3 and outer in scratch_path(spark, "y")
    assert outer not in scratch_path(spark, "z")


def test_batches_of_like_length():
    draw = random.Random(1)
    texts = ["x" * draw.choice([1, 3, 10, 100, 1000]) for _ in range(5000)]
    frames = [pd.DataFrame({"a": texts[i:i + 700], "b": None}) for i in range(0, 5000, 700)]

    def padding(parts):
        longest = sum(len(p) * p["a"].str.len().max() for p in parts)
        return 1 - sum(p["a"].str.len().sum() for p in parts) / longest

    plain = [f.iloc[i:i + 32] for f in frames for i in range(0, len(f), 32)]
    got = list(scoring.by_length(iter(frames), ["a", "b"], 32))
    assert sorted(x for p in got for x in p["a"]) == sorted(texts)
    assert all(len(p) <= 32 for p in got) and padding(got) < 0.05 < 0.5 < padding(plain)
    tight = list(scoring.by_length(iter(frames), ["a", "b"], 32, buffer_rows=100, buffer_chars=5000))
    assert sorted(x for p in tight for x in p["a"]) == sorted(texts)
    assert all(p["a"].str.len().sum() <= 5000 for p in tight)  # what is held never exceeds the buffer


def test_scores_do_not_depend_on_the_batches(spark):
    df = spark.createDataFrame(
        [(i, "a b c " * (i % 9), None if i % 11 == 0 else "a c " * (i % 5)) for i in range(300)],
        "id long, p string, r string")
    plain, bucketed = (sorted(map(tuple, scoring.score_pairs(
        df, scoring.load_token_f1, ["id"], "p", "r", "x double, y double, z double", batch_rows=n
    ).collect())) for n in (None, 7))
    assert plain == bucketed and len(plain) == 300
