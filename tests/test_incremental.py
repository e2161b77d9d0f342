"""Batches against a stored index, components of near-duplicates, splits that keep them whole."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import dedup, dedup_index
from quillmill.operators.sampling import leak_free_split
from quillmill.session import scratch_path
from quillmill.sources.versions import Versions, hadoop_file

SCHEMA = "id long, stratum string, text string"


def texts(n, seed=3):
    """Families of near-copies: a base of 40 words with up to six of them exchanged."""
    draw = random.Random(seed)
    bases = [[f"w{draw.randrange(400)}" for _ in range(40)] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(draw.choice(bases))
        for _ in range(draw.randrange(7)):
            words[draw.randrange(40)] = f"x{draw.randrange(60)}"
        out.append((i, None if i % 31 == 0 else "ab"[i % 2], " ".join(words)))
    return out + [(n, "a", ""), (n + 1, "a", None), (n + 2, "b", out[1][2])]


def similar(a, b, threshold=0.85):
    if a[1] != b[1]:
        return False
    x, y = set((a[2] or "").split()), set((b[2] or "").split())
    return x == y or (bool(x | y) and len(x & y) >= threshold * len(x | y))


def greedy(rows):
    kept = []
    for r in rows:
        if not any(similar(k, r) for k in kept):
            kept.append(r)
    return [k[0] for k in kept]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def add(path, df):
    kept = dedup_index.append_batch(path, df, "id", "stratum", "text")
    return sorted(r["id"] for r in kept.collect())


@pytest.fixture(scope="module")
def rows():
    return texts(240)


def test_batches_keep_what_one_pass_keeps(spark, rows):
    path = scratch_path(spark, "index")
    got = []
    for a, b in ((0, 100), (100, 101), (101, 200), (200, 200), (200, len(rows))):
        got += add(path, frame(spark, rows[a:b]))
    assert sorted(got) == greedy(rows)
    assert add(path, frame(spark, rows)) == []  # everything resembles what is there


def test_the_old_corpus_is_not_read_again(spark, rows):
    path, first = scratch_path(spark, "index"), scratch_path(spark, "corpus")
    frame(spark, rows[:120]).write.parquet(first)
    got = add(path, spark.read.schema(SCHEMA).parquet(first))
    spark.range(1).write.mode("overwrite").parquet(first)  # the old texts are gone
    assert sorted(got + add(path, frame(spark, rows[120:]))) == greedy(rows)


def test_rows_against_the_index(spark, rows):
    path = scratch_path(spark, "index")
    kept = add(path, frame(spark, rows[:150]))
    by_id = {r[0]: r for r in rows}
    want = {}
    for r in rows[150:]:
        like = [k for k in kept if similar(by_id[k], r)]
        if like:
            want[r[0]] = min(like)
    got = dedup_index.resembled(path, frame(spark, rows[150:]), "id", "stratum", "text").collect()
    assert {r["id"]: r["kept_id"] for r in got} == want and len(got) == len(want) > 10
    none = dedup_index.resembled(scratch_path(spark, "none"), frame(spark, rows), "id", "stratum", "text")
    assert none.count() == 0


def test_of_two_writers_one_wins_and_the_other_checks_again(spark, rows, monkeypatch):
    path = scratch_path(spark, "index")
    add(path, frame(spark, rows[:50]))
    inner, calls = dedup_index.check_batch, []

    def slow(index, versions, batch, *more, **named):
        out = inner(index, versions, batch, *more, **named)
        calls.append(len(versions))
        if len(calls) == 1:  # meanwhile another batch is added
            monkeypatch.setattr(dedup_index, "check_batch", inner)
            add(path, frame(spark, rows[50:120]))
            monkeypatch.setattr(dedup_index, "check_batch", slow)
        return out

    monkeypatch.setattr(dedup_index, "check_batch", slow)
    add(path, frame(spark, rows[120:]))
    assert calls == [1, 2]
    got = sorted(r["id"] for r in dedup_index.kept_rows(spark, path).collect())
    assert got == greedy(rows)


def test_unfinished_batches(spark, rows):
    path = scratch_path(spark, "index")
    add(path, frame(spark, rows[:60]))
    frame(spark, rows).write.parquet(f"{path}/data/left-behind/sets")  # no version names it
    got = add(path, frame(spark, rows[60:]))
    assert got == [i for i in greedy(rows) if i >= 60]
    fs, file = hadoop_file(spark, f"{path}/versions/00000002")
    fs.create(file, False).close()
    with pytest.raises(RuntimeError):
        Versions(spark, path).names()


def test_components(spark, rows):
    got = {r["id"]: r["component"] for r in
           dedup.similar_components(frame(spark, rows), "id", "stratum", "text", per_block=2).collect()}
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if similar(a, b):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}
    assert len(set(got.values())) < len(greedy(rows))  # chains


def test_crowds_close_after_few_comparisons(spark, monkeypatch):
    seen = []
    inner = dedup._verified

    def counting(pairs, payload, threshold):
        seen[-1] += pairs.count()
        return inner(pairs, payload, threshold)

    monkeypatch.setattr(dedup, "_verified", counting)
    for n in (100, 400):
        seen.append(0)
        rows = [(i, "a", " ".join([f"w{j}" for j in range(60)] + [f"own{i}"])) for i in range(n)]
        got = dedup.similar_components(frame(spark, rows), "id", "stratum", "text").collect()
        assert {r["component"] for r in got} == {0}
    assert seen[1] <= 4.5 * seen[0]


def test_links_of_a_block_of_unlike_kept_rows(spark, monkeypatch):
    """Near-copies of many unlike rows that all meet in one block leave it when found."""
    compared = []
    inner = dedup._similar

    def counting(pairs, threshold):
        compared[-1] += pairs.count()
        return inner(pairs, threshold)

    monkeypatch.setattr(dedup, "_similar", counting)
    n = 300
    heads = spark.range(n).selectExpr("id", "40 size", "7L block")
    rows = spark.range(n).selectExpr("id + 1000 id", "40 size", "7L block")
    value = lambda shift: F.struct(F.lit("a").alias("stratum"), F.array(*[
        F.concat(F.lit(f"w{j}x"), (F.col("id") - shift) % 4) for j in range(20)]).alias("tokens"))
    compared.append(0)
    got = dedup.links_to_kept(
        rows, rows.select("id", value(1000).alias("value")),
        heads, heads.select("id", value(0).alias("value")), 0.85, per_block=8).collect()
    assert {r["member"] - 1000: r["head"] for r in got} == {i: i % 4 for i in range(n)}
    assert compared[0] <= 8 * n


def test_leak_free_split(spark, rows):
    comps = dedup.similar_components(frame(spark, rows), "id", "stratum", "text")
    df = frame(spark, rows).join(comps, "id").withColumnRenamed("text", "size")
    got = leak_free_split(df, "id", "stratum", "component").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {
        "id", "stratum", "size", "component", "split"}
    homes = {}
    for r in got:
        homes.setdefault(r["component"], set()).add(r["split"])
    assert all(len(h) == 1 for h in homes.values())
    sizes = {c: sum(r["component"] == c for r in got) for c in homes}
    for s in {r["stratum"] for r in got}:
        mine = [r for r in got if r["stratum"] == s]
        for split, share in (("test", 0.15), ("val", 0.1)):
            quota = max(1, int(len(mine) * share))
            held = [r for r in mine if r["split"] == split]
            small = [sizes[r["component"]] for r in mine if sizes[r["component"]] <= quota]
            assert len(held) < quota + max(small, default=1)
            assert len(held) >= quota or len(small) < len(mine)
    again = leak_free_split(df.repartition(7), "id", "stratum", "component").collect()
    assert {(r["id"], r["split"]) for r in again} == {(r["id"], r["split"]) for r in got}
    alone = leak_free_split(df.withColumn("component", F.lit(None).cast("long")), "id", "stratum",
                            "component").groupBy("split").count().collect()
    assert {r["split"] for r in alone} == {"train", "val", "test"}
    assert leak_free_split(df.where(F.lit(False)), "id", "stratum", "component").count() == 0
