"""The five stages against plain versions, with rows that are missing, empty, repeated or collide."""

import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quillmill.llm.queries import SQL
from quillmill.session import materialize, scratch_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows(texts):
    clean = next(t for t in texts if t and not brute.quality(t)[5] and 60 < len(t.split()) < 300)
    words = clean.split()
    own = [f"{w}{i}" for i, w in enumerate(words)]
    return [
        (90_001, None, "en", "odd"), (90_002, "", "en", "odd"), (90_003, " \n\t", None, None),
        (90_004, " ".join(own), "en", None), (90_004, " ".join(own), "en", None),  # repeated row
        (90_005, " ".join(reversed(own)), "en", "odd"), (90_005, " ".join(own[::2] + own[1::2]), "de", "odd"),
        (None, " ".join(f"lone{i} {w}" for i, w in enumerate(words)), "en", "odd"),
        (90_006, " ".join([*own[:-1], "else"]), "en", "odd"),  # near copy of 90,004
        (90_007, "short text", "en", "odd"), (90_008, "# " * 400 + clean, "en", "odd"),
        (90_009, " ".join(f"long{i % 9973}x{i}" for i in range(30_000)), "en", "odd"),
    ]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after every stage, as the pipeline makes them."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    rows = [(*r, len(r[1] or "")) for r in [*rows, *edge_rows([r[1] for r in rows])]]
    sf_dir = scratch_path(spark, "pipeline-tables")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf_dir}/benchmark.parquet")
    out, docs = [rows], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if i < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        out.append([tuple(r) for r in docs.collect()])
    out.append((sf_dir, docs.columns))
    return out


def key(rows):
    return Counter((r[0], r[1], r[2], r[3]) for r in rows)


def passes(text):
    n, chars, symbols, dup, _, failed = brute.quality(text)
    words = brute.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    return not (failed or 10 * symbols > n or 2 * dup > len(lines)
                or not 2 * n <= chars <= 15 * n or 10 * stutter > 3 * n)


def test_quality(stages):
    assert key(stages[1]) == key([r for r in stages[0] if passes(r[1])])
    assert {r[0] for r in stages[1]} >= {90_004, 90_005, 90_009, None}


def test_near_duplicates(stages):
    rows = sorted(stages[1], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    classes = brute.classes([(i, r[1]) for i, r in enumerate(rows)])
    want = [r for i, r in enumerate(rows) if classes[i] == i]
    assert Counter(r[0] for r in stages[2]) == Counter(r[0] for r in want)
    assert Counter(r[0] for r in stages[2])[90_004] == 1 and 90_006 not in {r[0] for r in stages[2]}
    assert not key(stages[2]) - key(stages[1])


def test_decontamination(stages):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert key(stages[3]) == key([r for r in stages[2] if not brute.contamination(r[1], items)[-1]])


def test_mixing(stages):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", stages[3])
    want = con.execute(SQL["op2_temperature_mix"])
    names = [c[0] for c in want.description]
    drawn = Counter((r[names.index("doc_id")], r[names.index("source")]) for r in want.fetchall())
    assert Counter((r[0], r[3]) for r in stages[4]) == drawn
    assert set(key(stages[4])) == set(key(stages[3]))  # every document at least once


def test_sharding(spark, stages):
    rows = [(r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16) for r in stages[4]]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, want, slots = sum(r[2] for r in rows), 0, [], Counter()
    for r in rows:
        shard = min(39, (2 * before + r[2]) * 40 // (2 * total))
        want.append((*r, shard, slots[shard]))
        slots[shard] += 1
        before += r[2]
    columns = stages[6][1]
    at = [columns.index(c) for c in ("doc_id", "text_crc32", "size", "shard", "slot")]
    assert Counter(tuple(r[i] for i in at) for r in stages[5]) == Counter(want)
    whole = corpus_pipeline.run(spark, stages[6][0])
    assert Counter(map(tuple, whole.collect())) == Counter(stages[5])
