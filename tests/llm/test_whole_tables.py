"""Every registered query of the subpackage against a plain version on the smallest tables."""

import os

import duckdb
import pytest

from checks.compare import connect, difference
from quillmill.llm.linkgraph import RULES
from quillmill.llm.queries import QUERIES, SQL
from tests.llm import brute

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def rows(table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    return rows("documents", "doc_id, text")


def collected(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None


def test_warc(spark):
    want = brute.warc(rows("pages", "page_id, html"))
    got = collected(spark, "op1_warc_dictionary")
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)


def test_pii_base(spark, documents):
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])
           for r in collected(spark, "op4_pii_disclosure")}
    assert got == {d: brute.pii_digest(t) for d, t in documents}


def test_shards(spark, documents):
    got = collected(spark, "op5_shard_prefix_sums")
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got} == (
        brute.shards(documents, 40)
    )


def test_quality(spark, documents):
    got = {r["doc_id"]: tuple(r)[1:7] for r in collected(spark, "op6_rule_cascade")}
    assert got == {d: brute.quality(t) for d, t in documents}


def test_near_duplicates(spark, documents):
    got = collected(spark, "op7_probminhash")
    want = brute.classes(documents)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


def test_pseudo_likelihood(spark, documents):
    got = {r["doc_id"]: r for r in collected(spark, "op8_pseudo_likelihood")}
    assert len(got) == len(documents)
    for d, t in documents:
        assert got[d]["n_tokens"] == len(brute.WORD.findall(t or ""))


def test_contamination(spark, documents):
    items = rows("benchmark", "item_id, text")
    got = {r["doc_id"]: tuple(r)[1:6] for r in collected(spark, "op9_decontaminate")}
    assert got == {d: brute.contamination(t, items) for d, t in documents}


def test_urls(spark):
    got = {r["page_id"]: r for r in collected(spark, "op10_link_graph")}
    pages = rows("pages", "page_id, url")
    assert len(got) == len(pages)
    for page, url in pages:
        row, best = got[page], brute.rule(url, RULES)
        assert (row["host"], row["path"]) == brute.host_path(url)
        assert row["rule"] == (best and best[1])
        assert row["verdict"] == best[0] if best else row["verdict"] in ("allow", "block")
