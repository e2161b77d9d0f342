"""Impact-ordered search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm.ranked_search import nra, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(0x41, 0x5B)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs, items, k=20, k1=12, b=25):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_all, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in wanted.items():
        scored = []
        for d, c in counts:
            m = 100 - b + (b * sum(c.values()) * n_all) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + k1 * m))
                for t, times in query.items() if t in c)
            if score > 0:
                scored.append((-score, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def found(docs, items, **more):
    return sorted(str(tuple(r)) for r in search(docs, items, **more).collect())


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_nra_equals_full_scores(data):
    n = data.draw(st.integers(1, 40))
    k = data.draw(st.integers(1, 8))
    floor = data.draw(st.integers(1, 30))
    lists, scores = [], np.zeros(n, np.int64)
    for _ in range(data.draw(st.integers(1, 6))):
        docs = np.array(data.draw(st.lists(st.integers(0, n - 1), min_size=1, unique=True)))
        gains = np.array(data.draw(st.lists(
            st.integers(1, 9), min_size=len(docs), max_size=len(docs))), np.int64)
        order = np.lexsort((docs, -gains))
        lists.append((docs[order], gains[order]))
        scores[docs] += gains
    got, values, _ = nra(lists, n, k, floor, first_read=data.draw(st.integers(1, 5)))
    want = sorted((-s, d) for d, s in enumerate(scores.tolist()) if s >= floor)[:k]
    assert list(zip((-values).tolist(), got.tolist())) == want


def test_lists_are_not_read_to_their_ends():
    n = 50_000
    docs = np.arange(n)
    rare = (np.array([7, 9, 11]), np.array([900, 900, 800], np.int64))
    common = (docs, np.sort(np.full(n, 5, np.int64))[::-1])
    top, scores, reads = nra([rare, common], n, 2, 1)
    assert reads < 100  # 7 and 9 were met in both lists, nothing else can pass them
    assert top.tolist() == [7, 9] and scores.tolist() == [905, 905]


def test_edges(spark):
    word = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "Alpha beta beta É"), (5, "alpha"), (5, "alpha"),
            (6, "ALPHA, alpha; gamma"), (None, "alpha"), (7, word + " alpha"), (8, "delta é_É")]
    rows += [(100 + i, "gamma gamma beta") for i in range(60)]
    items = [(1, "alpha Beta alpha"), (2, None), (None, "gamma"), (3, "zzz"), (1, "delta"),
             (4, word), (5, "é")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "doc_id long, text string, score string, rank int")
    queries = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, n int")
    want = ranked(rows, items)
    assert found(docs, queries) == want and len(want) > 40
    assert found(docs.repartition(7), queries, block_terms=3) == want
    assert found(docs, queries, k=3, k1_tenths=9, b_percent=60) == ranked(rows, items, 3, 9, 60)
    none, blank = docs.where(F.lit(False)), docs.where("doc_id < 4")
    assert found(none, queries) == found(blank, queries) == found(docs, queries.limit(0)) == []


def test_text_ids(spark):
    rows = [(f"d{i}", "x y" if i % 3 else "x") for i in range(50)]
    items = [("q", "y x")]
    got = found(spark.createDataFrame(rows, "doc_id string, text string"),
                spark.createDataFrame(items, "item_id string, text string"))
    assert got == ranked(rows, items)
