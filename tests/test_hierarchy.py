"""Neighbour lists, spanning tree and stable clusters against plain Python."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import hierarchy, neighbours
from quillmill.operators.neighbours import neighbour_lists
from quillmill.plans.failures import failure_map


def frame(spark, vectors, ids=None, parts=3):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(parts)


def crowds(n, seed=5, dims=4, centres=6, spread=0.05):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dims))
    wide = spread * (1 + np.arange(n) % centres)[:, None]
    out = at[np.arange(n) % centres] + rng.normal(size=(n, dims)) * wide
    out[::17] = rng.normal(size=(len(out[::17]), dims)) * 2
    return out


def plain_tree(vectors, ids, min_samples=1):
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, 1)[:, min(min_samples, len(ids) - 1) - 1]
    d = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((d[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]))
                   for i in range(len(ids)) for j in range(i))
    return kruskal(edges, ids)


def kruskal(edges, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    out = []
    for w, a, b in edges:
        if find(a) != find(b):
            up[find(a)] = find(b)
            out.append((w, a, b))
    return out


def plain_clusters(tree, ids, min_size):
    """Top-down over sets of points: {id: chosen cluster's smallest id or -1}."""
    least = min([w for w, _, _ in tree if w > 0], default=1.0)
    tree = sorted(tree)
    parent, members = {i: ("p", i) for i in ids}, {("p", i): {i} for i in ids}
    child = {}
    for rank, (w, a, b) in enumerate(tree):
        x, y = parent[a], parent[b]
        node = ("m", rank)
        members[node] = members[x] | members[y]
        child[node] = (1 / max(w, least), x, y)
        for i in members[node]:
            parent[i] = node
    found = []

    def walk(node, birth):
        """(stability, chosen sets) of the cluster that begins at ``node``."""
        stability, now = 0.0, node
        while True:
            if now not in child:
                return stability, [], members[node]
            dense, x, y = child[now]
            big = [c for c in (x, y) if len(members[c]) >= min_size]
            if len(big) == 2:
                stability += len(members[now]) * (dense - birth)
                parts = [walk(c, dense) for c in big]
                below = sum(max(s, sum(v for v, _ in chosen)) if chosen else s for s, chosen, _ in parts)
                best = []
                for s, chosen, points in parts:
                    under = sum(v for v, _ in chosen)
                    best += [(s, points)] if s >= under else chosen
                return stability, best, members[node]
            for c in (x, y):
                if len(members[c]) < min_size:
                    stability += len(members[c]) * (dense - birth)
            if not big:
                return stability, [], members[node]
            now = big[0]

    top = ("m", len(tree) - 1)
    _, best, _ = walk(top, 0.0)
    labels = dict.fromkeys(ids, -1)
    for _, points in best:
        for i in points:
            labels[i] = min(points)
    return labels


def tree_of(spark, vectors, **more):
    return sorted((r["w"], r["a"], r["b"])
                  for r in hierarchy.spanning_tree(frame(spark, vectors), **more).collect())


def labels(spark, vectors, ids=None, **more):
    got = hierarchy.hierarchical_clusters(frame(spark, vectors, ids), "id", "vector", **more)
    return {r["id"]: r["cluster_id"] for r in got.collect()}


def test_lists_are_exact_in_one_block(spark):
    vectors = crowds(200)
    got = {r["id"]: [(x["d"], x["n"]) for x in r["list"]]
           for r in neighbour_lists(frame(spark, vectors), k=7).collect()}
    for i in range(200):
        d = np.sqrt(((vectors[i] - vectors) ** 2).sum(1))
        assert got[i] == sorted((d[j], j) for j in range(200) if j != i)[:7]


def test_lists_of_many_blocks(spark):
    rng = np.random.default_rng(2)
    for vectors, least in ((crowds(1500, dims=16), 0.97), (rng.normal(size=(1500, 24)), 0.9)):
        got = {r["id"]: {x["n"] for x in r["list"]}
               for r in neighbour_lists(frame(spark, vectors), k=10, leaf=128).collect()}
        hits = 0
        for i, v in enumerate(vectors):
            d = ((v - vectors) ** 2).sum(1)
            d[i] = np.inf
            hits += len(got[i] & set(np.argsort(d)[:10].tolist()))
        assert hits >= least * 15_000


def test_lists_do_not_depend_on_the_layout(spark):
    vectors = crowds(400, dims=8)
    a, b = (sorted((r["id"], str(r["list"])) for r in
                   neighbour_lists(frame(spark, vectors, parts=p), k=5, leaf=64).collect()) for p in (1, 5))
    assert a == b


@pytest.mark.parametrize("min_samples", [1, 4])
def test_tree_is_the_minimum_spanning_tree(spark, min_samples):
    vectors = crowds(150)
    want = plain_tree(vectors, list(range(150)), min_samples)
    got = tree_of(spark, vectors, min_samples=min_samples, k=4)
    assert np.allclose([w for w, _, _ in got], [w for w, _, _ in sorted(want)])
    if min_samples == 1:
        assert [e[1:] for e in got] == [e[1:] for e in sorted(want)]


def test_tree_of_many_blocks_spans_all_points(spark):
    vectors = crowds(900, dims=8)
    got = tree_of(spark, vectors, leaf=64)
    assert len(got) == 899 and len(kruskal(got, range(900))) == 899
    want = plain_tree(vectors, list(range(900)))
    assert sum(w for w, _, _ in got) <= 1.02 * sum(w for w, _, _ in want)


@pytest.mark.parametrize("chunk", [16, 1 << 18])
def test_clusters_equal_the_plain_hierarchy(spark, chunk):
    vectors = crowds(160)
    vectors[40:46] = vectors[40]  # copies
    tree = plain_tree(vectors, list(range(160)))
    for min_size in (12,) if chunk == 16 else (4, 12):
        want = plain_clusters(tree, list(range(160)), min_size)
        got = labels(spark, vectors, min_size=min_size, chunk=chunk)
        assert len(set(want.values())) > 2
        assert got == want


def test_no_radius_for_crowds_of_unlike_density(spark):
    rng = np.random.default_rng(1)
    tight, loose = rng.normal(0, 0.01, (60, 5)), rng.normal(4, 0.8, (60, 5))
    far = np.array([[50.0] * 5, [-50.0] * 5])
    got = labels(spark, np.concatenate([tight, loose, far]))
    assert {got[i] for i in range(60)} == {0}
    assert sum(got[i] == got[60] or got[i] == 60 for i in range(60, 120)) >= 55
    assert got[120] == got[121] == -1


def test_edges(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = hierarchy.hierarchical_clusters(df, "id", "vector").collect()
    assert sorted(map(tuple, got)) == [(i, -1) for i in range(1, 6)]
    none = df.where(F.lit(False))
    assert hierarchy.hierarchical_clusters(none, "id", "vector").count() == 0
    assert hierarchy.spanning_tree(none).count() == 0
    one = [(i, [0.0, float(i % 2)]) for i in range(40)]  # two vectors, many copies
    got = hierarchy.hierarchical_clusters(
        spark.createDataFrame(one, "id bigint, vector array<double>"), "id", "vector").collect()
    assert {r["id"]: r["cluster_id"] for r in got} == {i: i % 2 for i in range(40)}


def test_failure_map_without_a_radius(spark):
    rows = spark.createDataFrame(
        [(i, "A" if i < 6 else "B", "wrong [incomplete]", "right", 0.1 if i < 12 else 0.9)
         for i in range(20)],
        "sample_id long, clause_type string, prediction string, reference string, bertscore_f1 double",
    )
    vectors = spark.createDataFrame(
        [(i, [float(i < 5), float(i >= 5), 0.01 * i]) for i in range(20) if i != 11],
        "sample_id long, embedding array<double>",
    )
    points = {r.sample_id: r for r in failure_map(rows, vectors).collect()}
    assert sorted(points) == list(range(12))
    assert [points[i].cluster_id for i in range(12)] == [0] * 5 + [5] * 6 + [-1]


@pytest.mark.parametrize("cells", [1, 5])
def test_a_round_compares_each_pair_once_in_any_cells(spark, cells):
    rng = np.random.default_rng(7)
    n, k = 300, 6
    vectors = rng.normal(size=(n, 5))
    vectors[:150] = vectors[:150].astype(np.float32)  # both forms of a code
    away = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    state = {i: sorted((float(away[i, j]), int(j)) for j in rng.choice(n, k + 1, replace=False) if j != i)[:k]
             for i in range(n)}
    lists = neighbours._since(spark.createDataFrame(
        [(i, state[i]) for i in range(n)], "id long, list array<struct<d:double,n:long>>"), 0)
    codes, before = neighbours._codes(frame(spark, vectors)), None
    for turn in range(2):
        members = {i: {j for _, j in state[i]} for i in range(n)}
        for i in range(n):
            listing = sorted((away[i, j], j) for j in range(n) if i in {m for _, m in state[j]})[:k]
            members[i] |= {j for _, j in listing}
        met = {i: set() for i in range(n)}
        for group in members.values():
            for i in group:
                met[i] |= group - {i}
        state = {i: sorted(set(state[i]) | {(float(away[i, j]), j) for j in met[i]})[:k] for i in range(n)}
        lists, before = neighbours._descend(codes, lists, before, k, turn, cells)
        got = {r["id"]: [x["n"] for x in r["list"]] for r in lists.collect()}
        assert got == {i: [j for _, j in state[i]] for i in range(n)}
