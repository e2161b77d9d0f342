"""The neighbour-graph map: weights against plain Python, and how well it keeps neighbours."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmill.operators.layout import A, B, bandwidths, fuzzy_edges, neighbour_layout, pulls, tiles
from quillmill.operators.neighbours import neighbour_lists


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "id long, vector array<double>").repartition(parts)


def trustworthiness(high, low, k):
    """1 less what is near in the map but not before, by rank, scaled to 0 .. 1."""
    n, lost = len(high), 0
    for i in range(n):
        rank = np.argsort(np.argsort(((high - high[i]) ** 2).sum(1)))
        near = np.argsort(((low - low[i]) ** 2).sum(1))[1:k + 1]
        lost += np.maximum(rank[near] - k, 0).sum()
    return 1 - lost * 2 / (n * k * (2 * n - 3 * k - 1))


def test_weights(spark):
    rng = np.random.default_rng(3)
    points = frame(spark, rng.normal(size=(60, 3)))
    lists = neighbour_lists(points, 6)
    rows = {r["id"]: r["list"] for r in lists.collect()}
    got = {}
    for r in bandwidths(lists).collect():
        got.setdefault(r["id"], []).append((r["d"], r["n"], r["weight"]))
    for i, found in got.items():
        assert [(d, n) for d, n, _ in sorted(found)] == [(x["d"], x["n"]) for x in rows[i]]
        assert max(w for _, _, w in found) == 1.0
        assert abs(sum(w for _, _, w in found) - math.log2(6)) < 1e-6
    given = {(i, n): w for i, found in got.items() for _, n, w in found}
    for r in fuzzy_edges(lists).collect():
        u, v = given.get((r["a"], r["b"]), 0), given.get((r["b"], r["a"]), 0)
        assert r["a"] < r["b"] and abs(r["weight"] - (u + v - u * v)) < 1e-12


def test_map_keeps_neighbours_and_parts_crowds(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 20))
    vectors = centres[np.arange(240) % 6] + rng.normal(0, 0.15, (240, 20))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    got = {r["id"]: (r["x"], r["y"]) for r in
           neighbour_layout(frame(spark, vectors), "id", "vector", rounds=20).collect()}
    flat = np.array([got[i] for i in range(240)])
    assert trustworthiness(unit, flat, 10) > 0.93
    same = sum(np.argsort(((flat - p) ** 2).sum(1))[1] % 6 == i % 6 for i, p in enumerate(flat))
    assert same >= 235
    again = neighbour_layout(frame(spark, vectors, 5), "id", "vector", rounds=20).collect()
    assert all(abs(r["x"] - got[r["id"]][0]) < 1e-3 for r in again)


def test_edges(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {r["id"]: r["x"] for r in neighbour_layout(df, "id", "vector", rounds=2).collect()}
    assert len(got) == 6 and got[1] is None and got[2] is None and got[5] is not None
    assert neighbour_layout(df.where("id < 4"), "id", "vector").where("x IS NOT NULL").count() == 0
    assert neighbour_layout(df.where(F.lit(False)), "id", "vector").count() == 0


def test_rounds_send_positions_not_links(spark):
    rng = np.random.default_rng(4)
    n, k = 3000, 40
    rows = [(i, int(b), float(w)) for i in range(n)
            for b, w in zip(rng.choice(n, k, replace=False), rng.random(k) + 0.1) if b != i]
    rows += [(0, b, 0.5) for b in range(1, n)]  # a point that nearly all are linked with
    links = spark.createDataFrame(rows, "a long, b long, weight double").dropDuplicates(["a", "b"])
    stored, cells = tiles(links, n)
    got = [(r["a"], b) for r in stored.collect() for b in r["b"]]
    assert sorted(got) == sorted((r["a"], r["b"]) for r in links.collect())
    ids = {r["id"]: r["cells"] for r in cells.collect()}
    for r in stored.collect():
        assert all(r["g"] in ids[i] for i in [r["a"], *r["b"]])
    # One position per tile and point, where every link had one at each end.
    assert sum(map(len, ids.values())) < links.count() / 5


def test_pulls_of_a_tile(spark):
    rng = np.random.default_rng(6)
    at = rng.normal(size=(50, 2))
    at[1] = at[0]  # no pull between points of one place
    tile = pd.DataFrame({"g": 0, "a": [3, 0], "b": [np.array([4, 5, 9]), np.array([1, 7])],
                         "weight": [np.array([1.0, 0.5, 0.1]), np.array([0.3, 0.2])]})
    seen = pd.DataFrame({"id": np.arange(50), "x": at[:, 0], "y": at[:, 1]}).sample(frac=1, random_state=1)
    got = pulls(tile, seen).set_index("id")
    for a, to, weights in tile[["a", "b", "weight"]].itertuples(index=False):
        total = np.zeros(2)
        for b, w in zip(to, weights):
            gap = at[a] - at[b]
            square = float(gap @ gap)
            if square > 0:
                total += w * np.clip(-2 * A * B * square ** (B - 1) / (1 + A * square ** B) * gap, -4, 4)
        assert np.allclose(got.loc[a, ["ax", "ay"]].to_numpy(float), total)
        assert abs(got.loc[a, "weight"] - sum(weights)) < 1e-12
