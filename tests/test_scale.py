"""Building blocks for hot keys, ranks, percentiles and components."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions.draws import draw_key, number, draw
from quillmill.operators import clustering, scale
from quillmill.operators.graph import component_roots
from quillmill.session import SWEEP, materialize


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_a_plain_join(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    right = right.unionByName(spark.range(1).select(F.lit(7).alias("k"), F.lit(70).alias("v")))
    salted = scale.salted_join(left, right, ["k"], ["id"], how, max_keys=10, min_rows=1)
    plain = left.join(right, ["k"], how)
    assert sorted(map(str, salted.select(plain.columns).collect())) == sorted(
        map(str, plain.collect())
    )


@pytest.mark.parametrize("side", ["left", "right"])
def test_salted_join_leaves_a_column_salts_alone(spark, side):
    left = spark.range(300).select("id", F.lit(7).alias("k"))
    right = spark.range(7, 8).select(F.col("id").alias("k"))
    if side == "left":
        left = left.withColumn("salts", F.col("id") % 3)
    else:
        right = right.withColumn("salts", F.lit(2).cast("long"))
    salted = scale.salted_join(left, right, ["k"], ["id"], max_keys=10, min_rows=1)
    assert "_salts" in salted._jdf.queryExecution().analyzed().toString()  # k is hot
    plain = left.join(right, ["k"])
    assert sorted(map(tuple, salted.select(plain.columns).collect())) == sorted(
        map(tuple, plain.collect())
    )


def test_heavy_keys_are_few_and_salted_by_share(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 400, F.lit(-1)).otherwise(F.col("id")).alias("k")
    )
    hot = scale.heavy_keys(df, ["k"], 1000, max_keys=10, min_rows=1).collect()
    assert [(r.k, r.salts) for r in hot] == [(-1, 4)]


def test_dense_index_numbers_every_group(spark):
    df = spark.range(500).select(
        (F.col("id") % 3 == 0).alias("g"), draw_key(1, "x", F.col("id")).alias("key")
    )
    rows = scale.dense_index(df, ["g"], "key", "i").collect()
    for g in (True, False):
        mine = sorted((r.key, r.i, r.n) for r in rows if r.g is g)
        assert [i for _, i, _ in mine] == list(range(len(mine)))
        assert {n for _, _, n in mine} == {len(mine)}


@pytest.mark.parametrize("values", [
    [5], [1, 2], list(range(100)), [7] * 50 + [1, 900], [0, 0, 10**13, 3, 10**9],
])
def test_percentiles_are_those_of_numpy(spark, values):
    df = spark.createDataFrame([(int(v),) for v in values], "v bigint")
    percents = {"a": 5.0, "b": 50.0, "c": 95.0, "d": 100.0, "e": 0.0}
    got = scale.exact_percentiles(df, "v", percents).first()
    for name, p in percents.items():
        assert got[name] == pytest.approx(np.percentile(values, p), rel=1e-12)


def test_percentiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([], "v bigint")
    assert scale.exact_percentiles(df, "v", {"a": 50.0}).first().a is None


def test_draws_agree_between_driver_and_columns(spark):
    got = [r[0] for r in spark.range(20).orderBy("id").select(draw(3, "s", F.col("id"))).collect()]
    assert got == [number(3, "s", i) for i in range(20)]


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)],
    [(100, i) for i in range(30)],
    [(1, 2), (3, 4), (4, 5), (2, 9), (7, 7)],
    [((i * 17) % 101, (i * 31 + 5) % 101) for i in range(60)],
])
def test_components(spark, edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.node: r.root for r in component_roots(df).collect()} == want


def clusters(spark, vectors, eps, **more):
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<float>"
    )
    got = clustering.density_clusters(df, "id", "v", eps, **more).collect()
    return [r.cluster_id for r in sorted(got)]


def test_two_tight_groups_and_noise(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.normal(c, 0.05, (5, 4)) for c in (0.0, 5.0))
    far = [[50.0] * 4, [-50.0] * 4]
    assert clusters(spark, [*a, *b, *far], 1.0) == [0] * 5 + [5] * 5 + [-1, -1]


def test_clusters_equal_single_linkage(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.round(rng.uniform(0, 6, (120, 3)), 2)
    points[100:] = points[0]  # copies
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vectors = points.astype(np.float32).astype(float)
    for i in range(120):
        for j in range(i):
            if np.sqrt(((vectors[i] - vectors[j]) ** 2).sum()) <= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(120)]
    want = [r if roots.count(r) >= 3 else -1 for r in roots]
    monkeypatch.setattr(clustering.neighbour_components, "__defaults__", (3, 2, 256))
    assert clusters(spark, points, 0.8, min_size=3) == want


def crowded(n, seed=7):
    """Unit vectors of 64 dimensions in ten tight crowds, and a lone one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 64))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = centres[np.arange(n) % 10] + rng.normal(0, 0.01, (n, 64))
    rows[-1] = -centres.sum(0)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_comparisons_of_crowds_grow_with_the_rows(spark, monkeypatch):
    compared = []
    inner = clustering._links

    def counting(active, leaders, points, eps):
        most = active.groupBy("block").count().join(
            leaders.groupBy("block").agg(F.count("*").alias("heads")), "block"
        )
        compared[-1] += most.agg(F.sum(F.col("count") * F.col("heads"))).first()[0]
        return inner(active, leaders, points, eps)

    monkeypatch.setattr(clustering, "_links", counting)
    for n in (500, 2000):
        compared.append(0)
        got = clusters(spark, crowded(n), 0.3, min_size=3)
        assert got == [i % 10 for i in range(n - 1)] + [-1]
    assert compared[1] <= 4.5 * compared[0]


@pytest.mark.parametrize("pivots", [1, 40])
def test_pivot_cells_lose_no_link(spark, monkeypatch, pivots):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 6))
    vectors = points.astype(np.float32).astype(float)
    near = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2)) <= 1.0
    want = np.arange(300)
    while True:
        lower = np.array([want[near[i]].min() for i in range(300)])
        if (lower == want).all():
            break
        want = lower
    sizes = np.bincount(want, minlength=300)
    monkeypatch.setattr(clustering, "CHUNK", 50)
    monkeypatch.setattr(clustering.neighbour_components, "__defaults__", (0, 3, pivots))
    assert clusters(spark, points, 1.0, min_size=2) == [r if sizes[r] > 1 else -1 for r in want]


@pytest.mark.parametrize("eps", [0.9, 1.15, 1.3])  # few links, one large component, one in all
def test_points_that_cells_do_not_part_are_compared_in_tiles(spark, monkeypatch, eps):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    vectors = points.astype(np.float32).astype(float)
    near = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2)) <= eps
    want = np.arange(400)
    while True:
        lower = np.array([want[near[i]].min() for i in range(400)])
        if (lower == want).all():
            break
        want = lower
    sizes = np.bincount(want, minlength=400)
    monkeypatch.setattr(clustering, "TILE", 60)
    monkeypatch.setattr(clustering, "_links", None)  # cells would copy every point many times
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")  # else one task sees all tiles, however they are dealt
    try:
        got = clusters(spark, points, eps, min_size=2)
    finally:
        spark.conf.unset(merged)
    assert got == [r if sizes[r] > 1 else -1 for r in want]


def test_rows_without_a_finite_vector_are_noise(spark):
    df = spark.createDataFrame(
        [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 2.0])],
        "id bigint, v array<double>",
    )
    got = clustering.density_clusters(df, "id", "v", 0.5, min_size=2).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, -1), (4, -1), (5, -1)]


def test_points_that_cells_do_not_part_are_not_copied(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    stored, inner = {}, clustering.materialize

    def storing(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        kept = inner(df, name)
        stored.setdefault(name, []).append((kept.count(), "explode" in plan))
        return kept

    monkeypatch.setattr(clustering, "materialize", storing)
    monkeypatch.setattr(clustering, "TILE", 20)
    monkeypatch.setattr(clustering, "STRIP", 150, raising=False)
    clusters(spark, points, 0.9, min_size=2)  # few links, no large component
    assert "cells" not in stored  # up to one row per point and pivot
    assert len(stored["links"]) >= 3 and not any(copied for _, copied in stored["links"])
    assert all(rows <= 400 for name in stored for rows, _ in stored[name])


@pytest.mark.parametrize("block", [1, 256])
def test_near_pairs_are_those_of_plain_distances(block):
    rng = np.random.default_rng(2)
    rows = rng.integers(-3, 4, (90, 5)) * 0.1 + 40
    others = np.concatenate([rows[:40], rng.integers(-3, 4, (block, 5)) * 0.1 + 40])
    for eps in (0.0, 0.1, 0.2, 0.5):  # many distances equal the radius but for rounding
        want = np.nonzero(np.sqrt(((rows[:, None] - others[None]) ** 2).sum(2)) <= eps)
        got = clustering._near(rows, others, eps)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_shuffle_files_go_when_a_result_is_stored(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        names = manager.getAllFiles().mkString("\n").split("\n")
        return {name for name in names if "/shuffle_" in name}

    before = files()
    kept = materialize(spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).count(), "swept")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.count() == 977
    assert spark.conf.get(SWEEP, None) in (None, "false")
