"""A 2-D map of a neighbour graph: fuzzy edge weights, then attraction and repulsion in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.operators import neighbours
from quillmill.operators.clustering import project_2d
from quillmill.operators.scale import salted_join
from quillmill.session import materialize

#: The curve 1 / (1 + A d^(2B)) that is near 1 up to a distance of 0.1.
A, B = 1.577, 0.8951
STEPS = 64
ROUNDS = 30
#: Points of a block, among which the partners of repulsion are drawn.
BLOCK = 256
PARTNERS = 5
#: Points whose links one tile holds, and links of one point in a tile.
TILE = 1 << 15
HUB = 1 << 12


def bandwidths(lists: DataFrame) -> DataFrame:
    """(id, n, d, weight) per list entry: exp(-(d - nearest) / sigma), 1 up to the nearest.

    ``nearest`` is the least distance above 0 in the list, and sigma the width at which the
    weights of a list sum to log2 of its length, found by ``STEPS`` bisections.
    """
    kind = lists.schema["list"].dataType.elementType["n"].dataType.simpleString()
    schema = f"id {kind}, n {kind}, d double, weight double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["d"].str.len().to_numpy()
            for size in np.unique(sizes[sizes > 0]):  # lists of one length at a time
                some = batch[sizes == size]
                d = np.stack(some["d"].to_numpy()).astype(float)
                nearest = np.where(d > 0, d, np.inf).min(1, keepdims=True)
                gap = np.maximum(d - np.where(np.isinf(nearest), 0.0, nearest), 0)
                low, high, sigma = np.zeros_like(nearest), np.full_like(nearest, np.inf), np.ones_like(nearest)
                for _ in range(STEPS):
                    over = np.exp(-gap / sigma).sum(1, keepdims=True) > math.log2(size)
                    low, high = np.where(over, low, sigma), np.where(over, sigma, high)
                    sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
                yield pd.DataFrame({
                    "id": np.repeat(some["id"].to_numpy(), size), "n": np.concatenate(some["n"].to_numpy()),
                    "d": d.ravel(), "weight": np.exp(-gap / sigma).ravel()})

    flat = lists.select("id", F.col("list.d").alias("d"), F.col("list.n").alias("n"))
    return flat.mapInPandas(run, schema)


def fuzzy_edges(lists: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: the union u + v - u v of what the two ends give the edge."""
    both = bandwidths(lists).select(
        F.least("id", "n").alias("a"), F.greatest("id", "n").alias("b"), "weight")
    return both.groupBy("a", "b").agg(
        F.max("weight").alias("u"), F.when(F.count(F.lit(1)) > 1, F.min("weight")).otherwise(0.0).alias("v")
    ).select("a", "b", (F.col("u") + F.col("v") - F.col("u") * F.col("v")).alias("weight")).where("weight > 0")


def tiles(links: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The links (a, b, weight) by tiles, (g, a, b, weight) with a list per (g, a), and (id, cells).

    ``cells`` are the tiles that hold a link of ``id``. The links of one point lie in one tile,
    beyond ``HUB`` in several, so a tile is about the links of ``TILE`` points.
    """
    count = max(min(neighbours.CELLS, math.ceil(n / neighbours.LEAF)), math.ceil(n / TILE))
    hubs = links.groupBy("a").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HUB).select(
        "a", F.ceil(F.col("rows") / HUB).alias("salts"))
    salt = F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))
    dealt = salted_join(links, materialize(hubs, "hubs"), ["a"], ["b"], "left").select(
        F.pmod(F.xxhash64("a", salt), F.lit(count)).cast("int").alias("g"), "a", "b", "weight")
    packed = dealt.groupBy("g", "a").agg(F.sort_array(F.collect_list(F.struct("b", "weight"))).alias("to"))
    stored = materialize(packed.select(
        "g", "a", F.col("to.b").alias("b"), F.col("to.weight").alias("weight")), "tiles")
    ends = stored.select("g", F.explode(F.array_union(F.array("a"), "b")).alias("id")).distinct()
    return stored, ends.groupBy("id").agg(F.sort_array(F.collect_list("g")).alias("cells"))


def pulls(tile: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """(id, ax, ay, weight): the pull of a tile's links on each point, weighted and summed."""
    if not len(tile) or not len(seen):
        return pd.DataFrame({"id": [], "ax": [], "ay": [], "weight": []})
    where, index = seen[["x", "y"]].to_numpy(), pd.Index(seen["id"])
    tile = tile.sort_values("a")
    sizes = tile["b"].str.len().to_numpy()
    row, weight = np.repeat(np.arange(len(tile)), sizes), np.concatenate(tile["weight"].to_numpy())
    gap = where[index.get_indexer(tile["a"])][row] - where[index.get_indexer(np.concatenate(tile["b"].to_numpy()))]
    square = (gap * gap).sum(1)
    near = np.where(square > 0, square, 1.0)
    force = np.where(square > 0, -2 * A * B * near ** (B - 1) / (1 + A * near ** B), 0.0)
    drawn = np.clip(force[:, None] * gap, -4, 4) * weight[:, None]
    total = [np.bincount(row, x, len(tile)) for x in (drawn[:, 0], drawn[:, 1], weight)]
    return pd.DataFrame({"id": tile["a"].to_numpy(), "ax": total[0], "ay": total[1], "weight": total[2]})


def neighbour_layout(
    df: DataFrame, id_col: str, vector_col: str, k: int = 15, rounds: int = ROUNDS,
    seed: int = fixed.SEED, leaf: int = neighbours.LEAF,
) -> DataFrame:
    """(id, x, y): points that are neighbours by the angle of their vectors lie together.

    Edges of the ``k``-neighbour lists get fuzzy weights. From the plane of the two
    principal components on, each round moves every point along the mean pull of its edges
    and the push of ``PARTNERS`` points drawn from its block of the round, by a step that
    shrinks to nothing. Draws follow from ids and the round; a round reads the edges in their
    ``tiles`` and sends each a position once. A block of the push never holds more than
    about ``BLOCK`` points. Rows without a vector of finite
    numbers, or with one of zeros, have no place (NULL). One row per id; all vectors
    have one length.
    """
    rows = materialize(df.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("raw")), "layout-rows")
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda t, x: t + x * x))
    placed = rows.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    points = materialize(placed.select(
        "id", F.transform("raw", lambda x: x / F.col("norm")).alias("vector"), "raw", "norm"), "layout-points")
    n = points.count()
    if n < 3:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("x"),
                           F.lit(None).cast("double").alias("y"))
    lists = neighbours.neighbour_lists(points, min(k, n - 1), leaf=leaf, seed=seed)
    # The distance of two directions is half the square of that of their unit vectors.
    angles = materialize(lists.select("id", F.transform(
        "list", lambda x: F.struct((x["d"] * x["d"] / 2).alias("d"), x["n"].alias("n"))).alias("list")),
        "angles")
    edges = materialize(fuzzy_edges(angles), "layout-edges")
    links = materialize(edges.unionByName(edges.select(
        F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "links")
    plane = project_2d(points, "id", "vector")
    widest = plane.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0] or 1.0
    stored, cells = tiles(links, n)
    # A round only moves positions: links stay where they are, dealt to tasks by tile once.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stored.repartition(parts, "g").sortWithinPartitions("g").persist()
    at = materialize(
        plane.select("id", (F.col("x") * 10 / widest).alias("x"), (F.col("y") * 10 / widest).alias("y"))
        .join(cells, "id", "left"), "layout-0")
    groups = max(1, math.ceil(n / BLOCK))

    def push(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("order")  # a new one each round: neighbours are drawn partners
        where = block[["x", "y"]].to_numpy()
        total = np.zeros_like(where)
        for step in range(1, PARTNERS + 1):
            gap = where - np.roll(where, step, axis=0)
            square = (gap * gap).sum(1, keepdims=True)
            force = 2 * B / ((0.001 + square) * (1 + A * square ** B)) * gap
            total += np.clip(np.where(square > 0, force, 0.0), -4, 4)
        return pd.DataFrame({"id": block["id"], "px": total[:, 0], "py": total[:, 1]})

    kind = points.schema["id"].dataType.simpleString()
    for turn in range(rounds):
        step = 1.0 - turn / rounds
        sent = at.select("id", "x", "y", F.explode("cells").alias("g"))
        pulled = (
            kept.groupBy("g").cogroup(sent.groupBy("g"))
            .applyInPandas(lambda _, tile, seen: pulls(tile, seen), f"id {kind}, ax double, ay double, weight double")
            .groupBy("id").agg(*[(F.sum(c) / F.sum("weight")).alias(c) for c in ("ax", "ay")])
        )
        order = F.xxhash64(F.lit(seed), F.lit(turn), "id")
        pushed = at.select("id", "x", "y", order.alias("order"), F.pmod(order, F.lit(groups)).alias("g")).groupBy(
            "g").applyInPandas(push, f"id {kind}, px double, py double")
        moved = at.join(pulled, "id", "left").join(pushed, "id")
        at = materialize(moved.select("id", "cells", *[
            (F.col(c) + step * (F.coalesce(f"a{c}", F.lit(0.0)) + F.col(f"p{c}") / PARTNERS)).alias(c)
            for c in ("x", "y")]), f"layout-{turn + 1}")
    kept.unpersist()
    return rows.select("id").join(at, "id", "left").select(F.col("id").alias(id_col), "x", "y")
