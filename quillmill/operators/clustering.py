"""Projection and clustering of embeddings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, StructField, StructType

from quillmill.functions import fixed
from quillmill.operators import blocking
from quillmill.operators.graph import component_roots
from quillmill.operators.neighbours import vector_mark
from quillmill.operators.scale import salted_join
from quillmill.session import materialize

NOISE = -1
HEADS = 8
HEADS_GROWTH = 8
#: Pivots are broadcast: at most this many vectors.
PIVOTS = 256
#: Rows of a block that one task compares with the block's heads at a time.
CHUNK = 4096
#: Points of a tile, where cells part nothing.
TILE = 4096
#: Points that are broadcast at a time to be compared with all others.
STRIP = 1 << 15


def project_2d(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, y): the first two principal components of the centred vectors."""
    rows = df.select(
        id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("_raw")
    )
    centred = StandardScaler(
        inputCol="_raw", outputCol="_centred", withMean=True, withStd=False
    ).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="_centred", outputCol="_plane").fit(centred)
    # The sign of a component is arbitrary: make its largest entry positive.
    signs = [1.0 if max(c, key=abs) > 0 else -1.0 for c in model.pc.toArray().T]
    plane = vector_to_array("_plane")
    return model.transform(centred).select(
        id_col,
        (F.get(plane, F.lit(0)) * signs[0]).alias("x"),
        (F.get(plane, F.lit(1)) * signs[1]).alias("y"),
    )


def kmeans_size(n: int) -> int:
    return max(2, min(8, n // 5))


def kmeans_clusters(
    df: DataFrame, id_col: str, vector_col: str, seed: int = fixed.SEED
) -> DataFrame:
    """(id, cluster_id) by k-means, k following the number of rows."""
    rows = df.select(
        id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("_v")
    )
    model = KMeans(
        k=kmeans_size(rows.count()), seed=seed, featuresCol="_v", predictionCol="cluster_id"
    ).fit(rows)
    return model.transform(rows).select(id_col, "cluster_id")


def _wide_axes(points: DataFrame, eps: float, n_axes: int) -> list[int]:
    """At most ``n_axes`` coordinates of largest variance that span more than four eps.

    A grid block is two eps wide and every point lies in two per axis, so a narrower axis
    costs more copies than it saves comparisons.
    """
    spread = (
        points.select(F.posexplode("vector").alias("axis", "value"))
        .groupBy("axis")
        .agg(
            F.var_pop("value").alias("spread"),
            (F.max("value") - F.min("value")).alias("span"),
        )
        .where(F.col("span") > 4 * eps)
        .orderBy(F.desc("spread"), "axis")
        .limit(n_axes)
    )
    return [row["axis"] for row in spread.collect()]


def _grid_corners(eps: float, axes: list[int]) -> Column:
    """The overlapping blocks of grid cells of a point; all pairs within eps share one.

    A coordinate differs by no more than the distance does. Cells are eps wide, so such
    a pair lies in equal or neighbouring cells per axis; a block spans two cells per axis.
    """
    width = eps * (1 + 1e-9)
    cells = [F.floor(F.get("vector", F.lit(axis)) / width) for axis in axes]
    return F.array(*[
        F.xxhash64(F.lit(0), *[cell + shift for cell, shift in zip(cells, shifts)])
        for shifts in itertools.product((0, 1), repeat=len(axes))
    ])


def _squares(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all others, as one matrix product."""
    cross = rows @ others.T
    return np.maximum(
        (rows * rows).sum(1)[:, None] + (others * others).sum(1)[None, :] - 2 * cross, 0
    )


def _stacked(vectors: pd.Series) -> np.ndarray:
    """Vectors, of either precision, as the rows of a matrix."""
    return np.stack(vectors.to_numpy()).astype(float)


def _near(rows: np.ndarray, others: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), by row: the pairs at most ``eps`` apart; those that rounding may decide are recomputed.

    One matrix product gives minus half the squares, the norms being two more coordinates.
    """
    a, b = (rows * rows).sum(1)[:, None], (others * others).sum(1)[:, None]
    half = np.hstack([rows, a / -2, np.ones_like(a)]) @ np.hstack([others, np.ones_like(b), b / -2]).T
    slack = 1e-9 * max(1.0, float(a.max()), float(b.max()))
    i, j = np.divmod(np.flatnonzero(half >= -(eps * eps + slack) / 2), len(others))
    sure = half[i, j] > -(eps * eps - slack) / 2
    doubt = np.flatnonzero(~sure)
    for start in range(0, len(doubt), 4096):
        some = doubt[start:start + 4096]
        sure[some] = np.sqrt(((rows[i[some]] - others[j[some]]) ** 2).sum(1)) <= eps
    return i[sure], j[sure]


def _pivots(points: DataFrame, eps: float, most: int) -> np.ndarray:
    """At most ``most`` points, taken by the hash of their id, more than eps from each other.

    They only decide how the points are dealt out, never which are compared in the end.
    """
    n = points.count()
    wanted = max(1, min(most, math.isqrt(n)))
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").collect()
    chosen: list[np.ndarray] = []
    for row in drawn:
        vector = np.asarray(row["vector"], float)
        if not chosen or ((np.stack(chosen) - vector) ** 2).sum(1).min() > eps * eps:
            chosen.append(vector)
    return np.stack(chosen) if chosen else np.zeros((0, 0))


def _pivot_cells(points: DataFrame, eps: float, pivots: np.ndarray) -> DataFrame:
    """``cell`` and ``home`` in place of the vector: the cell of the nearest pivot, and each
    earlier cell with a point that may be within eps.

    If y is nearest to pivot a and x to pivot b, x is at most d(x, y) from the plane between
    a and b, hence d(x, a)^2 - d(x, b)^2 <= 2 eps d(a, b). Where that holds x is copied to
    the cell of a, so a pair within eps meets in the earlier of its two home cells.
    """
    if len(pivots) < 2:
        return points.drop("vector").withColumn("cell", F.lit(0)).withColumn("home", F.lit(True))
    apart = np.sqrt(_squares(pivots, pivots))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.iloc[start:start + 512]
                vectors = _stacked(batch["vector"])
                squares = _squares(vectors, pivots)
                home = squares.argmin(1)
                own = squares[np.arange(len(batch)), home]
                slack = 2 * eps * apart[home] * (1 + 1e-9) + 1e-9 * (1 + own[:, None])
                reach = squares - own[:, None] <= slack
                reach &= np.arange(len(pivots))[None, :] < home[:, None]
                reach[np.arange(len(batch)), home] = True
                row, cell = np.nonzero(reach)
                out = batch.drop(columns="vector").iloc[row].reset_index(drop=True)
                yield out.assign(cell=cell.astype(np.int32), home=cell == home[row])

    schema = StructType([
        *points.drop("vector").schema.fields,
        StructField("cell", IntegerType()), StructField("home", BooleanType()),
    ])
    return points.mapInPandas(deal, schema)


def _open_blocks(entries: DataFrame) -> DataFrame:
    """Entries of blocks with work left: ``lead`` marks the rows to compare with all others.

    Every link still to be found in a block has an end outside its largest component, and
    an end at home in it. The smaller of the two sets leads; without either the block is
    closed. ``salts`` says over how many tasks the block's rows are spread.
    """
    per_root = entries.groupBy("block", "root").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("at_home")
    )
    state = (
        per_root.groupBy("block")
        .agg(
            F.count(F.lit(1)).alias("roots"),
            F.max(F.struct("rows", "root")).alias("top"),
            F.sum("rows").alias("total"),
            F.sum("at_home").alias("at_home"),
        )
        .where((F.col("roots") > 1) & (F.col("at_home") > 0))
        .select(
            "block", F.col("top.root").alias("main"),
            (F.col("at_home") < F.col("total") - F.col("top.rows")).alias("by_home"),
            F.ceil(F.col("total") / CHUNK).cast("int").alias("salts"),
        )
    )
    lead = F.when(F.col("by_home"), F.col("home")).otherwise(F.col("root") != F.col("main"))
    return salted_join(entries, state, ["block"], ["id"]).select(
        "block", "id", "home", "root", "salts", lead.alias("lead")
    )


def _links(active: DataFrame, leaders: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """Distinct (a, b): components linked by a leader and another row of its block.

    A group holds the leaders of a block and about ``CHUNK`` of its rows; it compares them
    as one matrix product and returns no more links than join what is near: one per row,
    and one per two leaders that are neighbours in the list of a row.
    """
    members = active.select(
        "block", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
        "id", F.col("root").alias("of"),
    ).join(points.select("id", F.col("vector").alias("at")), "id").drop("id")
    heads = leaders.join(points.select("id", "vector"), "id").select(
        F.col("block").alias("h_block"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("h_salt"),
        F.col("root").alias("h_of"), F.col("vector").alias("h_at"),
    )
    kind = active.schema["root"].dataType

    def compare(rows: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(lead):
            return pd.DataFrame({"a": [], "b": []})
        names, codes = np.unique(
            np.concatenate([lead["h_of"].to_numpy(), rows["of"].to_numpy()]), return_inverse=True
        )
        mine, theirs = codes[:len(lead)], codes[len(lead):]
        row, head = _near(_stacked(rows["at"]), _stacked(lead["h_at"]), eps)
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        both = np.concatenate([
            np.stack([mine[head[first]], theirs[row[first]]], 1),
            np.stack([mine[head[:-1]], mine[head[1:]]], 1)[~first[1:]],
        ])
        both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
        return pd.DataFrame({"a": names[both[:, 0]], "b": names[both[:, 1]]})

    schema = StructType([StructField("a", kind), StructField("b", kind)])
    return (
        members.groupBy("block", "salt").cogroup(heads.groupBy("h_block", "h_salt"))
        .applyInPandas(compare, schema).distinct()
    )


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after joining the linked ones."""
    moved = component_roots(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return materialize(
        salted_join(roots, moved, ["root"], ["id"], "left")
        .select("id", F.coalesce("to", "root").alias("root")),
        "labels",
    )


def _joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``up`` points at roots; the same after joining the places ``a`` and ``b`` of each pair."""
    while True:
        apart = up[a] != up[b]
        if not apart.any():
            return up
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(up[a], up[b]), np.minimum(up[a], up[b]))
        while (up[up] != up).any():
            up = up[up]


def _near_components(
    at: np.ndarray, of: np.ndarray, heads: np.ndarray, h_of: np.ndarray, eps: float, n: int
) -> np.ndarray:
    """The root of each of ``n`` places after joining those of rows and heads within eps."""
    up, same = np.arange(n), at is heads
    for begin in range(0, len(heads), 256):
        first = begin if same else 0  # each pair once
        row, head = _near(at[first:], heads[begin:begin + 256], eps)
        up = _joined(up, of[first + row], h_of[begin + head])
    return up


def _forest(at: np.ndarray, of: np.ndarray, heads: np.ndarray, h_of: np.ndarray, eps: float) -> pd.DataFrame:
    """Links (a, b) of a forest that joins the components of rows and heads within eps."""
    names, codes = np.unique(np.concatenate([h_of, of]), return_inverse=True)
    up = _near_components(at, codes[len(h_of):], heads, codes[:len(h_of)], eps, len(names))
    moved = np.flatnonzero(up != np.arange(len(up)))
    return pd.DataFrame({"a": names[up[moved]], "b": names[moved]})


def _tile_components(points: DataFrame, eps: float, n: int) -> DataFrame:
    """(id, root): components of all points, compared in tiles of about ``TILE``.

    Tiles are dealt anew in rounds, until one brings fewer points into the largest component
    than a round compares each with. A link still to be found has an end outside that
    component, so the points there are compared with all, ``STRIP`` at a time: they are broadcast,
    and the others are read where they are stored. Nothing is shuffled but the points of a round,
    once, and links of forests, whatever the number of comparisons.
    """
    kind = points.schema["id"].dataType
    link = StructType([StructField("a", kind), StructField("b", kind)])
    tiles = math.ceil(n / TILE)

    def dealt(rows: DataFrame, turn: int) -> DataFrame:
        tile = F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(tiles)).cast("int")
        return rows.withColumn("tile", tile).groupBy("tile")

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        at, ids, places = _stacked(rows["vector"]), rows["id"].to_numpy(), np.arange(len(rows))
        up = _near_components(at, places, at, places, eps, len(rows))
        return pd.DataFrame({"id": ids, "root": ids[up]})

    def again(rows: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
        at = _stacked(rows.sort_values("id")["vector"])
        of = roots.sort_values("id")["root"].to_numpy()
        return _forest(at, of, at, of, eps)

    roots = materialize(dealt(points, 0).applyInPandas(
        alone, StructType([StructField("id", kind), StructField("root", kind)])), "labels")
    if tiles < 2:
        return roots
    turn, outside = 0, n
    while True:
        top = roots.groupBy("root").count().orderBy(F.desc("count"), "root").first()
        before, outside = outside, n - top["count"]
        if not outside:
            return roots
        if turn and (outside <= TILE or before - outside < TILE):
            break
        turn += 1
        links = dealt(points, turn).cogroup(dealt(roots, turn)).applyInPandas(again, link)
        roots = _merge(roots, materialize(links.distinct(), "links"))

    strips = math.ceil(outside / STRIP)
    strip = F.pmod(F.xxhash64(F.lit(-1), "id"), F.lit(strips))
    session = points.sparkSession

    def crossing(number: int) -> DataFrame:
        lead = points.join(F.broadcast(roots.where(
            (F.col("root") != F.lit(top["root"])) & (strip == number))), "id").select("vector", "root").toArrow()
        flat = [c.flatten().to_numpy() for c in lead["vector"].chunks if len(c)]
        if not flat:
            return session.createDataFrame([], link)
        sent = session.sparkContext.broadcast(
            (np.concatenate(flat).astype(float).reshape(len(lead), -1), lead["root"].to_numpy()))

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for start in range(0, len(whole), TILE):
                    batch = whole.iloc[start:start + TILE]
                    yield _forest(_stacked(batch["vector"]), batch["id"].to_numpy(), *sent.value, eps)

        links = points.select("id", "vector").mapInPandas(compare, link)
        for end in ("a", "b"):  # an end is a point, or the root of one
            links = links.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"of_{end}")), end)
        links = materialize(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct(), "links")
        sent.destroy()
        return links

    found = [crossing(number) for number in range(strips)]
    return _merge(roots, reduce(DataFrame.unionByName, found).distinct())


def neighbour_components(
    points: DataFrame, eps: float, axes: int = 3, per_block: int = HEADS, pivots: int = PIVOTS
) -> DataFrame:
    """(id, root): components of the graph that links points within ``eps``.

    Blocks are cells of pivots, cut further by a grid over wide axes; both lose no pair.
    Two rows of one component are never compared again: a leader is compared with every row
    of its block and then leaves it, and a block with one component left is closed. A
    dense crowd is closed in a round or two. No pair is listed, only links that join
    components. Points that no pivot can part (random directions in many dimensions, whose
    distances all lie between eps and twice eps) meet in every cell; no lossless block is
    known for them. If the cells hold more pairs than a table of more than ``TILE`` points,
    which is counted before a cell is written, tiles of it are compared.
    """
    rows = points.select("id", "vector")
    n = rows.count()
    wide = _wide_axes(rows, eps, axes)
    if wide:
        cells = _pivot_cells(
            rows.withColumn("corner", _grid_corners(eps, wide)), eps, _pivots(rows, eps, pivots)
        ).withColumn("corner", F.explode("corner"))
        block = F.xxhash64("cell", "corner")
    else:
        cells, block = _pivot_cells(rows, eps, _pivots(rows, eps, pivots)), F.col("cell").cast("bigint")
    entries = cells.select(block.alias("block"), "id", "home", F.col("id").alias("root"))
    if n > TILE:
        in_cells = entries.groupBy("block").count().agg(
            F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0
        if in_cells > float(n) * n:
            return _tile_components(rows, eps, n)
    entries = materialize(entries, "cells")
    roots = materialize(rows.select(F.col("id"), F.col("id").alias("root")), "labels")
    active = materialize(_open_blocks(entries), "open")
    while not active.isEmpty():
        leaders = materialize(
            blocking.heads(active.where("lead"), ["block"], per_block), "heads"
        )
        links = materialize(_links(active, leaders, rows, eps), "links")
        if not links.isEmpty():
            roots = _merge(roots, links)
        left = active.select("block", "id", "home").join(
            leaders.select("block", "id"), ["block", "id"], "left_anti"
        )
        # Roots are looked up by id, of which a block row has one and none is hot.
        active = materialize(
            _open_blocks(materialize(left.join(roots, "id"), "cells")), "open"
        )
        per_block = min(per_block * HEADS_GROWTH, blocking.MAX_HEADS)
    return roots


def _copies(points: DataFrame) -> DataFrame:
    """(id, first) of every point whose vector ``first``, the smallest such id, has as well.

    Vectors are told apart by SHA-256, so that none of them is shuffled.
    """
    marks = materialize(points.select("id", vector_mark("vector").alias("mark")), "marks")
    firsts = marks.groupBy("mark").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    shared = materialize(firsts.where("rows > 1").select("mark", "first"), "shared")
    return materialize(
        salted_join(marks, shared, ["mark"], ["id"]).where("id <> first").select("id", "first"), "copies")


def density_clusters(
    df: DataFrame, id_col: str, vector_col: str, eps: float, min_size: int | None = None
) -> DataFrame:
    """(id, cluster_id): components of points within ``eps``, small ones as noise (-1).

    ``min_size`` defaults to max(4, n // 20). A cluster is named by its smallest id.
    Equal vectors are folded first, so that copies are never compared. A row without a
    vector of finite numbers is noise; all vectors have one length.
    """
    single = df.schema[vector_col].dataType == ArrayType(FloatType())
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    points = materialize(
        df.select(F.col(id_col).alias("id"), F.when(finite, vector).alias("vector")), "points")
    placed = points.where("vector IS NOT NULL")
    if min_size is None:
        min_size = max(4, points.count() // 20)
    copies = _copies(placed)
    if not copies.isEmpty():
        placed = materialize(placed.join(copies, "id", "left_anti"), "vectors")
    roots = neighbour_components(placed, eps).withColumnRenamed("id", "first")
    firsts = materialize(
        points.select("id").join(copies, "id", "left").withColumn("first", F.coalesce("first", "id")), "firsts")
    labelled = materialize(
        salted_join(firsts, roots, ["first"], ["id"], "left").select("id", "root"), "components")
    big = (
        labelled.where(F.col("root").isNotNull()).groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= min_size)
        .select("root", F.col("root").alias("cluster_id"))
    )
    return salted_join(labelled, big, ["root"], ["id"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("cluster_id", F.lit(NOISE)).cast("bigint").alias("cluster_id"),
    )
