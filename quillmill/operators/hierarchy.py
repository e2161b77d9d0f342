"""Density clusters without a radius: spanning tree, merge tree, condensed tree, stability."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.operators import neighbours
from quillmill.operators.graph import component_roots
from quillmill.operators.scale import salted_join
from quillmill.session import materialize

NOISE = -1
#: Edges of the spanning tree that one task merges in a row.
CHUNK = 1 << 18


# --- spanning tree --------------------------------------------------------------------


def _relabel(rows: DataFrame, column: str, moved: DataFrame, salt_by: list[str]) -> DataFrame:
    to = moved.select(F.col("node").alias(column), F.col("root").alias("_to"))
    joined = salted_join(rows, to, [column], salt_by, "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_to")


def _weighted(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the distance, or the greater core distance of the two if that is more."""
    ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()
    return (
        ends.join(core.select(F.col("id").alias("a"), F.col("core").alias("_ca")), "a")
        .join(core.select(F.col("id").alias("b"), F.col("core").alias("_cb")), "b")
        .select("a", "b", F.greatest("d", "_ca", "_cb").alias("w"))
    )


def _lightest(edges: DataFrame) -> DataFrame:
    """(root, w, a, b, other): the lightest edge that leaves each component."""
    both = edges.select(F.col("ra").alias("root"), F.col("rb").alias("other"), "w", "a", "b")
    both = both.unionByName(
        edges.select(F.col("rb").alias("root"), F.col("ra").alias("other"), "w", "a", "b"))
    least = both.groupBy("root").agg(F.min(F.struct("w", "a", "b", "other")).alias("x"))
    return least.select("root", "x.*")


def spanning_tree(
    points: DataFrame, k: int = 15, min_samples: int = 1, leaf: int = neighbours.LEAF,
    trees: int = neighbours.TREES, seed: int = fixed.SEED,
) -> DataFrame:
    """(a, b, w): a minimum spanning tree of ``points`` (id, vector), a < b.

    The weight of two points is their distance, or the distance of either to its
    ``min_samples``-th neighbour if that is more. Components grow in rounds, each along its
    lightest edge; equal weights go by (a, b), so there is one tree. Edges come from the
    ``k``-neighbour lists. What is not in a point's list is at least as far as the list's
    end, so an edge no longer than the shortest end of a component is certainly its
    lightest; no other is taken while there is such a one. Then the others look for their
    nearest point of another component in random blocks (coarser ones each time). All
    of that costs the same per point and round. Up to ``leaf`` points the tree is exact;
    beyond, as good as the lists and blocks.
    """
    points = materialize(points.select("id", "vector"), "tree-points")
    n = points.count()
    if n < 2:
        return points.select(F.col("id").alias("a"), F.col("id").alias("b"),
                             F.lit(0.0).alias("w")).limit(0)
    lists = materialize(
        neighbours.neighbour_lists(points, max(k, min_samples), trees=trees, leaf=leaf, seed=seed),
        "tree-lists",
    )
    ends = lists.select(
        "id", F.coalesce(F.get("list", F.lit(min_samples - 1))["d"], F.lit(0.0)).alias("core"),
        F.when(F.size("list") >= min(k, n - 1), F.element_at("list", -1)["d"])
        .otherwise(0.0 if n - 1 > k else float("inf")).alias("reach"),
    )
    if n - 1 <= max(k, min_samples):  # the lists hold everything
        ends = ends.withColumn("reach", F.lit(float("inf")))
    core = materialize(ends, "cores")
    listed = lists.select(F.col("id").alias("a"), F.explode("list").alias("x")).select(
        "a", F.col("x.n").alias("b"), F.col("x.d").alias("d"))
    edges = materialize(
        _weighted(listed, core).select("*", F.col("a").alias("ra"), F.col("b").alias("rb")), "edges"
    )
    roots = materialize(core.select("id", F.col("id").alias("root")), "roots")
    reach = materialize(core.select(F.col("id").alias("root"), "reach"), "reach")
    chosen: list[DataFrame] = []
    bits = full = max(0, math.ceil(math.log2(n / leaf)))
    centre, searches = None, 0
    while reach.limit(2).count() > 1:
        best = materialize(_lightest(edges).join(reach, "root"), "lightest")
        picks = best.where(F.col("w") <= F.col("reach"))
        if picks.isEmpty():
            if centre is None:
                centre = neighbours._mean(points)
            searches += 1
            placed = materialize(points.join(roots, "id"), "placed")
            dealt = neighbours.blocks(points, trees if full else 1, bits, leaf, seed + searches, centre)
            near = neighbours.block_lists(placed, dealt, 1, apart="root")
            found = near.select(F.col("id").alias("a"), F.get("list", F.lit(0)).alias("x")).select(
                "a", F.col("x.n").alias("b"), F.col("x.d").alias("d"))
            more = _weighted(found, core)
            for end, name in (("a", "ra"), ("b", "rb")):
                more = more.join(roots.select(F.col("id").alias(end), F.col("root").alias(name)), end)
            edges = materialize(
                edges.unionByName(more.select(edges.columns)).distinct(), "edges")
            picks, bits = _lightest(edges), max(0, bits - 2)
        picks = materialize(picks.select("a", "b", "w", "root", "other"), "picks")
        if picks.isEmpty():
            continue  # coarser blocks will hold two components
        chosen.append(picks.select("a", "b", "w").distinct())
        moved = materialize(
            component_roots(picks.select(F.col("root").alias("a"), F.col("other").alias("b"))),
            "moved",
        )
        roots = materialize(_relabel(roots, "root", moved, ["id"]), "roots")
        reach = materialize(
            _relabel(reach, "root", moved, ["reach"]).groupBy("root")
            .agg(F.min("reach").alias("reach")), "reach")
        half = materialize(_relabel(edges, "ra", moved, ["a", "b"]), "half")
        crossing = _relabel(half, "rb", moved, ["a", "b"]).where("ra <> rb")
        pair = [F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")]
        edges = materialize(
            crossing.select("w", "a", "b", *pair).groupBy("ra", "rb")
            .agg(F.min(F.struct("w", "a", "b")).alias("x")).select("x.a", "x.b", "x.w", "ra", "rb"),
            "edges",
        )
    tree = chosen[0]
    for part in chosen[1:]:
        tree = tree.unionByName(part)
    return materialize(tree, "tree")


# --- merge tree -------------------------------------------------------------------------


def ranked(tree: DataFrame) -> DataFrame:
    """The edges (a, b, w) with ``rank`` 0, 1, ... by (w, a, b): sorted in ranges, offsets added."""
    tasks = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(
        tree.repartitionByRange(tasks, "w", "a", "b").withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("w", "a", "b")
    return (
        dealt.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(offsets), "_part")
        .select("a", "b", "w", (F.col("_i") + F.col("_before")).cast("bigint").alias("rank"))
    )


def merge_tree(tree: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(rank, w, size, child, child_point, child_size): two rows per merge of single linkage.

    Merging by rising weight is one long chain, but the merges of a range of ranks only need
    to know what the lighter ones have joined. So the range of all ranks is halved again
    and again; the nodes of each upper half are replaced by the components of its lower
    half, for all halves of a level at once. After log2(n / ``chunk``) levels a range has at
    most ``chunk`` edges and one task merges them in order. A child is the ``rank`` of an
    earlier merge, or a point (``child_point``).
    """
    edges = materialize(
        ranked(tree).select(F.lit(0).cast("bigint").alias("lo"), "rank", "w",
                             F.to_json(F.struct(F.col("a").alias("p"))).alias("x"),
                             F.to_json(F.struct(F.col("b").alias("p"))).alias("y"), "a", "b"), "ranked")
    # A node is a point or a component, named by one of its points; ``top`` is its last merge.
    names = edges.select(F.col("x").alias("node"), F.col("a").alias("point")).unionByName(
        edges.select(F.col("y").alias("node"), F.col("b").alias("point"))).distinct()
    nodes = materialize(names.select(
        F.lit(0).cast("bigint").alias("lo"), "node", F.lit(1).cast("bigint").alias("size"),
        F.lit(-1).cast("bigint").alias("top"), "point"), "nodes")
    edges = edges.drop("a", "b")
    n = edges.count()
    span = 1
    while span < n:
        span *= 2
    while span > chunk:
        span //= 2
        upper = F.col("rank") >= F.col("lo") + span
        lower = materialize(edges.where(~upper), "lower")
        key = lambda c: F.concat(F.col("lo").cast("string"), F.lit("|"), F.col(c))
        joined = materialize(component_roots(lower.select(key("x").alias("a"), key("y").alias("b"))), "joined")
        of = nodes.select("*", key("node").alias("_key")).join(
            joined.select(F.col("node").alias("_key"), F.col("root").alias("_root")), "_key", "left"
        ).withColumn("_root", F.coalesce("_root", "_key"))
        tops = lower.select(key("x").alias("_key"), "rank").join(
            joined.select(F.col("node").alias("_key"), F.col("root").alias("_root")), "_key"
        ).groupBy("_root").agg(F.max("rank").alias("_top"))
        whole = materialize(
            of.groupBy("lo", "_root").agg(F.sum("size").alias("size"), F.max("top").alias("_own"),
                                          F.min("point").alias("point"))
            .join(tops, "_root", "left")
            .select((F.col("lo") + span).alias("lo"), F.col("_root").alias("node"), "size",
                    F.coalesce("_top", "_own").alias("top"), "point"), "wholes")
        high = edges.where(upper)
        moved = joined.select(F.col("node").alias("_key"), F.col("root").alias("_root"))
        for end in ("x", "y"):
            high = materialize(
                salted_join(high.withColumn("_key", key(end)), moved, ["_key"], ["rank"], "left")
                .withColumn(end, F.coalesce("_root", "_key")).drop("_key", "_root"), "high")
        high = high.withColumn("lo", F.col("lo") + span)
        edges = materialize(lower.unionByName(high.select(lower.columns)), "ranked")
        used = edges.select("lo", F.explode(F.array("x", "y")).alias("node")).distinct()
        nodes = materialize(
            nodes.unionByName(whole).join(used, ["lo", "node"], "left_semi"), "nodes")

    point = nodes.schema["point"].dataType.simpleString()
    schema = (f"rank bigint, w double, size bigint, child bigint, child_point {point}, "
              "child_size bigint")

    def merge(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        place = {node: i for i, node in enumerate(nodes["node"])}
        up, size, top = list(range(len(nodes))), nodes["size"].tolist(), nodes["top"].tolist()
        point = nodes["point"].tolist()

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        out = []
        for rank, w, x, y in edges.sort_values("rank")[["rank", "w", "x", "y"]].itertuples(index=False):
            i, j = find(place[x]), find(place[y])
            total = size[i] + size[j]
            for child in (i, j):
                out.append((rank, w, total, None if top[child] < 0 else top[child],
                            point[child] if top[child] < 0 else None, size[child]))
            up[j], size[i], top[i] = i, total, rank
        frame = pd.DataFrame(out, columns=["rank", "w", "size", "child", "child_point", "child_size"])
        return frame.astype({"child": "Int64", "child_point": object})

    return materialize(
        edges.groupBy("lo").cogroup(nodes.groupBy("lo")).applyInPandas(
            lambda e, v: merge(e, v) if len(e) else pd.DataFrame(
                {"rank": [], "w": [], "size": [], "child": [], "child_point": [], "child_size": []}),
            schema), "merges")


# --- condensed tree ----------------------------------------------------------------------


def _jump(links: DataFrame) -> DataFrame:
    """(node, next, done): every pointer followed to its end, by doubling."""
    while True:
        ends = links.select(F.col("node").alias("_n"), F.col("next").alias("_next"),
                            F.col("done").alias("_done"))
        on = (F.col("next") == F.col("_n")) & ~F.col("done")
        links = materialize(
            links.join(ends, on, "left").select(
                "node", F.coalesce("_next", "next").alias("next"),
                (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done")), "jumped")
        if links.where("NOT done").isEmpty():
            return links


def condensed(merges: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """The merge tree without parts of fewer than ``min_size`` points.

    Returns (cluster, parent, birth, stability, size), and (rank, cluster) of the merges of
    ``min_size`` points or more. Going down from the root, a merge whose two children both
    have ``min_size`` points parts a cluster in two; otherwise the cluster goes on in the
    greater one and the points of a smaller one leave it there. With 1 / w as density (the
    least weight above 0 standing for 0), the stability of a cluster is the density at which
    each point leaves it less that of its birth, summed. A cluster is named by its first
    merge from above.
    """
    least = merges.where("w > 0").agg(F.min("w")).first()[0] or 1.0
    dense = 1 / F.greatest("w", F.lit(float(least)))
    big = materialize(
        merges.where(F.col("size") >= min_size).groupBy("rank", "w", "size").agg(
            F.sort_array(F.collect_list("child_size")).alias("parts"),
            F.collect_list("child").alias("children"))
        .withColumn("parts_two", F.get("parts", F.lit(0)) >= min_size), "big-merges")
    above = materialize(
        merges.where(F.col("child").isNotNull() & (F.col("child_size") >= min_size))
        .select(F.col("child").alias("rank"), F.col("rank").alias("above"))
        .join(big.select(F.col("rank").alias("above"), F.col("parts_two").alias("cut"),
                         dense.alias("birth")), "above"), "above")
    placed = big.select("rank").join(above, "rank", "left")
    goes_up = F.coalesce(~F.col("cut"), F.lit(False))
    heads = _jump(materialize(placed.select(
        F.col("rank").alias("node"), F.when(goes_up, F.col("above")).otherwise(F.col("rank")).alias("next"),
        (~goes_up).alias("done")), "heads")).select(F.col("node").alias("rank"), F.col("next").alias("cluster"))
    heads = materialize(heads, "heads")
    born = above.where("cut").select(F.col("rank").alias("cluster"), "above", "birth").join(
        heads.select(F.col("rank").alias("above"), F.col("cluster").alias("parent")), "above")
    leaving = F.when(F.col("parts_two"), F.col("size")).otherwise(
        F.aggregate(F.filter("parts", lambda s: s < min_size), F.lit(0).cast("bigint"), lambda t, s: t + s))
    inside = big.join(heads, "rank")
    sums = inside.groupBy("cluster").agg(
        F.sum(leaving * dense).alias("left"), F.sum(leaving).alias("points"),
        F.max("size").alias("size"))
    clusters = sums.join(born.select("cluster", "parent", "birth"), "cluster", "left").select(
        "cluster", "parent", F.coalesce("birth", F.lit(0.0)).alias("birth"),
        (F.col("left") - F.col("points") * F.coalesce("birth", F.lit(0.0))).alias("stability"), "size")
    return materialize(clusters, "clusters"), heads


def stable_clusters(clusters: list[tuple]) -> dict[int, int]:
    """cluster -> the chosen cluster it belongs to, for those in a chosen one.

    From the leaves up, a cluster is chosen over all chosen below it if it is at least as
    stable as they are together. The root is never chosen.
    """
    below: dict[int, list[int]] = {}
    for cluster, parent, _ in clusters:
        below.setdefault(parent, []).append(cluster)
    own = {cluster: stability for cluster, _, stability in clusters}
    order = [c for c, parent, _ in clusters if parent is None]
    for cluster in order:  # parents before children
        order += below.get(cluster, [])
    value, wins = {}, {}
    for cluster in reversed(order):
        under = sum(value[c] for c in below.get(cluster, []))
        wins[cluster] = own[cluster] >= under
        value[cluster] = max(own[cluster], under)
    chosen: dict[int, int] = {}
    parents = {cluster: parent for cluster, parent, _ in clusters}
    for cluster in order:
        if parents[cluster] is None:
            continue
        if parents[cluster] in chosen:
            chosen[cluster] = chosen[parents[cluster]]
        elif wins[cluster]:
            chosen[cluster] = cluster
    return chosen


def hierarchical_clusters(
    df: DataFrame, id_col: str, vector_col: str, min_size: int | None = None, min_samples: int = 1,
    k: int = 15, chunk: int = CHUNK, leaf: int = neighbours.LEAF,
) -> DataFrame:
    """(id, cluster_id): the most stable clusters at any density, the rest as noise (-1).

    ``min_size`` defaults to max(4, n // 20). A cluster is named by its smallest id. Equal
    vectors are one point of the neighbour search and then join at distance 0. The condensed
    tree has at most 2 n / ``min_size`` clusters, 40 by default; choosing among them is the
    one step on the driver, so ``min_size`` should grow with the table. A row without a
    vector of finite numbers is noise; all vectors have one length.
    """
    rows = materialize(
        df.select(F.col(id_col).alias("id"),
                  F.col(vector_col).cast("array<double>").alias("vector")), "hierarchy-rows")
    finite = F.coalesce(
        F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    placed = rows.where(finite)
    if min_size is None:
        min_size = max(4, rows.count() // 20)
    firsts = materialize(placed.groupBy("vector").agg(F.min("id").alias("first")), "vectors")
    own = materialize(salted_join(placed, firsts, ["vector"], ["id"]).select("id", "first"), "firsts")
    tree = spanning_tree(
        firsts.select(F.col("first").alias("id"), "vector"), k, min_samples, leaf=leaf)
    copies = own.where("id <> first").select(
        F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
    tree = materialize(tree.unionByName(copies), "whole-tree")
    nobody = F.lit(NOISE).cast("bigint").alias("cluster_id")
    if tree.count() + 1 < max(2, min_size):
        return rows.select(F.col("id").alias(id_col), nobody)
    merges = merge_tree(tree, chunk)
    clusters, heads = condensed(merges, min_size)
    chosen = stable_clusters([tuple(r) for r in clusters.select("cluster", "parent", "stability").collect()])
    if not chosen:
        return rows.select(F.col("id").alias(id_col), nobody)
    names = rows.sparkSession.createDataFrame(list(chosen.items()), "cluster bigint, name bigint")
    small = merges.where((F.col("child_size") < min_size) & F.col("child").isNotNull())
    steps = _jump(materialize(small.select(
        F.col("child").alias("node"), F.col("rank").alias("next"),
        (F.col("size") >= min_size).alias("done")), "small-merges")) if not small.isEmpty() else None
    leaves = merges.where(F.col("child_point").isNotNull()).select(
        F.col("child_point").alias("id"), "rank")
    if steps is not None:
        leaves = salted_join(
            materialize(leaves, "leaves"),
            steps.select(F.col("node").alias("rank"), F.col("next").alias("_up")), ["rank"], ["id"], "left"
        ).select("id", F.coalesce("_up", "rank").alias("rank"))
    member = materialize(
        salted_join(materialize(leaves, "leaves"), heads.join(names, "cluster").select("rank", "name"),
                    ["rank"], ["id"]).select("id", "name"), "members")
    called = member.groupBy("name").agg(F.min("id").alias("cluster_id"))
    labelled = salted_join(member, called, ["name"], ["id"]).select("id", "cluster_id")
    return rows.select("id").join(labelled, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("cluster_id", nobody).cast("bigint").alias("cluster_id"))
