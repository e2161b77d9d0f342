"""Connected components by hooking to smaller neighbours, jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.scale import salted_join
from quillmill.session import materialize


def _follow(rows: DataFrame, column: str, parents: DataFrame, keep: list[str]) -> DataFrame:
    """Replace ``column`` by its parent where it has one; many rows may share a parent."""
    known = parents.select(F.col("node").alias(column), F.col("root").alias("_next"))
    joined = salted_join(rows, known, [column], keep, "left")
    return joined.withColumn(column, F.coalesce("_next", column)).drop("_next")


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node connected.

    Each round points every node at its smallest neighbour if that is smaller, halves the
    pointer paths until they end at roots, and keeps only edges between different roots.
    """
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    level = materialize(both.where("a <> b").distinct(), "edges")
    roots = materialize(
        level.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")),
        "roots",
    )
    while not level.isEmpty():
        parents = materialize(
            level.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("low"))
            .select("node", F.least("node", "low").alias("root")),
            "parents",
        )
        while True:
            jumped = _follow(
                parents.withColumn("before", F.col("root")), "root", parents, ["node"]
            )
            jumped = materialize(jumped, "jumped")
            settled = jumped.where(F.col("root") != F.col("before")).isEmpty()
            parents = jumped.drop("before")
            if settled:
                break
        roots = materialize(_follow(roots, "root", parents, ["node"]), "roots")
        half = materialize(_follow(level, "a", parents, ["b"]).distinct(), "half")
        moved = _follow(half, "b", parents, ["a"])
        level = materialize(moved.where("a <> b").distinct(), "edges")
    return roots
