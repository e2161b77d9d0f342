"""Candidate blocks and the heads of blocks: comparing rows without all pairs of a block.

A block is a set of rows that may be similar (same signature part, same grid cell).
Rows are only ever compared with the first rows ("heads") of their blocks, round by
round, until nothing is left to decide. A block that holds a third of the table thus
costs a multiple of its size and not its square whenever its rows resemble its heads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.scale import salted_join
from quillmill.session import materialize

#: Spark keeps the first rows per block before the shuffle for ranks well below 1,000 only.
MAX_HEADS = 512


def without_singletons(entries: DataFrame, block: list[str]) -> DataFrame:
    """Entries of blocks that still hold two or more rows; each entry is shuffled once."""
    rows = F.count(F.lit(1)).over(Window.partitionBy(*block))
    return entries.withColumn("_rows", rows).where(F.col("_rows") > 1).drop("_rows")


def heads(entries: DataFrame, block: list[str], per_block: int) -> DataFrame:
    """The ``per_block`` entries of smallest id in every block, ``MAX_HEADS`` at most.

    A rank filter: Spark keeps only the first rows per block before the shuffle, so no task
    sorts a hot block whole. Rounds go on until every row had its turn.
    """
    order = Window.partitionBy(*block).orderBy("id")
    return (
        entries.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= min(per_block, MAX_HEADS))
        .drop("_rank")
    )


def head_pairs(
    entries: DataFrame, leaders: DataFrame, block: list[str], keep: Column
) -> DataFrame:
    """Distinct (head, member) pairs of a common block that satisfy ``keep``.

    ``keep`` refers to the head's columns with the prefix ``h_`` and must order the
    pair. Heads are bounded per block; the members of a hot block are spread over salts.
    The pairs (two ids each) are written, as later joins count them before reading them.
    """
    renamed = leaders.select(
        *block, *[F.col(c).alias(f"h_{c}") for c in leaders.columns if c not in block]
    )
    pairs = (
        salted_join(entries, renamed, block, ["id"])
        .where(keep)
        .select(F.col("h_id").alias("head"), F.col("id").alias("member"))
        .distinct()
    )
    # A few bytes each, but each costs a comparison: dealt to all tasks, not merged by size.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(pairs.repartition(tasks, "member"), "pairs")


def with_payload(
    pairs: DataFrame, payload: DataFrame, value: str, members: DataFrame | None = None
) -> DataFrame:
    """Attach ``value`` of both rows as ``a`` (head) and ``b`` (member, of ``members`` if given).

    A head may have a third of all rows as members: its payload is repeated per salt. The
    ids are written first, so that of few pairs they are broadcast and the rest of the
    payload is not shuffled.
    """
    def of(rows: DataFrame, name: str, as_: str) -> DataFrame:
        ids = materialize(pairs.select(F.col(name).alias("id")).distinct(), f"{name}-ids")
        return rows.join(ids, "id", "left_semi").select(
            F.col("id").alias(name), F.col(value).alias(as_))

    leaders = of(payload, "head", "a")
    return salted_join(pairs, leaders, ["head"], ["member"]).join(
        of(payload if members is None else members, "member", "b"), "member")
