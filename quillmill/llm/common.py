"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.session import materialize

#: The separators of the words that quality rules, shingles and token counts use.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that clash with ``names`` or start with two underscores.

    The operators add columns of fixed names and use helper columns ``__x``; a column of
    the input of such a name is replaced, never mixed up with them.
    """
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken or c.startswith("__")])


def whole_text(name: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``, without building more than one array."""
    pieces = F.split(text, r"[\x20\x09-\x0D]+", -1)
    first_empty = (F.get(pieces, F.lit(0)) == "").cast("bigint")
    last_empty = ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("bigint")
    return F.size(pieces).cast("bigint") - first_empty - last_empty


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(
    df: DataFrame, group: list[str], order: list[str], sums: list[str], name: str
) -> DataFrame:
    """Number the rows of every group and add exact running totals, without a global sort task.

    Adds ``__idx`` (0, 1, ... in ``order`` within the group), ``__before_<x>`` (sum of x over
    the earlier rows of the group) for every x in ``sums``, and, for an empty ``group``,
    ``__total_<x>``. The rows are dealt by ranges of (group, order) and written once with
    the number of their range; totals per range are summed over the ranges of a group, and
    only the rest is numbered inside a range. A group or a crowd of ties of any size is so
    spread over as many ranges as it fills. Only the first group of a range can have begun
    in an earlier one, so the offsets are at most one row per range: small by construction.
    Equal rows are interchangeable; NULL keys form a group of their own.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__uid", F.monotonically_increasing_id())
    by = [F.col(c) for c in [*group, *order, "__uid"]]
    dealt = materialize(
        keyed.repartitionByRange(shuffle_tasks(spark), *by)
        .withColumn("__part", F.spark_partition_id()),
        name,
    )
    totals = dealt.groupBy("__part", *group).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(x).alias(f"__sum_{x}") for x in sums]
    )
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy()
    offsets = totals.select(
        "__part", *group,
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before"),
        *[F.coalesce(F.sum(f"__sum_{x}").over(earlier), F.lit(0)).alias(f"__off_{x}")
          for x in sums],
        *([] if group else
          [F.sum(f"__sum_{x}").over(whole).alias(f"__total_{x}") for x in sums]),
    )
    if group:
        offsets = offsets.where(F.col("__rows_before") > 0)
    offsets = offsets.select(
        F.col("__part").alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        *offsets.columns[1 + len(group):],
    )
    inside = Window.partitionBy("__part", *group).orderBy(*order, "__uid")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        "*", (F.row_number().over(inside) - 1).alias("__i"),
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"__b_{x}") for x in sums],
    )
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(F.broadcast(offsets), same, "left")
    return joined.select(
        *df.columns,
        (F.col("__i") + F.coalesce("__rows_before", F.lit(0))).cast("bigint").alias("__idx"),
        *[(F.col(f"__b_{x}") + F.coalesce(f"__off_{x}", F.lit(0))).alias(f"__before_{x}")
          for x in sums],
        *([] if group else [f"__total_{x}" for x in sums]),
    )
