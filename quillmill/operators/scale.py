"""Building blocks that keep hot keys and large groups off single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import materialize

MAX_HOT_KEYS = 1000
MIN_HOT_ROWS = 10_000


def heavy_keys(
    df: DataFrame,
    keys: list[str],
    total: int,
    max_keys: int = MAX_HOT_KEYS,
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Keys that hold more than one ``max_keys``-th of the ``total`` rows, with a salt count.

    Fewer than ``max_keys`` keys can pass that test, so the result may be broadcast
    whatever the size of ``df``. ``salts`` is the number of fair shares a key holds.
    """
    share = F.col("rows") * max_keys / F.lit(float(total))
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where((F.col("rows") >= min_rows) & (share > 1))
        .select(*keys, F.ceil(share).cast("int").alias("salts"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    salt_by: list[str],
    how: str = "inner",
    max_keys: int = MAX_HOT_KEYS,
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Equi-join of a skewed ``left`` with a ``right`` that has few rows per key.

    Hot keys of ``left`` are spread over salts taken from the row's own columns (so a
    retried task salts alike), and only those rows of ``right`` are repeated per salt.
    ``how`` is inner, left, left_semi or left_anti. The keys of ``left`` are counted
    first, so it should be stored rather than expensive to compute; without a hot key
    this is a plain join.
    """
    total = left.count()
    if total < min_rows:
        return left.join(right, keys, how)
    hot = materialize(heavy_keys(left, keys, total, max_keys, min_rows), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = hot.withColumnRenamed("salts", "_salts")  # either side may have a column "salts"
    salt = F.pmod(F.xxhash64(*salt_by), F.col("_salts")).cast("int")
    spread = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .drop("_salts")
    )
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    copies = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_salts")
    )
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def null_safe_key(*columns: str) -> Column:
    """One text per distinct tuple of values, NULLs included, so that equality joins keep them."""
    if len(columns) == 1:
        return F.coalesce(F.concat(F.lit("="), F.col(columns[0]).cast("string")), F.lit("-"))
    return F.to_json(F.struct(*[F.col(c).cast("string") for c in columns]))


def key_cuts(
    df: DataFrame,
    group: list[str],
    key: str,
    ranks: dict[str, Column],
    digits: int = 3,
) -> DataFrame:
    """Per group, the value of hexadecimal ``key`` at given zero-based ranks.

    ``ranks`` maps an output column to an expression over ``n`` (rows of the group).
    Rows are counted per leading digits of the key; only the bucket that holds a rank is
    then sorted, so a group of any size is never sorted in one task. A rank at or past
    ``n`` gives NULL. One row per group.
    """
    bucketed = df.select(
        null_safe_key(*group).alias("_code"), *group, key,
        F.substring(key, 1, digits).alias("_bucket"),
    )
    hist = bucketed.groupBy("_code", *group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # 16^digits rows per group at most.
    whole = Window.partitionBy("_code")
    offsets = hist.select(
        "*",
        F.sum("_rows").over(whole).alias("n"),
        (F.sum("_rows").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_rows")).alias("_before"),
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
        for name, rank in ranks.items()
    ])).alias("_want")
    targets = offsets.select("_code", "_bucket", "_rows", "_before", wanted).select(
        "_code", "_bucket", "_rows", "_before", "_want.name", "_want.rank"
    )
    edges = targets.where(
        (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_rows"))
    )
    ordered = Window.partitionBy("_code", "_bucket", "name").orderBy(key)
    hits = (
        bucketed.join(edges, ["_code", "_bucket"])
        .withColumn("_at", F.col("_before") + F.row_number().over(ordered) - 1)
        .where(F.col("_at") == F.col("rank"))
    )
    sizes = offsets.groupBy("_code", *group).agg(F.max("n").alias("n"))
    cuts = hits.groupBy("_code").agg(
        *[F.max(F.when(F.col("name") == name, F.col(key))).alias(name) for name in ranks]
    )
    return sizes.join(cuts, "_code", "left").drop("_code")


def dense_index(
    df: DataFrame, group: list[str], key: str, out: str, digits: int = 3
) -> DataFrame:
    """Number the rows of every group 0 .. n-1 in the order of hexadecimal ``key``.

    Adds ``out`` and ``n``. The sort runs per (group, leading digits of the key), so one
    large group is shared by up to 16^digits tasks.
    """
    bucketed = df.withColumn("_bucket", F.substring(key, 1, digits)).withColumn(
        "_code", null_safe_key(*group)
    )
    hist = bucketed.groupBy("_code", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_code")
    offsets = hist.select(
        "_code",
        "_bucket",
        F.sum("_rows").over(whole).alias("n"),
        (F.sum("_rows").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_rows")).alias("_before"),
    )
    ordered = Window.partitionBy("_code", "_bucket").orderBy(key)
    return (
        bucketed.join(offsets, ["_code", "_bucket"])
        .withColumn(out, F.col("_before") + F.row_number().over(ordered) - 1)
        .drop("_code", "_bucket", "_before")
    )


def running_sum(
    df: DataFrame, group: list[str], key: str, value: str, out: str, digits: int = 3
) -> DataFrame:
    """Add ``out``, the sum of whole-number ``value`` over the earlier rows of the group.

    Rows go by hexadecimal ``key``, which no two rows of a group share. ``total`` is that of
    the group. As in ``dense_index``, the sort runs per leading digits of the key.
    """
    bucketed = df.withColumn("__bucket", F.substring(key, 1, digits)).withColumn(
        "__code", null_safe_key(*group))
    hist = bucketed.groupBy("__code", "__bucket").agg(F.sum(value).alias("__sum"))
    whole = Window.partitionBy("__code")
    upto = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = hist.select(
        "__code", "__bucket", F.sum("__sum").over(whole).alias("total"),
        (F.sum("__sum").over(upto) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy("__code", "__bucket").orderBy(key).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        bucketed.join(offsets, ["__code", "__bucket"])
        .withColumn(out, F.col("__before") + F.sum(value).over(inside) - F.col(value))
        .drop("__code", "__bucket", "__before")
    )


def exact_percentiles(df: DataFrame, value: str, percents: dict[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated percentiles of whole numbers >= 0.

    ``percents`` maps an output column to a percentage. Values are counted per distinct
    value, then per logarithmic band of values (at most 16,384 bands for 64 bits); only
    the bands that hold a wanted rank are sorted. No state grows with the table, unlike
    the built-in aggregate. All columns are NULL for an empty input.
    """
    freq = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("bigint").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("band", F.floor(F.log2(F.col("v").cast("double") + 1) * 256))
    )
    bands = freq.groupBy("band").agg(F.sum("c").alias("rows"))
    # At most 16,384 rows, so a window without partitions is safe here.
    upto = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    offsets = bands.select(
        "band",
        "rows",
        F.sum("rows").over(Window.partitionBy()).alias("n"),
        (F.sum("rows").over(upto) - F.col("rows")).alias("before"),
    )
    position = {name: (F.col("n") - 1) * (p / 100.0) for name, p in percents.items()}
    low = {name: F.floor(h).cast("bigint") for name, h in position.items()}
    high = {
        name: F.least(low[name] + 1, F.col("n") - 1).cast("bigint") for name in percents
    }
    wanted = [*low.values(), *high.values()]
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("rows")))
    edges = offsets.where(holds)  # at most two bands per percentile
    inside = Window.partitionBy("band").orderBy("v")
    ranked = (
        freq.join(F.broadcast(edges.select("band", "n", "before")), "band")
        .withColumn("last", F.col("before") + F.sum("c").over(inside) - 1)
        .withColumn("first", F.col("last") - F.col("c") + 1)
    )
    picks = []
    for name in percents:
        for part, rank in (("lo", low[name]), ("hi", high[name])):
            picks.append(
                F.max(F.when((rank >= F.col("first")) & (rank <= F.col("last")), F.col("v")))
                .alias(f"{name}_{part}")
            )
    row = ranked.agg(F.max("n").alias("n"), *picks)
    return row.select(*[
        (F.col(f"{name}_lo")
         + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (position[name] - F.floor(position[name]))
         ).cast("double").alias(name)
        for name in percents
    ])
