"""Splits and samples that do not depend on partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.draws import draw_key
from quillmill.operators.scale import key_cuts, null_safe_key, running_sum, salted_join
from quillmill.session import materialize


def stratified_split(
    df: DataFrame,
    id_col: str,
    stratum: str,
    val_size: float = fixed.VAL_SIZE,
    test_size: float = fixed.TEST_SIZE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Adds ``split``: per stratum, max(1, int(n * size)) rows to test, then to val, rest train.

    Only (stratum, key) is shuffled, to find the two key values at which a stratum is
    cut. The cuts, one row per stratum, are written, so the planner knows their size and
    leaves the rows where they are if it is small. Rows without a stratum are one of their own.
    """
    keyed = df.withColumn("_key", draw_key(seed, "split", F.col(id_col))).withColumn(
        "_code", null_safe_key(stratum)
    )
    n_test = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(test_size)))
    n_val = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(val_size)))
    cuts = materialize(
        key_cuts(
            keyed.select(stratum, "_key"),
            [stratum],
            "_key",
            {"_test": n_test - 1, "_val": n_test + n_val - 1},
        ).select(null_safe_key(stratum).alias("_code"), "_test", "_val"),
        "split-cuts",
    )
    placed = keyed.join(cuts, "_code")
    # No val cut: the stratum ends inside val, so what is not test is val.
    split = (
        F.when(F.col("_key") <= F.col("_test"), "test")
        .when(F.col("_val").isNull() | (F.col("_key") <= F.col("_val")), "val")
        .otherwise("train")
    )
    return placed.withColumn("split", split).drop("_key", "_code", "_test", "_val")


def leak_free_split(
    df: DataFrame,
    id_col: str,
    stratum: str,
    component: str,
    val_size: float = fixed.VAL_SIZE,
    test_size: float = fixed.TEST_SIZE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Adds ``split`` so that no ``component`` (rows that resemble each other) is in two splits.

    The quotas per stratum are those of ``stratified_split``. Components count for the
    stratum of their row of smallest id and are taken in the order of their draw: to test
    while it holds fewer rows than its quota, then to val. One that is larger than the
    quota of val or of test goes to train at once. So test, and val, exceed the quota by
    less than one component, and fall short only if a stratum lacks small ones. Only one
    row per component is sorted. A NULL component stands for the row alone.
    """
    code = F.coalesce(
        F.concat(F.lit("c"), F.col(component).cast("string")),
        F.concat(F.lit("r"), F.col(id_col).cast("string")), F.lit("-"))
    keyed = df.withColumn("_unit", code)
    units = materialize(
        keyed.groupBy("_unit").agg(
            F.count(F.lit(1)).alias("_size"),
            F.min(F.struct(F.col(id_col).alias("i"), F.col(stratum).alias("s")))["s"].alias("_stratum"))
        .withColumn("_key", draw_key(seed, "unit", F.col("_unit"))), "split-units")
    sizes = units.groupBy("_stratum").agg(F.sum("_size").alias("n"))
    quota = sizes.select(
        null_safe_key("_stratum").alias("_code"),
        F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(test_size))).alias("_test"),
        F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(val_size))).alias("_val"))
    placed = salted_join(
        materialize(units.withColumn("_code", null_safe_key("_stratum")), "split-coded"), quota,
        ["_code"], ["_key"])
    fits = F.col("_size") <= F.least("_test", "_val")
    small = running_sum(placed.where(fits), ["_stratum"], "_key", "_size", "_at")
    # The unit that fills test may run over; val is filled from there.
    filled = small.where(F.col("_at") >= F.col("_test")).groupBy("_code").agg(
        F.min("_at").alias("_from"))
    chosen = small.drop("total").join(filled, "_code", "left").select("_unit", F.when(
        F.col("_at") < F.col("_test"), "test"
    ).when(F.col("_at") < F.col("_from") + F.col("_val"), "val").otherwise("train").alias("split"))
    decided = materialize(
        placed.where(~fits).select("_unit", F.lit("train").alias("split")).unionByName(chosen),
        "split-decided")
    return salted_join(keyed, decided, ["_unit"], [id_col]).drop("_unit")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = fixed.SEED) -> DataFrame:
    """``n`` rows drawn without replacement, the same ones for the same ids.

    The n-th smallest key is found on the keys alone, so no task gathers the rows. Rows that
    share an id, and so a key, are drawn together.
    """
    if n <= 0:
        return df.limit(0)
    keyed = df.withColumn("_key", draw_key(seed, "sample", F.col(id_col)))
    keys = keyed.select(F.lit(0).alias("_all"), "_key")
    last = key_cuts(keys, ["_all"], "_key", {"_last": F.lit(n - 1)}).select("_last").scalar()
    # No n-th key: there are fewer rows than that, so all of them are the sample.
    return keyed.where(last.isNull() | (F.col("_key") <= last)).drop("_key")


def first_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest id.

    Only ids are sorted, ``n`` per task; the rows stay where they are. Rows that share an id,
    NULL too, count one by one: of those of the last id as many are taken as are missing.
    """
    first = df.select(F.struct(id_col).alias("k")).orderBy("k").limit(n)
    last = first.agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n"))
    ends = first.join(F.broadcast(last.select("k")), "k").agg(F.count(F.lit(1))).first()[0]
    edge = last.select("k").scalar()
    below, at = df.where(F.struct(id_col) < edge), df.where(F.struct(id_col) == edge)
    return below.unionByName(at.limit(ends))


def recombine(parts: dict[str, DataFrame]) -> DataFrame:
    """Splits back to one table with a ``split`` column."""
    return reduce(
        DataFrame.unionByName,
        [part.withColumn("split", F.lit(name)) for name, part in parts.items()],
    )
