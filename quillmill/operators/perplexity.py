"""Unigram perplexity of documents against their own corpus, and the percentile filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.text import words
from quillmill.operators.scale import MAX_HOT_KEYS, exact_percentiles
from quillmill.session import materialize

# Log-probabilities are summed as whole multiples of 1e-10 and perplexities are compared
# as whole multiples of 1e-4: whole-number sums do not depend on the order in which tasks
# finish, so a rerun or a retried task cannot move a row across the edge of the band.
LOG_UNITS = 10_000_000_000
PPL_UNITS = 10_000

VOCABULARY_ROWS = 200_000
VOCABULARY_CHARS = 8_000_000


def _tokens(text: Column) -> Column:
    return words(F.lower(text))


def unigram_table(df: DataFrame, text_col: str) -> DataFrame:
    """(token, count) over every text, short ones included."""
    return (
        df.select(F.explode(_tokens(F.col(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def log_probabilities(table: DataFrame) -> DataFrame:
    """Adds ``log_prob`` = ln(count / total + 1e-10)."""
    total = table.agg(F.sum("count").alias("total")).scalar()
    return table.withColumn("log_prob", F.log(F.col("count") / total + F.lit(fixed.PPL_FLOOR)))


def _units(log_prob: Column) -> Column:
    return F.round(log_prob * F.lit(LOG_UNITS)).cast("bigint")


def perplexities(
    df: DataFrame,
    id_col: str,
    text_col: str,
    table: DataFrame | None = None,
    vocabulary_rows: int = VOCABULARY_ROWS,
) -> DataFrame:
    """(id, n_tokens, ppl, ppl_key); ``ppl`` is infinite below ten words.

    ``ppl_key`` is the perplexity in units of 1e-4, NULL when infinite. A vocabulary
    whose size was measured to be small is broadcast and the texts are read once, without
    a token shuffle. A larger one is split: the tokens above a thousandth of the corpus
    (fewer than a thousand, so broadcast) are scored in place, and only the others, none
    of which is hot, are shuffled to the table.
    """
    vocabulary = materialize(
        log_probabilities(table if table is not None else unigram_table(df, text_col)),
        "unigrams",
    )
    scored = vocabulary.select("token", "count", _units(F.col("log_prob")).alias("units"))
    unknown = F.lit(round(math.log(fixed.PPL_FLOOR) * LOG_UNITS))
    size = vocabulary.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("token")).alias("chars")
    ).first()
    tokens = df.select(
        F.col(id_col).alias("_id"),
        F.explode_outer(_tokens(F.col(text_col))).alias("token"),
    )
    if size["rows"] <= vocabulary_rows and (size["chars"] or 0) <= VOCABULARY_CHARS:
        parts = tokens.join(F.broadcast(scored.drop("count")), "token", "left").select(
            "_id", "token", F.coalesce("units", unknown).alias("units")
        )
    else:
        total = vocabulary.agg(F.sum("count").alias("total")).scalar()
        is_hot = F.col("count") * MAX_HOT_KEYS > total
        hot = F.broadcast(scored.where(is_hot).drop("count"))
        seen_hot = tokens.join(hot, "token", "left")
        in_place = seen_hot.where(F.col("units").isNotNull() | F.col("token").isNull())
        rest = tokens.join(hot.drop("units"), "token", "left_anti").where(
            F.col("token").isNotNull()
        )
        looked_up = rest.join(scored.where(~is_hot).drop("count"), "token", "left")
        parts = in_place.select("_id", "token", "units").unionByName(
            looked_up.select("_id", "token", F.coalesce("units", unknown).alias("units"))
        )
    sums = parts.groupBy("_id").agg(
        F.count("token").alias("n_tokens"), F.sum("units").alias("units")
    )
    finite = F.col("n_tokens") >= fixed.PPL_MIN_WORDS
    raw = F.exp(-F.col("units") / (F.col("n_tokens") * F.lit(float(LOG_UNITS))))
    return sums.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        F.when(finite, F.round(raw * PPL_UNITS).cast("bigint")).alias("ppl_key"),
    ).select(
        id_col,
        "n_tokens",
        F.coalesce(F.col("ppl_key") / PPL_UNITS, F.lit(float("inf"))).alias("ppl"),
        "ppl_key",
    )


def perplexity_band(
    scored: DataFrame,
    low_percent: float = fixed.PPL_LOW_PERCENT,
    high_percent: float = fixed.PPL_HIGH_PERCENT,
) -> DataFrame:
    """One row (lo, hi): percentiles of the finite perplexities, NULL if there is none."""
    return exact_percentiles(
        scored, "ppl_key", {"lo": low_percent, "hi": high_percent}
    ).select((F.col("lo") / PPL_UNITS).alias("lo"), (F.col("hi") / PPL_UNITS).alias("hi"))


def flag_by_perplexity(
    scored: DataFrame,
    low_percent: float = fixed.PPL_LOW_PERCENT,
    high_percent: float = fixed.PPL_HIGH_PERCENT,
    min_rows: int = fixed.PPL_MIN_ROWS,
) -> DataFrame:
    """Adds ``kept``: inside the band, both ends included, or a corpus below ``min_rows``."""
    band = exact_percentiles(scored, "ppl_key", {"lo": low_percent, "hi": high_percent})
    limits = band.select(F.struct("lo", "hi").alias("band")).scalar()
    n = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    inside = F.col("ppl_key").between(F.col("_band.lo"), F.col("_band.hi"))
    return (
        scored.withColumn("_band", limits)
        .withColumn("kept", (n < min_rows) | F.coalesce(inside, F.lit(False)))
        .drop("_band")
    )


def filter_by_perplexity(
    df: DataFrame,
    id_col: str,
    text_col: str,
    low_percent: float = fixed.PPL_LOW_PERCENT,
    high_percent: float = fixed.PPL_HIGH_PERCENT,
) -> DataFrame:
    """Rows of ``df`` inside the perplexity band. A corpus without one finite value is dropped."""
    scored = materialize(perplexities(df, id_col, text_col), "perplexities")
    kept = flag_by_perplexity(scored, low_percent, high_percent).where("kept")
    return df.join(kept.select(id_col), id_col, "left_semi")


def perplexity_report(flagged: DataFrame, band: DataFrame) -> DataFrame:
    """One row: kept, total and the band."""
    counts = flagged.agg(
        F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("total")
    )
    limits = band.select(F.struct("lo", "hi").alias("band")).scalar()
    return counts.withColumn("_band", limits).select(
        "kept", "total", F.col("_band.lo").alias("lo"), F.col("_band.hi").alias("hi")
    )
