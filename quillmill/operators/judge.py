"""Replies of an external judge: parsing and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.operators.metrics import TAG

# The parsers stop at the end of the first value. With a last element of our own behind
# the reply, anything between the reply's object and that element makes it invalid.
LAST = "$last"


def json_part(reply: Column) -> Column:
    """From the first { to the last }, NULL without such a span."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def whole_object(reply: Column) -> Column:
    """The reply's JSON span as a variant [object, last]; NULL unless it is one object."""
    parsed = F.try_parse_json(F.concat(F.lit("["), json_part(reply), F.lit(f',"{LAST}"]')))
    ends = F.try_variant_get(parsed, "$[1]", "string") == LAST
    return F.when(ends & F.try_variant_get(parsed, "$[2]", "variant").isNull(), parsed)


def parse_scores(replies: DataFrame, reply_col: str = "reply", default: float = 5.0) -> DataFrame:
    """Adds one score per dimension to the replies that hold a JSON object.

    A missing score is the default. A score that is not a number voids itself and the
    dimensions after it, in their fixed order; a reply whose first score is void is
    dropped.
    """
    parsed = replies.withColumn("_v", whole_object(F.col(reply_col))).where("_v IS NOT NULL")
    valid = F.lit(True)
    for name in fixed.JUDGE_DIMENSIONS:
        path = f"$[0].{name}"
        given = F.try_variant_get("_v", path, "variant").isNotNull()
        # A missing key is the default, a null or a text that is no number is void.
        score = F.when(
            given, F.try_variant_get("_v", path, "string").try_cast("double")
        ).otherwise(F.lit(default))
        valid = valid & score.isNotNull()
        parsed = parsed.withColumn(name, F.when(valid, score))
    first = fixed.JUDGE_DIMENSIONS[0]
    return parsed.where(F.col(first).isNotNull()).drop("_v")


def judge_summary(scores: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Per model: mean of each dimension on a scale of 0 to 1, three decimals, and the count."""
    summary = scores.groupBy(TAG).agg(
        *[F.bround(F.avg(d) / 10, 3).alias(f"geval_{d}") for d in fixed.JUDGE_DIMENSIONS],
        F.count(F.lit(1)).alias("geval_samples"),
    )
    if models is None:
        return summary
    return models.select(TAG).distinct().join(summary, TAG, "left")


def parse_pair_scores(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Scores of output A (``base_``) and B (``tuned_``) and their means; missing is 0.

    Replies without JSON are dropped; a text that is no number gives NULL.
    """
    out = replies.withColumn("_v", whole_object(F.col(reply_col))).where("_v IS NOT NULL")
    for side, prefix in (("A", "base"), ("B", "tuned")):
        scores = []
        for name in fixed.JUDGE_DIMENSIONS:
            raw = F.try_variant_get("_v", f"$[0].{side}.{name}", "string")
            score = F.when(raw.isNull(), F.lit(0.0)).otherwise(raw.try_cast("double"))
            out = out.withColumn(f"{prefix}_{name}", score)
            scores.append(F.col(f"{prefix}_{name}"))
        out = out.withColumn(f"{prefix}_mean", sum(scores[1:], scores[0]) / len(scores))
    return out.drop("_v")
