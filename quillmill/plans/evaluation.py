"""All metrics of all models in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.judge import judge_summary
from quillmill.operators.metrics import (
    TAG, calibration_error, grounding_rates, presence_accuracy, reliability_bins, similarity_summary,
)


def evaluate(
    rows: DataFrame,
    judged_sentences: DataFrame,
    confidences: DataFrame,
    judge_scores: DataFrame | None = None,
) -> DataFrame:
    """One metric row per model of ``rows``.

    ``rows`` has one row per (model_tag, sample_id) with texts and similarity scores;
    the others hold sentence verdicts, (confidence, accurate) and parsed judge scores.
    The joined tables have one row per model.
    """
    models = rows.groupBy(TAG).agg(F.count(F.lit(1)).alias("n_test"))
    presence = (
        presence_accuracy(rows)
        .where(F.col("overall") == 1)
        .select(TAG, F.col("accuracy").alias("clause_presence_accuracy"))
    )
    parts = [
        similarity_summary(rows),
        presence,
        grounding_rates(judged_sentences, models),
        calibration_error(confidences).drop("n_samples"),
    ]
    if judge_scores is not None:
        parts.append(judge_summary(judge_scores))
    table = models
    for part in parts:
        table = table.join(part, TAG, "left")
    return table


def result_documents(
    table: DataFrame, rows: DataFrame, confidences: DataFrame
) -> DataFrame:
    """The metric rows of ``evaluate`` with what is nested in a result: per-class presence
    accuracy (``clause_accuracy_by_type``) and ``bin_stats``, non-empty bins in order.

    Both are bounded by the classes and bins of a model; predictions stay a table of their own.
    """
    by_class = (
        presence_accuracy(rows).where(F.col("overall") == 0).groupBy(TAG)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("clause_type", "accuracy")))).alias("clause_accuracy_by_type"))
    )
    bins = (
        reliability_bins(confidences).groupBy(TAG)
        .agg(F.sort_array(F.collect_list(F.struct(
            "bin_lower", "bin_upper", "accuracy", "confidence", "count"))).alias("bin_stats"))
    )
    return table.join(by_class, TAG, "left").join(bins, TAG, "left")
