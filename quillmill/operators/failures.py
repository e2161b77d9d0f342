"""Failures of a model: selection, cluster labels, map and drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.functions.text import mentions, n_words, prefix, text_or_empty
from quillmill.operators.clustering import NOISE
from quillmill.session import materialize


def is_failure(score: Column, threshold: float = fixed.FAILURE_F1) -> Column:
    """Below the threshold; a missing score is no failure."""
    return F.coalesce(score, F.lit(1.0)) < threshold


def select_failures(
    rows: DataFrame, preview: DataFrame | None = None, score_col: str = "bertscore_f1"
) -> DataFrame:
    """Failures among ``rows``, or among ``preview`` if there are no rows at all."""
    source = rows
    if preview is not None:
        n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
        source = rows.unionByName(preview.where(n == 0))
    return source.where(is_failure(F.col(score_col)))


def error_patterns(prediction: Column, reference: Column) -> dict[str, Column]:
    return {
        "truncated": F.contains(text_or_empty(prediction), F.lit("[incomplete]")),
        "absent_error": mentions(prediction, "not found") & ~mentions(reference, "not found"),
        "too_long": n_words(prediction) > 2 * n_words(reference) + 10,
    }


def cluster_patterns(clustered: DataFrame) -> DataFrame:
    """Per cluster: size and the count of each error pattern."""
    patterns = error_patterns(F.col("prediction"), F.col("reference"))
    return clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("members"),
        *[F.count_if(flag).alias(name) for name, flag in patterns.items()],
    )


def majority_class(clustered: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(cluster_id, top_class): the most frequent class, the first seen among equals."""
    named = clustered.withColumn("clause_type", F.coalesce("clause_type", F.lit("Unknown")))
    per_class = named.groupBy("cluster_id", "clause_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")
    )
    return per_class.groupBy("cluster_id").agg(
        F.min_by("clause_type", F.struct(-F.col("n"), F.col("first"))).alias("top_class")
    )


def decide_pattern() -> Column:
    n = F.col("members")
    return (
        F.when(F.col("truncated") > n * 0.4, fixed.PATTERN_TRUNCATED)
        .when(F.col("absent_error") > n * 0.3, fixed.PATTERN_ABSENT)
        .when(F.col("too_long") > n * 0.3, fixed.PATTERN_LONG)
        .otherwise(fixed.PATTERN_OTHER)
    )


def label_clusters(clustered: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(cluster_id, cluster_name) from rows with prediction, reference and class."""
    stats = cluster_patterns(clustered).join(majority_class(clustered, id_col), "cluster_id")
    name = F.concat(
        F.col("top_class"), F.lit(" — "), decide_pattern(), F.lit(" ("),
        F.col("members").cast("string"), F.lit(" examples)"),
    )
    return stats.select(
        "cluster_id",
        F.when(F.col("cluster_id") == NOISE, fixed.NOISE_LABEL).otherwise(name)
        .alias("cluster_name"),
    )


def failure_points(
    clustered: DataFrame, labels: DataFrame, id_col: str = "sample_id",
    text_chars: int | None = fixed.MAP_TEXT_CHARS, min_failures: int = fixed.MIN_FAILURES,
) -> DataFrame:
    """The map's rows; texts are cut to ``text_chars``, None keeps them whole. Empty below
    ``min_failures`` failures."""
    def shown(text: str) -> Column:
        return F.col(text) if text_chars is None else prefix(F.col(text), text_chars)

    n = clustered.agg(F.count(F.lit(1)).alias("n")).scalar()
    # Written first, so that the planner broadcasts the labels only if they are small.
    names = materialize(labels, "cluster-labels")
    named = clustered.where(n >= min_failures).join(names, "cluster_id", "left")
    fallback = F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))
    return named.select(
        id_col,
        text_or_empty(F.col("clause_type")).alias("clause_type"),
        "cluster_id",
        F.coalesce("cluster_name", fallback).alias("cluster_name"),
        "x",
        "y",
        shown("prediction").alias("prediction"),
        shown("reference").alias("reference"),
    )


def failure_summary(points: DataFrame) -> DataFrame:
    """One row: failures and clusters, noise not counted as one."""
    return points.agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.count_distinct(F.when(F.col("cluster_id") != NOISE, F.col("cluster_id")))
        .alias("n_clusters"),
    )


def scale_map(points: DataFrame) -> DataFrame:
    """Adds ``px`` and ``py``: coordinates inside the drawing area, y pointing up."""
    limits = points.agg(
        F.struct(
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.min("y").alias("y0"), F.max("y").alias("y1"),
        ).alias("limits")
    ).scalar()

    def unit(value: str, low: str, high: str) -> Column:
        span = F.coalesce(F.nullif(F.col(high) - F.col(low), F.lit(0.0)), F.lit(1.0))
        return (F.col(value) - F.col(low)) / span

    width = fixed.MAP_WIDTH - 2 * fixed.MAP_MARGIN
    height = fixed.MAP_HEIGHT - 2 * fixed.MAP_MARGIN
    return (
        points.withColumn("_l", limits)
        .withColumn("px", fixed.MAP_MARGIN + unit("x", "_l.x0", "_l.x1") * width)
        .withColumn(
            "py",
            fixed.MAP_HEIGHT - fixed.MAP_MARGIN - unit("y", "_l.y0", "_l.y1") * height,
        )
        .drop("_l")
    )


def failures_of(points: DataFrame, cluster_id: int) -> DataFrame:
    return points.where(F.col("cluster_id") == cluster_id)
