"""The failures of a model as one labelled map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.operators.clustering import NOISE, density_clusters, project_2d
from quillmill.operators.failures import failure_points, label_clusters, select_failures
from quillmill.operators.hierarchy import hierarchical_clusters
from quillmill.session import materialize


def failure_map(
    rows: DataFrame,
    vectors: DataFrame,
    eps: float | None = None,
    id_col: str = "sample_id",
    vector_col: str = "embedding",
    min_size: int | None = None,
    text_chars: int | None = fixed.MAP_TEXT_CHARS,
    min_failures: int = fixed.MIN_FAILURES,
) -> DataFrame:
    """Select the failures of ``rows``, cluster their ``vectors``, label and place them.

    ``rows`` holds one model: id, clause_type, prediction, reference, bertscore_f1; ``vectors``
    has a vector per id. A failure without a vector stays in the map, as noise and without
    a position. Empty below ``min_failures`` failures; with fewer vectors than that, nothing
    is projected. Without a radius ``eps`` the clusters are the most stable ones at any
    density. Only ids and vectors go through the clustering; the texts join at the end.
    """
    failed = materialize(
        select_failures(rows).select(id_col, "clause_type", "prediction", "reference"), "failures"
    )
    known = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    placed = materialize(known.join(failed.select(id_col), id_col, "left_semi"), "failure-vectors")
    if placed.limit(min_failures).count() < min_failures:
        clustered = failed.select(
            "*", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"),
            F.lit(NOISE).cast("bigint").alias("cluster_id"),
        )
    else:
        flat = project_2d(placed, id_col, vector_col)
        groups = (
            hierarchical_clusters(placed, id_col, vector_col, min_size) if eps is None
            else density_clusters(placed, id_col, vector_col, eps, min_size)
        )
        clustered = failed.join(flat, id_col, "left").join(groups, id_col, "left").fillna(
            NOISE, ["cluster_id"]
        )
    clustered = materialize(clustered, "failure-clusters")
    labels = label_clusters(clustered, id_col)
    return failure_points(clustered, labels, id_col, text_chars, min_failures)
