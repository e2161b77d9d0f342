"""Preference pairs of a curated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.preference import preference_pairs
from quillmill.session import materialize
from quillmill.sources.versions import Versions


def validation_pairs(curated: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Pairs from the validation rows of ``curated`` alone, wrong-class answers too.

    So no answer of the training split comes up as a rejected one. The split is written
    once, as pairing reads it several times.
    """
    held = curated.where(F.col("split") == "val").select(id_col, "clause_type", "prompt", "answer")
    return preference_pairs(materialize(held, "validation"), id_col)


def published_pairs(spark: SparkSession, path: str, id_col: str = "sample_id") -> DataFrame:
    """Pairs from the validation split of the newest version that curation published."""
    return preference_pairs(Versions(spark, path).read("val"), id_col)
