"""The curation chain: records to split, formatted samples and their card."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmill.functions import fixed
from quillmill.operators.curate import flatten_qa
from quillmill.operators.dedup import kept_ids
from quillmill.operators.perplexity import filter_by_perplexity
from quillmill.operators.prompts import format_as_instruction
from quillmill.operators.reports import dataset_card
from quillmill.operators.sampling import stratified_split
from quillmill.session import materialize, run_scope
from quillmill.sources.io import SPLITS
from quillmill.sources.versions import Versions


def curate(
    records: DataFrame,
    id_col: str = "sample_id",
    min_words: int = fixed.MIN_WORDS,
    max_words: int = fixed.MAX_WORDS,
    threshold: float = fixed.DEDUP_THRESHOLD,
) -> DataFrame:
    """Flatten, drop near-duplicates per class, drop perplexity outliers, format, split.

    The unigram table is that of the survivors of deduplication, so that step is first.
    The samples are written once, as each step reads them again; the steps hand on ids, by
    which the rows are picked from there. Ids of ``records`` are distinct.
    """
    samples = materialize(flatten_qa(records, id_col, min_words, max_words), "samples")
    kept = materialize(
        kept_ids(samples, id_col, "clause_type", "contract_text", threshold), "kept"
    )
    distinct = samples.join(kept, id_col, "left_semi")
    clean = materialize(
        filter_by_perplexity(distinct, id_col, "contract_text").select(id_col), "clean"
    )
    rows = format_as_instruction(samples.join(clean, id_col, "left_semi"))
    return stratified_split(rows, id_col, "clause_type")


def publish_curation(records: DataFrame, path: str, dataset: str, **options) -> str:
    """Curate ``records`` and publish the splits and their card below ``path``, together.

    Readers (``Versions(spark, path).read("train")``) see the last complete version: a run that
    fails leaves the one before. All intermediates belong to the run and are removed at its
    end, whether it fails or not. Returns the folder of the version.
    """
    spark = records.sparkSession
    with run_scope(spark):
        curated = materialize(curate(records, **options), "curated")
        parts = {s: curated.where(curated["split"] == s).drop("split") for s in SPLITS}
        return Versions(spark, path).publish({**parts, "card": dataset_card(curated, dataset)})
