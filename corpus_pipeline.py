"""Documents to training shards: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.cascade import cascade
from quillmill.llm.common import table
from quillmill.llm.decontaminate import decontaminate
from quillmill.llm.mixing import temperature_mix
from quillmill.llm.probminhash import drop_near_duplicates
from quillmill.llm.sharding import shard_by_bytes
from quillmill.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return cascade(docs).where("kept").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: that of the smallest doc_id."""
    return drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    marked = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.where("NOT contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice: a row per copy."""
    return temperature_mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, with its other columns but the text."""
    return shard_by_bytes(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Signatures, rule cascades and automata have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
