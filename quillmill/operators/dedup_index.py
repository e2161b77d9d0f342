"""A stored index of kept rows, against which later batches are checked and which they extend."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import fixed
from quillmill.operators import dedup
from quillmill.operators.scale import null_safe_key, salted_join
from quillmill.session import materialize
from quillmill.sources.versions import Versions


def _table(index: Versions, name: str, versions: list[str]) -> DataFrame | None:
    paths = [f"{index.folder(v)}/{name}" for v in versions]
    return index.spark.read.parquet(*paths) if paths else None


def check_batch(
    index: Versions, versions: list[str], batch: DataFrame, id_col: str, stratum: str, text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept rows of a batch: (id), their sets and their blocks.

    A row that resembles a row of the index goes; then the first rows among the rest stay, as
    in ``dedup.kept_ids``. Only the index is read, never the texts it came from, and only
    blocks that the batch shares are compared.
    """
    keyed = dedup.token_sets(batch, id_col, stratum, text_col)
    firsts = keyed.groupBy("stratum", "set_key").agg(F.min("id").alias("id")).select("id")
    sets = materialize(
        keyed.join(materialize(firsts, "firsts"), "id", "left_semi")
        .withColumn("code", null_safe_key("stratum")), "sets")
    blocks = materialize(dedup.part_blocks(sets, threshold).select("id", "size", "block"), "blocks")
    old_sets, old_blocks = _table(index, "sets", versions), _table(index, "blocks", versions)
    if old_sets is not None:
        same = sets.join(old_sets.select("code", "set_key"), ["code", "set_key"], "left_semi").select("id")
        near = dedup.links_to_kept(
            blocks.join(same, "id", "left_anti"), dedup.word_sets(sets),
            old_blocks, dedup.word_sets(old_sets), threshold)
        lost = materialize(same.unionByName(near.select(F.col("member").alias("id"))).distinct(), "lost")
        sets = materialize(sets.join(lost, "id", "left_anti").select(sets.columns), "sets")
        blocks = materialize(blocks.join(lost, "id", "left_anti").select(blocks.columns), "blocks")
    rounds = dedup.drop_similar(blocks, sets, threshold)
    if rounds:
        dropped = materialize(reduce(DataFrame.unionByName, rounds), "dropped")
        sets, blocks = (x.join(dropped, "id", "left_anti").select(x.columns) for x in (sets, blocks))
    return sets.select("id"), sets, blocks


def append_batch(
    path: str, batch: DataFrame, id_col: str, stratum: str, text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD,
) -> DataFrame:
    """Check a batch against the index at ``path``, add its kept rows, return their ids.

    Batches one after another keep what one pass over all of them in that order would: ids
    count inside a batch, and a batch comes after all earlier ones. Every batch must use the
    same threshold. If another batch is committed meanwhile, this one is checked again.
    """
    index = Versions(batch.sparkSession, path)
    while True:
        versions = index.names()
        _, sets, blocks = check_batch(index, versions, batch, id_col, stratum, text_col, threshold)
        folder = uuid.uuid4().hex
        sets.write.parquet(f"{index.folder(folder)}/sets")
        blocks.write.parquet(f"{index.folder(folder)}/blocks")
        if index.commit(len(versions), folder):
            return index.read("sets", folder).select(F.col("id").alias(id_col))
        index.discard(folder)


def kept_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, stratum, tokens, set_key, code) of all kept rows of the index at ``path``."""
    index = Versions(spark, path)
    return _table(index, "sets", index.names())


def resembled(
    path: str, rows: DataFrame, id_col: str, stratum: str, text_col: str,
    threshold: float = fixed.DEDUP_THRESHOLD,
) -> DataFrame:
    """(id, kept_id, similarity): for rows that resemble the index, the kept row of smallest id."""
    index = Versions(rows.sparkSession, path)
    versions = index.names()
    keyed = materialize(dedup.token_sets(rows, id_col, stratum, text_col), "rows")
    nothing = keyed.limit(0).select(
        F.col("id").alias(id_col), F.col("id").alias("kept_id"), F.lit(1.0).alias("similarity"))
    if not versions:
        return nothing
    old = _table(index, "sets", versions)
    blocks = materialize(dedup.part_blocks(keyed, threshold).select("id", "size", "block"), "blocks")
    near = dedup.links_to_kept(
        blocks, dedup.word_sets(keyed), _table(index, "blocks", versions), dedup.word_sets(old), threshold)
    coded = materialize(keyed.select("id", null_safe_key("stratum").alias("code"), "set_key"), "codes")
    same = salted_join(
        coded, old.groupBy("code", "set_key").agg(F.min("id").alias("head")), ["code", "set_key"], ["id"],
    ).select(F.col("id").alias("member"), "head", F.lit(1.0).alias("similarity"))
    best = near.unionByName(same).groupBy("member").agg(F.min(F.struct("head", "similarity")).alias("x"))
    return best.select(F.col("member").alias(id_col), F.col("x.head").alias("kept_id"), "x.similarity")
