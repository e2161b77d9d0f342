"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import numbered, whole_text, without

ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text, ...) to one of ``n_shards`` shards.

    Rows are ordered by (doc_id, CRC-32, size). The bytes before each row come from totals
    per range of that order plus the running sum inside the range; a row belongs to the
    shard in which its middle byte falls when all bytes are cut at equal targets. Shards
    are contiguous in that order and differ from the target by less than one row at each
    end. ``slot`` numbers the rows of a shard without gaps. Sizes are UTF-8 bytes plus
    ``overhead``.

    Every row is kept, repeated ones too. A NULL text has no bytes, a NULL doc_id comes
    first, rows that agree in all three keys are interchangeable. A row larger than the
    target leaves the shards that it spans without rows. An empty table gives no rows.
    Other columns are passed on, without the text: an assignment, not a copy of the corpus.
    """
    clean = without(docs, ADDED)
    data = F.encode(whole_text(), "UTF-8")
    rows = clean.select(
        *[c for c in clean.columns if c.lower() != "text"],
        (F.octet_length(data) + overhead).cast("bigint").alias("size"),
        F.crc32(data).cast("bigint").alias("text_crc32"),
    )
    placed = numbered(rows, [], ["doc_id", "text_crc32", "size"], ["size"], "shard-rows")
    middle = (F.col("__before_size") * 2 + F.col("size")).cast("decimal(20,0)") * n_shards
    sharded = placed.withColumn(
        "shard",
        F.least(
            F.floor(middle / (F.col("__total_size") * 2)).cast("int"), F.lit(n_shards - 1)
        ),
    )
    # One row per shard: the number of rows before its first one.
    first = F.broadcast(sharded.groupBy("shard").agg(F.min("__idx").alias("__first")))
    return sharded.join(first, "shard").select(
        *rows.columns,
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__idx") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
