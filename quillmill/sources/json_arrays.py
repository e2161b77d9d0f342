"""Files that hold one JSON array each, written per task and read in divisible pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.session import materialize


def write_array(df: DataFrame, path: str) -> None:
    """JSON files of one array each, one per task; a task without rows writes ``[]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            lines = []
            for row in batch.column("value").to_pylist():
                lines.append(before + row)
                before = ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(["[]" if before == "[" else "]"])], names=["value"])

    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    rows.mapInArrow(run, "value string").write.text(path)


def _opened(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return (F.length(F.regexp_replace(text, r"[^\[{]", ""))
            - F.length(F.regexp_replace(text, r"[^\]}]", ""))).cast("bigint")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, i, value, inside, depth): the text between two commas, in file order.

    ``inside`` says whether a piece begins within a string, ``depth`` how many brackets are
    open there. Spark cuts files at commas as it cuts lines, so any number of tasks read a
    file. A task cannot know whether it begins in a string; so each piece gives the parity
    of its quotes and its brackets for both cases, a block their sums, and the sums over the
    blocks of a file (a few per file) decide which case it is. No escape goes across a comma.
    """
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"), "value")
    plain = F.regexp_replace("value", r"\\.", "")
    string = r'"[^"]*+(?:"|\z)'
    marked = materialize(
        raw.withColumn("_plain", plain).select(
            "file", "block", "i", "value",
            (F.length(F.regexp_replace("_plain", '[^"]', "")) % 2).alias("odd"),
            _opened(F.regexp_replace("_plain", string, "")).alias("out"),
            _opened(F.regexp_replace(F.concat(F.lit('"'), F.col("_plain")), string, "")).alias("in"),
        ), "json-pieces")
    inside = Window.partitionBy("file", "block").orderBy("i")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    turned = marked.withColumn("flip", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumns({
        "if_out": F.when(F.col("flip") == 0, F.col("out")).otherwise(F.col("in")),
        "if_in": F.when(F.col("flip") == 0, F.col("in")).otherwise(F.col("out")),
    })
    local = turned.withColumns({
        f"depth_{c}": F.coalesce(F.sum(f"if_{c}").over(before), F.lit(0)) for c in ("out", "in")})
    sums = turned.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("odd"), F.sum("if_out").alias("o"), F.sum("if_in").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("begin", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn(
        "opened", F.when(F.col("begin") == 0, F.col("o")).otherwise(F.col("n"))
    ).withColumn("base", F.coalesce(F.sum("opened").over(earlier), F.lit(0))).select(
        "file", "block", "begin", "base")
    return local.join(starts, ["file", "block"]).select(
        "file", "block", "i", "value",
        ((F.col("flip") + F.col("begin")) % 2 == 1).alias("inside"),
        (F.col("base") + F.when(F.col("begin") == 0, F.col("depth_out")).otherwise(F.col("depth_in")))
        .alias("depth"))


def read_arrays(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of JSON files that each hold one array of objects, read by many tasks a file.

    An element begins where a piece begins outside strings with one bracket open; its pieces
    are joined again by their commas. Equal to reading each file whole (``multiLine``), for
    well-formed files; an element that does not fit the schema has NULLs. Empty arrays and
    blank files have no rows. Elements are shuffled once; the order of rows is not kept.
    """
    cut = pieces(spark, path).withColumn(
        "starts", ((~F.col("inside") & (F.col("depth") == 1)) | (F.col("depth") == 0)).cast("bigint"))
    # The number of elements begun: per block, then over the blocks of a file.
    cut = materialize(cut, "json-cut")
    upto = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("file", "block").agg(F.sum("starts").alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = cut.withColumn("n", F.sum("starts").over(upto)).join(counts, ["file", "block"]).select(
        "file", (F.col("n") + F.col("base")).alias("element"), "block", "i", "value")
    joined = numbered.groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("block", "i", "value"))).alias("x")
    ).select("file", "element", F.array_join(F.col("x.value"), ",").alias("text"))
    # The outer brackets belong to the first and to the last element of a file.
    last = numbered.groupBy("file").agg(F.max("element").alias("last"))
    text = F.when(F.col("element") == 1, F.regexp_replace("text", r"\A\s*\[", "")).otherwise(F.col("text"))
    ends = joined.join(last, "file").withColumn("text", text)
    bare = F.when(F.col("element") == F.col("last"), F.regexp_replace("text", r"\]\s*\z", "")).otherwise(
        F.col("text"))
    return ends.select(F.trim(bare).alias("text")).where(~F.col("text").rlike(r"\A\s*\z")).select(
        F.from_json("text", schema).alias("row")).select("row.*")
