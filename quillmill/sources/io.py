"""Readers and writers. Schemas are declared, never inferred."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.sources.versions import hadoop_file

QA_SCHEMA = (
    "sample_id BIGINT, context STRING, question STRING, answers STRUCT<text: ARRAY<STRING>>"
)
SPLITS = ["train", "val", "test"]


def read_table(
    spark: SparkSession, path: str, schema: str | T.StructType, spread: bool = False
) -> DataFrame:
    """Parquet with a declared schema, so that only named columns are read.

    ``spread`` deals a table of fewer files than cores over all cores; a table of many
    files is left as it is.
    """
    df = spark.read.schema(schema).parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, QA_SCHEMA)


def read_documents(
    spark: SparkSession, path: str, schema: str | T.StructType, whole_file: bool = False
) -> DataFrame:
    """JSON rows; ``whole_file`` reads one array per file, which cannot be divided."""
    return spark.read.schema(schema).json(path, multiLine=whole_file)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that a reader of one split opens only its files."""
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    return (
        spark.read.schema(f"{schema}, split STRING").parquet(path)
        .where(F.col("split") == split).drop("split")
    )


def training_export(df: DataFrame) -> DataFrame:
    """Only ``text``: a ``prompt`` column would change the mode of a trainer."""
    return df.select("text")


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(out))


def write_documents(df: DataFrame, path: str) -> None:
    df.write.json(path)


def reuse_or_compute(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` unless ``path`` holds a finished result, and return what is stored there.

    Only a result with its ``_SUCCESS`` marker counts; what a failed run left is replaced.
    """
    spark = df.sparkSession
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(
    spark: SparkSession, inputs: list[str], schema: T.StructType, parameters: dict
) -> str:
    """A digest of the input files (path, length, time of change), schema and parameters."""
    files = []
    for path in inputs:
        fs, top = hadoop_file(spark, path)
        found = fs.listFiles(top, True)
        while found.hasNext():
            status = found.next()
            name = status.getPath().toString()
            if not any(part.startswith((".", "_")) for part in name.split("/")[-1:]):
                files.append([name, status.getLen(), status.getModificationTime()])
    known = json.dumps([sorted(files), json.loads(schema.json()), parameters], sort_keys=True)
    return hashlib.sha256(known.encode()).hexdigest()


def reuse_result(
    spark: SparkSession, path: str, inputs: list[str], parameters: dict, schema: str | T.StructType,
    compute: Callable[[], DataFrame],
) -> DataFrame:
    """The stored result of these inputs and parameters, computed if there is none.

    Results lie in ``path/<fingerprint>``. A changed input, schema or parameter (values that
    JSON can hold) has another fingerprint, so a stale result is never returned. A result
    is written aside and renamed once complete; of two writers the later one drops its
    copy, and what a crashed one left is ignored.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    name = fingerprint(spark, inputs, schema, parameters)
    fs, done = hadoop_file(spark, f"{path}/{name}")
    if not fs.exists(done):
        aside = f"{path}/_writing-{uuid.uuid4().hex}"
        compute().write.parquet(aside)
        _, written = hadoop_file(spark, aside)
        if fs.exists(done) or not fs.rename(written, done):
            fs.delete(written, True)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def metric_rows(metrics: DataFrame, key: str, run: Column | None = None) -> DataFrame:
    """(key, metric, value): the numeric columns as rows, NULLs left out."""
    numeric = [
        f.name for f in metrics.schema
        if isinstance(f.dataType, T.NumericType) and f.name != key
    ]
    wide = metrics.select(key, *[F.col(c).cast("double") for c in numeric])
    rows = wide.unpivot([key], numeric, "metric", "value").where(F.col("value").isNotNull())
    return rows if run is None else rows.withColumn("run", run)


def append_metrics(metrics: DataFrame, key: str, path: str) -> None:
    metric_rows(metrics, key).write.mode("append").parquet(path)
