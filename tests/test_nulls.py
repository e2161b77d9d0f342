"""Rows without a stratum are kept, and a failed write is not taken for a result."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions.draws import draw_key
from quillmill.operators import dedup, failures, sampling, scale
from quillmill.sources import io


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(100).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("c"), F.col("id") % 2)).alias("g"),
    )


def test_split_keeps_rows_without_a_stratum(rows):
    done = sampling.stratified_split(rows, "sample_id", "g")
    assert done.count() == 100 and done.columns == ["sample_id", "g", "split"]
    none = {r["split"]: r["count"] for r in done.where("g IS NULL").groupBy("split").count().collect()}
    assert none == {"test": 3, "val": 2, "train": 20}


def test_dense_index_numbers_rows_without_a_group(rows):
    keyed = rows.withColumn("k", draw_key(1, "x", F.col("sample_id")))
    got = scale.dense_index(keyed, ["g"], "k", "i").where("g IS NULL").collect()
    assert sorted(r["i"] for r in got) == list(range(25)) and {r["n"] for r in got} == {25}


def test_links_of_rows_without_a_stratum(spark):
    df = spark.createDataFrame(
        [(i, None if i < 4 else "s", "a b c d e f g h") for i in range(8)],
        "id long, s string, text string",
    )
    links = {r["id"]: r["kept_id"] for r in dedup.duplicate_links(df, "id", "s", "text").collect()}
    assert links == {1: 0, 2: 0, 3: 0, 5: 4, 6: 4, 7: 4}


def test_majority_with_text_ids(spark):
    df = spark.createDataFrame(
        [(1, "y", "B"), (1, "x", "A"), (2, "z", None)], "cluster_id int, sample_id string, clause_type string"
    )
    got = {r[0]: r[1] for r in failures.majority_class(df).collect()}
    assert got == {1: "A", 2: "Unknown"}


def test_failed_write_is_not_reused(spark, tmp_path):
    path = str(tmp_path / "result")
    bad = spark.range(10).select(F.when(F.col("id") > 5, F.raise_error(F.lit("no"))).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        io.reuse_or_compute(bad, path)
    assert io.reuse_or_compute(spark.range(10), path).count() == 10
    assert io.reuse_or_compute(spark.range(3), path).count() == 10
