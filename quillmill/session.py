"""Session helpers: local session for tests, shared scratch space for cut lineage."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="quillmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("quillmill_run", default=None)


@contextlib.contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """A run that owns what it writes: all intermediates of the block, removed at its end.

    DataFrames made inside read those files, so their results must be written (or
    collected) before the block ends. A run inside a run is part of the outer one.
    """
    if _RUN.get():
        yield _RUN.get()
        return
    folder = f"{shared_dir(spark)}/quillmill/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never used path below the shared folder, or that of the run (``run_scope``)."""
    folder = _RUN.get() or f"{shared_dir(spark)}/quillmill"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Spark then removes the shuffle files of a query when it ends, not when the driver collects garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, prunes columns on
    every later read, and gives the planner the true size, so that whether a later
    join may broadcast is decided by a measured number. Nothing reads the shuffle files of the
    write again, so they go at its end, and a loop needs the disk of one round.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``kept``, which nothing may read any more."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
