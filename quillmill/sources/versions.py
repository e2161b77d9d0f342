"""Results in versions: complete or not there, on any file system that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hadoop_file(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


class Versions:
    """Folders below ``path/data``, in the order in which they were committed.

    A folder counts once the file of its version names it. The file is only created if there
    is none, so of two writers one wins. Folders that no version names are ignored. A
    version file without a name is that of a writer that stopped in between: an error, as
    it may still be at work.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, name: str) -> str:
        return f"{self.path}/data/{name}"

    def names(self) -> list[str]:
        """The committed folders, oldest first."""
        fs, folder = hadoop_file(self.spark, f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        files = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        rows = self.spark.read.text(f"{self.path}/versions").select(
            F.input_file_name().alias("file"), "value").collect()
        named = {r["file"].rsplit("/", 1)[1]: r["value"] for r in rows}
        if set(named) != set(files):
            raise RuntimeError(f"unfinished version in {self.path}: {set(files) - set(named)}")
        return [named[f] for f in files]

    def commit(self, version: int, folder: str) -> bool:
        """Whether ``folder`` became this version; False if another one did before."""
        fs, path = hadoop_file(self.spark, f"{self.path}/versions/{version:08d}")
        if fs.exists(path):
            return False
        try:
            out = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        out.write(bytearray(folder, "utf-8"))
        out.close()
        return True

    def publish(self, parts: dict[str, DataFrame]) -> str:
        """Write all ``parts`` and make them the newest version together."""
        folder = uuid.uuid4().hex
        try:
            for name, df in parts.items():
                df.write.parquet(f"{self.folder(folder)}/{name}")
        except Exception:
            self.discard(folder)
            raise
        while not self.commit(len(self.names()), folder):
            pass  # another version came first; parts do not depend on it
        return folder

    def discard(self, folder: str) -> None:
        fs, path = hadoop_file(self.spark, self.folder(folder))
        fs.delete(path, True)

    def read(self, name: str, folder: str | None = None) -> DataFrame:
        """A part of ``folder``, by default of the newest version."""
        if folder is None:
            done = self.names()
            if not done:
                raise FileNotFoundError(f"nothing is published in {self.path}")
            folder = done[-1]
        return self.spark.read.parquet(f"{self.folder(folder)}/{name}")
