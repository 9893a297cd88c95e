"""The shared folder for intermediate tables, checkpoints and stream sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one, but in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operation: written to the shared folder, and deleted when the block ends, but for results.

    A result is a table of its own folder; it stays until its caller passes it
    to :func:`delete`, or the shared folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)

    def write(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back, which cuts its lineage."""
        self.count += 1
        return self._put(df, f"{self.path}/{self.count}")

    def result(self, df: DataFrame) -> DataFrame:
        """The same, for what outlives the block."""
        return self._put(df, f"{self.path}-result")

    def _put(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at = path
        return out


#: Largest table that is broadcast, by its rows times their size; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20


def small(rows: int, row_bytes: int) -> bool:
    """Whether a table of so many rows of at most ``row_bytes`` may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES
