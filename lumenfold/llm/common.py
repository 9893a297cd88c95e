"""Shared helpers: scratch tables in the cluster's shared folder, and words."""

from __future__ import annotations

import contextlib
import json
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.storage import new_path

#: Characters that separate words, as a Java and RE2 character class body.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Paths of the tables that :func:`stored` wrote in the innermost :class:`Scope`, or outside all of them, and nothing has deleted yet. Threads have their own.
_TABLES: ContextVar[set[str]] = ContextVar("lumenfold-tables")

#: Largest table that is broadcast, by its rows times their size; beyond it joins shuffle.
MAX_BROADCAST_BYTES = 32 << 20
#: Largest Arrow batch sent to a Python worker, unless one row is larger.
BATCH_BYTES = 2 << 20
#: Row group of a stored table: a writer holds one in memory.
ROW_GROUP_BYTES = 8 << 20
#: Rows of a slice: numpy kernels pack the row number into 16 bits.
SLICE_ROWS = 65_535

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_TABLE = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    if "A" <= _c <= "Z":
        _TABLE[_b] = _b + 32
    elif not ("0" <= _c <= "9" or "a" <= _c <= "z"):
        _TABLE[_b] = 32
#: Byte table: A-Z to a-z, separators to a space, UTF-8 bytes above 0x7F kept.
WORD_TABLE = bytes(_TABLE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts lineage.

    The table survives the loss of executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _own_tables().add(path)
    return out


def _own_tables() -> set[str]:
    try:
        return _TABLES.get()
    except LookupError:
        _TABLES.set(set())
        return _TABLES.get()


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    _own_tables().discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete the stored tables of this scope (this thread, outside all scopes) but ``keep``, once the results that read them are written."""
    for path in _own_tables() - {df.stored_at for df in keep}:
        _delete(spark, path)


class Scope:
    """Owns the tables that are stored inside it, whatever other callers store or release meanwhile.

    What is not released inside belongs to the surrounding scope afterwards.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scope:
        self.outer, self.tables = _own_tables(), set()
        self.token = _TABLES.set(self.tables)
        return self

    def __exit__(self, *_) -> None:
        _TABLES.reset(self.token)
        self.outer |= self.tables

    def release(self, *keep: DataFrame) -> None:
        for path in self.tables - {df.stored_at for df in keep}:
            _delete(self.spark, path)
            self.tables.discard(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session to ``BATCH_BYTES``, so that rows of long texts fill no memory."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not size.rstrip("b").isdigit() or int(size.rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int = BATCH_BYTES):
    """Arrow batches of at most ``size`` bytes for what is written inside; afterwards the session's own setting holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_and(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole row as struct column ``_row`` beside other columns, so that no name can clash."""
    return df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *columns)


def row_columns(df: DataFrame) -> list[Column]:
    """Select these to get the columns of ``df`` back from ``_row``."""
    return [F.col(f"_row.`{c}`").alias(c) for c in df.columns]


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    """Whether a table of so many rows of at most ``row_bytes`` may be broadcast."""
    return rows * row_bytes <= MAX_BROADCAST_BYTES


def inline_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table of constants as a DataFrame without an RDD. ddl: ``name type, ...``."""
    names = [part.split()[0] for part in ddl.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = ", ".join(":".join(part.split()) for part in ddl.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def words_of(c: Column) -> Column:
    """Words of a text column (null: none), natively."""
    parts = F.split(lower_ascii(F.coalesce(c, F.lit(""))), f"[{SEPARATORS}]+", -1)
    return F.filter(parts, lambda w: w != "")


def words_bytes(text: str | None) -> list[bytes]:
    """Words of one text as UTF-8 bytes (null: none)."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def text_slices(batch, column: str, limit: int = 1 << 20):
    """Cut an Arrow record batch into slices whose texts hold about ``limit`` bytes.

    A slice holds one row at least, so a single longer text is a slice of its
    own, and ``SLICE_ROWS`` at most. This bounds the memory of the numpy
    kernels whatever the batch size.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    edges = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = edges[start - 1] if start else 0
        stop = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(edges, base + limit, "right"))))
        yield batch.slice(start, stop - start)
        start = stop
