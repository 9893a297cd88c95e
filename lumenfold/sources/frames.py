"""Files of frames as a Python data source, batch and streaming, with a format guard and an end.

``spark.dataSource.register(FrameSource)`` and then
``spark.readStream.format("frames").option("path", folder)``. Frames are the
rows of the Parquet files of a folder (or of one file), in the order of the
file names; files are only ever added behind the others. Options:

* ``guard``: columns, comma-separated, whose values must be those of the first
  frame. Every file must also have the columns of the first one. A frame of
  another format ends the query with :class:`FormatChanged`; the frames before
  it are committed first, as a micro-batch of their own.
* ``target``: the stream ends after so many frames; nothing later is read, not
  even a frame of another format. :func:`run_until` stops a query there.

An offset is the number of frames so far. Only footers, and guard columns of
row groups whose statistics do not already prove them constant, are read on the
driver; the frames are read in the tasks, a row group in one of them, in
batches. Rows gain a first column ``frame``, numbered from 0.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

BATCH_ROWS = 8192


class FormatChanged(ValueError):
    """A frame has another format than the first one."""


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Span(InputPartition):
    """Rows ``skip`` to ``skip + take`` of one row group, the first of them frame ``frame``."""

    path: str
    group: int
    skip: int
    take: int
    frame: int


class Frames:
    """What is known of the files so far; grows as files are added."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("option path is missing")
        self.fs, self.root = filesystem(options["path"])
        self.guard = [c for c in options.get("guard", "").split(",") if c]
        self.target = int(options["target"]) if "target" in options else None
        self.known: set[str] = set()
        self.schema: pa.Schema | None = None
        self.first: dict | None = None
        #: (path, row group, rows) of every row group, and the frame it begins with
        self.groups: list[tuple[str, int, int]] = []
        self.begins: list[int] = []
        self.total = 0
        #: the first frame of another format, and what is wrong with it
        self.bad: tuple[int, str] | None = None

    def files(self) -> list[str]:
        info = self.fs.get_file_info(self.root)
        if info.type == pafs.FileType.File:
            return [self.root]
        found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet") and "/_" not in f.path.removeprefix(self.root))

    def refresh(self) -> int:
        """Take in new files; the number of frames that may be read."""
        for path in self.files():
            if self.bad or (self.target is not None and self.total >= self.target):
                break
            if path not in self.known:
                self.known.add(path)
                self._add(path)
        end = self.total if self.bad is None else self.bad[0]
        return end if self.target is None else min(end, self.target)

    def _add(self, path: str) -> None:
        with self.fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            if self.schema is None:
                self.schema = file.schema_arrow.remove_metadata()
                if missing := set(self.guard) - set(self.schema.names):
                    raise ValueError(f"guard columns are missing: {sorted(missing)}")
            elif not file.schema_arrow.remove_metadata().equals(self.schema):
                self.bad = (self.total, f"{path} has the columns {file.schema_arrow.names}")
                return
            for g in range(file.num_row_groups):
                rows = file.metadata.row_group(g).num_rows
                if rows:
                    at = self._deviation(file, g)
                    self.groups.append((path, g, rows))
                    self.begins.append(self.total)
                    if at is not None:
                        self.bad = (self.total + at[0], f"{path}: {at[1]}")
                    self.total += rows
                    if at is not None:
                        return

    def _deviation(self, file: pq.ParquetFile, g: int) -> tuple[int, str] | None:
        """The first row of a row group whose guard columns deviate."""
        for name in self.guard:
            if self.first is None:
                self.first = file.read_row_group(g, columns=self.guard).slice(0, 1).to_pylist()[0]
            want = self.first[name]
            stats = file.metadata.row_group(g).column(self.schema.get_field_index(name)).statistics
            proven = stats is not None and stats.has_min_max and stats.null_count == 0 and stats.min == stats.max == want
            if not proven:
                for k, v in enumerate(file.read_row_group(g, columns=[name]).column(0).to_pylist()):
                    if v != want:
                        return k, f"{name} is {v!r}, was {want!r}"
        return None

    def spans(self, start: int, end: int) -> list[Span]:
        out = []
        at = max(0, bisect_right(self.begins, start) - 1)
        while at < len(self.groups) and self.begins[at] < end:
            (path, g, rows), begin = self.groups[at], self.begins[at]
            low, high = max(start, begin), min(end, begin + rows)
            if low < high:
                out.append(Span(path, g, low - begin, high - low, low))
            at += 1
        return out

    def fail(self) -> None:
        raise FormatChanged(f"frame {self.bad[0]}: {self.bad[1]}")


def read_span(path: str, span: Span) -> Iterator[pa.RecordBatch]:
    """The frames of a span, in batches."""
    fs, _ = filesystem(path)
    with fs.open_input_file(span.path) as source:
        at = 0
        for batch in pq.ParquetFile(source).iter_batches(BATCH_ROWS, row_groups=[span.group]):
            low, high = max(0, span.skip - at), min(len(batch), span.skip + span.take - at)
            if low < high:
                number = pa.array(range(span.frame + at + low - span.skip, span.frame + at + high - span.skip), pa.int64())
                yield pa.RecordBatch.from_arrays([number, *batch.slice(low, high - low).columns], ["frame", *batch.schema.names])
            at += len(batch)


class FrameBatchReader(DataSourceReader):
    """All frames there are, or an error before any is read."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Span]:
        frames = Frames(self.options)
        end = frames.refresh()
        if frames.bad and (frames.target is None or frames.target > frames.bad[0]):
            frames.fail()
        return frames.spans(0, end)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return read_span(self.options["path"], partition)


class FrameStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.frames, self.told = dict(options), None, None

    def _known(self) -> Frames:
        self.frames = self.frames or Frames(self.options)
        return self.frames

    def __getstate__(self):
        return {"options": self.options, "frames": None, "told": None}  # what tasks need

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        frames = self._known()
        end = frames.refresh()
        if frames.bad and end == frames.bad[0] and (frames.target is None or end < frames.target):
            # what precedes the bad frame is a micro-batch first; the engine asks again once that is committed
            if self.told == end or end == 0:
                frames.fail()
            self.told = end
        return {"frame": end}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        frames = self._known()
        frames.refresh()  # after a restart a planned micro-batch comes before any question
        return frames.spans(start["frame"], end["frame"])

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return read_span(self.options["path"], partition)


class FrameSource(DataSource):
    """``format("frames")``; options path, guard, target."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> StructType:
        frames = Frames(self.options)
        frames.refresh()
        if frames.schema is None:
            raise ValueError("there is no frame yet to take the columns from: give a schema, frame bigint first")
        return StructType([StructField("frame", LongType()), *from_arrow_schema(frames.schema, prefer_timestamp_ntz=True).fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameBatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameStreamReader(self.options)


def run_until(query, target: int | None = None, poll: float = 0.2) -> int:
    """Let a streaming query over frames run until ``target`` of them are committed (none: until nothing is left), stop it, and say how many are.

    An error of the query is raised here.
    """
    try:
        while target is not None and query.isActive and committed(query) < target:
            query.awaitTermination(poll)
        query.processAllAvailable()
    finally:
        query.stop()
    return committed(query)


def committed(query) -> int:
    """Frames that a query has committed, by its last progress."""
    sources = query.lastProgress["sources"] if query.lastProgress else []
    offset = sources[0]["endOffset"] if sources else None
    number = re.search(r"frame\W+(\d+)", str(offset))  # reports quote offsets in one way or another
    return int(number[1]) if number else 0
