"""A folder of artifacts (stem, suffix, content) that is written in two phases, as a Python data source.

``df.write.format("artifacts").option("path", folder).mode("append").save()``:

1. Each task writes its artifacts, one file each, and a part of the manifest
   into a folder of its own attempt, ``_staging/<run>/<partition>-<attempt>``.
2. The driver moves the folder of each successful attempt to
   ``parts/<run>-<partition>`` (one move a task) and then, as the last step,
   puts ``manifests/<run>.json`` in place, which names the parts. Readers know
   only parts that a manifest names.

So a task that is killed, retried or run twice, and a driver that dies between
the two phases, leave nothing that a reader sees; ``abort`` and every later
commit remove what lies in ``_staging`` of their run. The driver handles one
message a task, however many artifacts there are.

:func:`export` adds only artifacts whose name is not there yet, so a second run
changes nothing, not even the list of manifests.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumenfold.sources.frames import filesystem

#: Columns that a write must have.
COLUMNS = "stem string, suffix string, content binary"
READ_COLUMNS = f"{COLUMNS}, bytes bigint, sha256 string"
#: Says what a manifest is (fixed value of this layout).
MANIFEST = "artifacts/1"


class BadName(ValueError):
    """A stem or suffix that is null or would leave the folder."""


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged."""

    partition: int
    folder: str
    count: int
    bytes: int


def _write(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    with fs.open_output_stream(path) as out:
        out.write(content)


def file_name(stem: str | None, suffix: str | None) -> str:
    name = None if stem is None or suffix is None else stem + suffix
    if not name or "/" in name or "\x00" in name or name.startswith((".", "_")):
        raise BadName(f"no name of an artifact: {stem!r}, {suffix!r}")
    return name


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        task = TaskContext.get()
        fs, root = filesystem(self.path)
        own = f"{root}/_staging/{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(own)
        count = size = 0
        with fs.open_output_stream(f"{own}/_part.json") as listing:
            for batch in iterator:
                for stem, suffix, content in zip(*(batch.column(c) for c in ("stem", "suffix", "content"))):
                    stem, suffix, content = stem.as_py(), suffix.as_py(), content.as_py() or b""
                    name = file_name(stem, suffix)
                    _write(fs, f"{own}/{name}", content)
                    line = {"stem": stem, "suffix": suffix, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
                    listing.write(json.dumps(line).encode() + b"\n")
                    count, size = count + 1, size + len(content)
        return Staged(task.partitionId(), own, count, size)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = filesystem(self.path)
        parts = []
        for m in sorted((m for m in messages if m is not None and m.count), key=lambda m: m.partition):
            parts.append(f"{self.run}-{m.partition}")
            fs.create_dir(f"{root}/parts")
            fs.move(m.folder, f"{root}/parts/{parts[-1]}")
        if parts:
            about = {"schema": MANIFEST, "run": self.run, "count": sum(m.count for m in messages if m), "bytes": sum(m.bytes for m in messages if m), "parts": parts}
            fs.create_dir(f"{root}/manifests")
            _write(fs, f"{root}/manifests/_{self.run}", json.dumps(about).encode())
            fs.move(f"{root}/manifests/_{self.run}", f"{root}/manifests/{self.run}.json")
        self._sweep(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._sweep(*filesystem(self.path))

    def _sweep(self, fs: pafs.FileSystem, root: str) -> None:
        own = f"{root}/_staging/{self.run}"
        if fs.get_file_info(own).type == pafs.FileType.Directory:
            fs.delete_dir(own)


def committed_parts(path: str) -> list[str]:
    """The parts that manifests name."""
    fs, root = filesystem(path)
    out = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/manifests", allow_not_found=True)), key=lambda f: f.path):
        if info.path.endswith(".json"):
            with fs.open_input_file(info.path) as source:
                about = json.loads(source.read())
            if about.get("schema") != MANIFEST:
                raise ValueError(f"{info.path} is no manifest of this kind: {about.get('schema')!r}")
            out += about["parts"]
    return out


class Part(InputPartition):
    pass


class ArtifactReader(DataSourceReader):
    """One partition for each committed part."""

    def __init__(self, path: str, contents: bool):
        self.path, self.contents = path, contents

    def partitions(self) -> list[Part]:
        return [Part(p) for p in committed_parts(self.path)] or [Part(None)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.value is None:
            return
        fs, root = filesystem(self.path)
        own = f"{root}/parts/{partition.value}"
        with fs.open_input_file(f"{own}/_part.json") as listing:
            lines = listing.read().splitlines()
        for line in lines:
            about = json.loads(line)
            content = None
            if self.contents:
                with fs.open_input_file(f"{own}/{about['stem']}{about['suffix']}") as source:
                    content = source.read()
                if hashlib.sha256(content).hexdigest() != about["sha256"]:
                    raise ValueError(f"{about['stem']}{about['suffix']} was changed after it was committed")
            yield (about["stem"], about["suffix"], content, about["bytes"], about["sha256"])


class ArtifactSource(DataSource):
    """``format("artifacts")``; options path and, for reading, contents (default true)."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return READ_COLUMNS

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options["path"], self.options.get("contents", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        if overwrite:
            raise ValueError("artifacts are only appended")
        missing = {"stem", "suffix", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return ArtifactWriter(self.options["path"])


def listing(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """stem, suffix, content (null unless asked for), bytes and sha256 of every committed artifact."""
    spark.dataSource.register(ArtifactSource)
    return spark.read.format("artifacts").option("path", path).option("contents", str(contents).lower()).load()


def export(artifacts: DataFrame, path: str) -> int:
    """Write the artifacts (COLUMNS; one row a name) that are not in the folder yet; how many were written.

    Of rows of one name the one with the least content digest is written; a
    name that is there already keeps its first content.
    """
    spark = artifacts.sparkSession
    held = listing(spark, path).select("stem", "suffix")
    before = held.count()
    one = artifacts.groupBy("stem", "suffix").agg(F.min_by("content", F.sha2("content", 256)).alias("content"))
    one.join(held, ["stem", "suffix"], "left_anti").select("stem", "suffix", "content").write.format("artifacts").option("path", path).mode("append").save()
    return listing(spark, path).count() - before
