"""Spark readers and writers over binary files.

Files are listed and read by Spark (``binaryFile``), so any store that Spark
reads will do; decoding runs in the tasks, one file at a time. A bad file
raises, or with ``strict=False`` gives a row whose ``error`` says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources import codecs

MANIFEST_SCHEMA = "lumenfold-corpus-1"
LUT_LINE = "%.6f %.6f %.6f"


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    stem = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.expr(f"substring(regexp_extract(path, '([^/]+)$', 1), 1, length(regexp_extract(path, '([^/]+)$', 1)) - {len(suffix)})").alias("stem") if suffix else stem.alias("stem"), "content")


def _decode(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[tuple]], strict: bool) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in _split(schema)]

    def run(batches):
        for pdf in batches:
            for stem, content in zip(pdf["stem"], pdf["content"]):
                try:
                    out = [(*r, None) for r in rows(stem, bytes(content))]
                except codecs.BadFormat as e:
                    if strict:
                        raise
                    out = [(stem, *[None] * (len(names) - 1), str(e))]
                yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return files.mapInPandas(run, f"{schema}, error string")


def _split(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def decode_volumes(files: DataFrame, strict: bool = True) -> DataFrame:
    """stem, t, y, x, l, a, b of every voxel of the .volume.npy files."""

    def rows(stem, data):
        v = codecs.read_volume(data)
        for t in range(v.shape[0]):
            for y in range(v.shape[1]):
                for x in range(v.shape[2]):
                    yield (stem, t, y, x, *(int(c) for c in v[t, y, x]))

    return _decode(files, "stem string, t int, y int, x int, l int, a int, b int", rows, strict)


def read_volumes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """:func:`decode_volumes` of the files of a folder."""
    return decode_volumes(_files(spark, path, ".volume.npy"), strict)


def decode_records(files: DataFrame, strict: bool = True) -> DataFrame:
    """One row per capture record (.s4cr): version, window, frame times, weave and exposures."""

    def rows(stem, data):
        r = codecs.read_record(data)
        ev = [{"dur_us": a, "iso_milli": b, "ev_cs": c} for a, b, c in r.get("ev") or []]
        yield stem, r["v"], r.get("win"), r.get("d0"), r.get("weave"), r.get("dtus"), r.get("s16"), ev

    return _decode(files, "stem string, v int, win int, d0 int, weave array<int>, dtus array<bigint>, s16 array<bigint>, ev array<struct<dur_us:bigint,iso_milli:bigint,ev_cs:bigint>>", rows, strict)


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """:func:`decode_records` of the files of a folder."""
    return decode_records(_files(spark, path, ".s4cr"), strict)


def decode_gifs(files: DataFrame, strict: bool = True) -> DataFrame:
    """One row per frame: its palette (array of r, g, b) and its indices, row by row."""

    def rows(stem, data):
        w, h, frames = codecs.read_gif(data)
        for t, (palette, indices, delay) in enumerate(frames):
            yield stem, t, w, h, delay, [list(c) for c in palette], indices

    return _decode(files, "stem string, t int, width int, height int, delay_cs int, palette array<array<int>>, indices array<int>", rows, strict)


def read_gifs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """:func:`decode_gifs` of the files of a folder."""
    return decode_gifs(_files(spark, path, ".gif"), strict)


def gif_pixels(gifs: DataFrame) -> DataFrame:
    """stem, t, y, x, slot of decoded frames, by built-in functions."""
    p = gifs.select("stem", "t", "width", F.posexplode("indices").alias("i", "slot"))
    return p.select("stem", "t", F.call_function("div", F.col("i"), F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "slot")


def decode_carriers(files: DataFrame) -> DataFrame:
    """stem, status and payload of the carrier in each file (stem, content)."""
    return _decode(files, "stem string, status string, payload binary", lambda stem, data: iter([(stem, *codecs.extract_carrier(data))]), True)


def read_carriers(spark: SparkSession, path: str, suffix: str = ".gif") -> DataFrame:
    """:func:`decode_carriers` of the files of a folder."""
    return decode_carriers(_files(spark, path, suffix))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a corpus folder, sorted by stem: the manifest with what each capture has.

    An unknown schema is an error.
    """
    man = spark.read.option("multiLine", "true").schema("schema string, captureCount int, captures map<string,array<string>>").json(f"{path}/corpus_manifest.json")
    known = F.when(F.col("schema") == MANIFEST_SCHEMA, F.col("captures")).otherwise(F.raise_error(F.concat(F.lit("unknown corpus schema "), F.coalesce("schema", F.lit("null")))))
    rows = man.select(F.explode(known).alias("stem", "files"))
    has = lambda s: F.exists("files", lambda f: f.endswith(s))
    return rows.select("stem", "files", has(".volume.npy").alias("has_volume"), has(".s4cr").alias("has_record"), has(".gif").alias("has_gif")).orderBy("stem")


def write_manifest(spark: SparkSession, path: str, captures: dict[str, list[str]]) -> None:
    """The manifest of a corpus as one JSON text file under ``path``."""
    text = json.dumps({"schema": MANIFEST_SCHEMA, "captureCount": len(captures), "captures": captures})
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/corpus_manifest.json")


def assemble_gifs(frames: DataFrame, side: int, delay_cs: int, shared: bool = False) -> DataFrame:
    """frames: capture, t, palette (array<array<int>>), indices. capture and its animation as bytes.

    shared: the palette of the first frame is the one table of all.
    """

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        data = codecs.write_gif(side, [([[int(v) for v in c] for c in p], [int(i) for i in ix]) for p, ix in zip(pdf["palette"], pdf["indices"])], delay_cs, shared=[[int(v) for v in c] for c in pdf["palette"].iloc[0]] if shared else None)
        return pd.DataFrame({"capture": [key[0]], "gif": [data]})

    kind = frames.schema["capture"].dataType.simpleString()
    return frames.groupBy("capture").applyInPandas(make, f"capture {kind}, gif binary")


def cube_lut_lines(lut: DataFrame, n: int) -> DataFrame:
    """Text of a .cube table of n**3 rows (r, g, b in 0..n-1 and out_r, out_g, out_b), red fastest."""
    head = lut.sparkSession.createDataFrame([(-1, f"LUT_3D_SIZE {n}")], "k long, value string")
    body = lut.select(((F.col("b") * n + F.col("g")) * n + F.col("r")).cast("long").alias("k"), F.format_string(LUT_LINE, "out_r", "out_g", "out_b").alias("value"))
    return head.union(body).orderBy("k").select("value")


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store with rows of the same key replaced and the others appended."""
    return store.join(rows.select(key), key, "left_anti").select(*store.columns).unionByName(rows.select(*store.columns))


def publish(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of unknown keys appended; publishing a known key again changes nothing."""
    return store.unionByName(rows.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


# ------------------------------------------------------- tables and documents


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated files with a header line."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def read_golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Expected records: JSON documents, each a list ``records`` of the schema, one row a record."""
    docs = spark.read.option("multiLine", "true").schema(f"records array<struct<{schema}>>").option("mode", "FAILFAST").json(path)
    return docs.select(F.inline("records"))


def read_indexes(spark: SparkSession, path: str, schema: str, baseline: list[dict] = ()) -> DataFrame:
    """Descriptors of the index.json of every slot folder below ``path``, with their slot; ``baseline`` rows come first.

    A slot without an index has none; no index at all gives the baseline alone.
    """
    rows = spark.createDataFrame([(None, *[b.get(c.split(" ")[0]) for c in _split(schema)]) for b in map(dict, baseline)], f"slot string, {schema}").withColumn("first", F.lit(1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "index.json").load(path)
    slot = F.regexp_extract("path", r"([^/]+)/index\.json$", 1)
    kind = ", ".join(":".join(c.strip().split(" ", 1)) for c in _split(schema))
    listed = files.select(slot.alias("slot"), F.inline(F.from_json(F.col("content").cast("string"), f"array<struct<{kind}>>", {"mode": "FAILFAST"})))
    return rows.unionByName(listed.withColumn("first", F.lit(0)))


def read_capture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Capture documents: one JSON object a file."""
    return spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(schema).json(path)


def records(store: DataFrame, kind: str, order: str | None = None, ascending: bool = True) -> DataFrame:
    """Records of one type, in an order if one is given."""
    found = store.filter(F.col("type") == kind)
    return found if order is None else found.orderBy(F.col(order).asc() if ascending else F.col(order).desc())


def record(store: DataFrame, key: str, value) -> DataFrame:
    """The record of an id: one row or none."""
    return store.filter(F.col(key) == F.lit(value)).limit(1)


def import_bundle(spark: SparkSession, store: DataFrame, path: str, key: str) -> tuple[DataFrame, int]:
    """The store with a bundle's rows (JSON lines of its schema) added once by key, and how many the bundle holds."""
    rows = spark.read.schema(store.schema).option("mode", "FAILFAST").json(path)
    return publish(store, rows, key), rows.count()


def decode_weights(files: DataFrame, count: int, strict: bool = True) -> DataFrame:
    """stem, i, w of blobs of ``count`` little-endian 32-bit floats; another length is refused."""
    return _decode(files, "stem string, i int, w double", lambda stem, data: ((stem, i, w) for i, w in enumerate(codecs.unpack_weights(data, count))), strict)


def read_weights(spark: SparkSession, path: str, count: int, strict: bool = True) -> DataFrame:
    """:func:`decode_weights` of the files of a folder."""
    return decode_weights(_files(spark, path, ".weights"), count, strict)


def weights_json(weights: DataFrame) -> DataFrame:
    """stem, count, sha256 and json of each organ's weights (stem, i, w): an export with its content hash."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"])
    body = F.to_json(F.struct(F.col("stem"), F.col("w")))
    return weights.groupBy("stem").agg(listed.alias("w")).select("stem", F.size("w").alias("count"), F.sha2(body.cast("binary"), 256).alias("sha256"), body.alias("json"))


def decode_swaps(files: DataFrame) -> DataFrame:
    """stem, status, minted, parents and weights of the swap block in each file (stem, content)."""
    kind = "stem string, status string, minted int, parents array<bigint>, weights array<int>"
    return _decode(files, kind, lambda stem, data: iter([(stem, *codecs.extract_swap(data))]), True)


def read_swaps(spark: SparkSession, path: str, suffix: str = ".gif") -> DataFrame:
    """:func:`decode_swaps` of the files of a folder."""
    return decode_swaps(_files(spark, path, suffix))


def read_bundles(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """stem, field_source, y, x, ch, counts (of every level) and margin of each cell of the bundles in ``path``.

    A bundle is a ``<stem>_manifest.json`` beside the arrays that it names. The
    shapes must be those of the manifest, and the margins, if it has any, must
    be the largest count less the second of each cell.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    shape = "struct<shape:array<int>>"
    text = F.from_json(F.col("content").cast("string"), f"field_source string, artifacts struct<field:string,contested:string>, field {shape}, contested {shape}")
    man = files.filter(F.col("name").endswith("_manifest.json")).select("folder", F.regexp_extract("name", "^(.*)_manifest.json$", 1).alias("stem"), text.alias("m"))
    named = lambda c: files.select("folder", F.col("name").alias(f"{c}_name"), F.col("content").alias(c))
    own = man.select("folder", "stem", "m.field_source", F.col("m.artifacts.field").alias("field_name"), F.col("m.artifacts.contested").alias("contested_name"), F.col("m.field.shape").alias("shape"), F.col("m.contested.shape").alias("contested_shape"))
    whole = own.join(named("field"), ["folder", "field_name"], "left").join(named("contested"), ["folder", "contested_name"], "left")

    def cells(row) -> Iterator[tuple]:
        if row["field"] is None:
            raise codecs.BadFormat("the manifest names no field that is there")
        field, margins = codecs.read_bundle(bytes(row["field"]), row["shape"], row["contested"] and bytes(row["contested"]), row["contested_shape"])
        for y in range(field.shape[0]):
            for x in range(field.shape[1]):
                for ch in range(field.shape[2]):
                    yield row["stem"], row["field_source"], y, x, ch, field[y, x, ch].tolist(), int(margins[y, x, ch]), None

    names = ["stem", "field_source", "y", "x", "ch", "counts", "margin", "error"]

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                try:
                    out = list(cells(row))
                except codecs.BadFormat as e:
                    if strict:
                        raise
                    out = [(row["stem"], *[None] * 6, str(e))]
                yield pd.DataFrame(out, columns=names, dtype=object)

    return whole.select("stem", "field_source", "field", "shape", "contested", "contested_shape").mapInPandas(run, "stem string, field_source string, y int, x int, ch int, counts array<int>, margin int, error string")
