"""Mixing sources to target weights by Pareto order sampling.

Targets: sources, ordered by code point with null last, weigh ``weights`` in
turn and share all words; a target stops at ``max_repeats`` times its source's
words, and the excess is shared again by weight until no target is above. That
level is found by rounds of one aggregation over the sources: the sources that
the level so far fills are capped, and what they leave is shared by the rest,
until no more are filled.

Copies: shorter documents bring more different text for the same words, so the
expected number of copies of a document falls with its size: copies = c *
size^-``tilt``, at most ``max_repeats``, where c makes the source's expected words
its target. c is found exactly from the number of documents of each size. The
whole part are certain copies; the fraction p is the inclusion probability of
one more.

Taking: documents are ranked by random odds divided by inclusion odds,
U/(1-U) / (p/(1-p)), and taken in that order as long as the sum of their words
stays within what the certain copies leave of the target. (The ranks below 1
have, on average, just these words.) U is a hash of the id and a seed, of the
text where the id is null, so reruns agree on any cluster. A last, closing
document is the one whose size comes nearest to what is still missing then.

No task needs a whole source: ranks are cut into ``RANK_BUCKETS`` buckets,
whose word counts tell the bucket that the cut falls in; only rows of that
bucket are sorted. Sources are numbered by ranges, not in one task.

Defined cases: null or empty texts have size 0, count as one word for their
copies and are taken with 0 words; sources without words have target 0; a null
source is a source; repeated rows share their rank and count each; ids are of
any type; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import fits_broadcast, row_and, row_columns, stored, table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Power of its size by which a document's copies fall.
TILT = 0.5
RANK_BUCKETS = 4096
SEED = "mix-1"
#: Bytes of a source's row besides its name.
SOURCE_BYTES = 96


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Add ``turn``, from 0 by code point with null last. Ranges of sources are numbered in tasks of their own."""
    order = F.col("source").asc_nulls_last()
    ranged = stored(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(parts), "part").withColumn("turn", F.col("before") + F.col("own")).drop("part", "own", "before")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From columns source and source_size, one row a source, the target of each."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    rows = stored(numbered_sources(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_repeats)).alias("cap")), "mix-sources")
    water, filled = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * water
        at = rows.agg(F.count_if(over).alias("n"), F.sum("source_size").cast("double").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if at["n"] == filled or not at["weights"]:
            break
        filled, water = at["n"], (at["all"] - (at["capped"] or 0.0)) / at["weights"]
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * water).alias("target"))


def expected_copies(by_size: DataFrame, max_repeats: int = MAX_REPEATS, tilt: float = TILT) -> DataFrame:
    """Add ``copies`` to columns source, size, n (documents of that size) and target.

    Copies are max_repeats up to some size and c * size^-tilt beyond it; the row where that begins tells c.
    """
    size = F.greatest(F.col("size"), F.lit(1)).cast("double")
    fall = F.when(size == 1.0, F.lit(1.0)).otherwise(1.0 / F.sqrt(size) if tilt == 0.5 else F.pow(size, F.lit(-tilt)))
    rows = by_size.withColumn("fall", fall).withColumn("words", (F.col("n") * F.col("size")).cast("double"))
    up = Window.partitionBy("source").orderBy("size")
    before = F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("words") * F.col("fall")).over(up.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(rest > 0, (F.col("target") - max_repeats * before) / rest)
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("fall") <= max_repeats, F.struct("size", "level"))
    rows = rows.withColumn("c", F.min(fits).over(Window.partitionBy("source")))
    tilted = F.greatest(F.lit(0.0), F.least(F.lit(float(max_repeats)), F.col("c.level") * F.col("fall")))
    copies = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("c").isNull() | (F.col("size") < F.col("c.size")), F.lit(float(max_repeats))).otherwise(tilted)
    return rows.withColumn("copies", copies).drop("fall", "words", "level", "c")


def mix_counts(rows: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, tilt: float = TILT) -> DataFrame:
    """Add source_size, target and copies to rows of columns rid (any unique long), doc_id, source, size and key.

    key: a hash of the text, as text. The rows are read several times, so pass a stored table.
    """
    by_size = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-by-size")
    targets = stored(source_targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, max_repeats), "mix-targets")
    about = targets.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("source")), F.lit(0)).alias("s")).first()
    hint = F.broadcast if fits_broadcast(about["n"], SOURCE_BYTES + about["s"]) else (lambda df: df)
    t = targets.withColumnRenamed("source", "_s")
    plan = expected_copies(by_size.join(hint(t), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), max_repeats, tilt)
    whole = F.floor("copies").cast("int")
    left = F.col("target") - F.sum(F.col("n") * F.col("size") * whole).over(Window.partitionBy("source"))
    plan = plan.select("source", "size", "source_size", "target", whole.alias("whole"), (F.col("copies") - whole).alias("p"), F.greatest(F.lit(0.0), left).alias("rest"))
    plan = stored(plan, "mix-plan")
    few = F.broadcast if fits_broadcast(plan.count(), SOURCE_BYTES + about["s"]) else (lambda df: df)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), "key"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    planned = plan.withColumnRenamed("source", "_s").withColumnRenamed("size", "_n")
    ranked = rows.join(few(planned), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))).drop("_s", "_n")
    ranked = ranked.withColumn("rank", F.when((F.col("p") > 0) & (F.col("rest") > 0), u / (1 - u) * (1 - F.col("p")) / F.col("p")).otherwise(F.lit(float("inf")))).drop("p")
    bucket = F.when(F.col("rank") == float("inf"), RANK_BUCKETS).otherwise(F.floor(F.col("rank") / (F.col("rank") + 1) * RANK_BUCKETS)).cast("int")
    ranked = ranked.withColumn("bucket", bucket)
    # words of each bucket, and what lies before it; at most RANK_BUCKETS + 1 rows a source
    filled = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumn("upto", F.sum("n").over(upto))
    cut = filled.filter("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    cut = cut.select(F.col("source").alias("_s"), F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("before"))
    placed = ranked.join(hint(cut), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    able = F.col("rank") < float("inf")
    inside = placed.filter(able & (F.col("bucket") == F.col("cut_bucket")))
    order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("more", (F.col("before") + F.sum("size").over(order) <= F.col("rest")).cast("int"))
    outside = placed.filter(~able | F.col("cut_bucket").isNull() | (F.col("bucket") != F.col("cut_bucket"))).withColumn("more", (able & (F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")))).cast("int"))
    chosen = stored(outside.unionByName(inside).drop("bucket", "cut_bucket", "before"), "mix-chosen")
    # the closing document: of those that may have one copy more, the one whose words fill the gap best
    gap = chosen.groupBy("source").agg((F.first("rest") - F.sum(F.col("size") * F.col("more"))).alias("gap")).withColumnRenamed("source", "_s")
    free = chosen.filter(F.expr("more = 0 AND rest > 0 AND size > 0") & (F.col("whole") < max_repeats)).join(hint(gap), F.col("source").eqNullSafe(F.col("_s"))).filter("size < 2 * gap")
    closing = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "rank", F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rid")).alias("c"))
    closing = closing.select(F.col("source").alias("_s"), F.col("c.rid").alias("_rid"))
    both = chosen.join(hint(closing), F.col("source").eqNullSafe(F.col("_s")), "left")
    more = F.col("more") + F.coalesce((F.col("rid") == F.col("_rid")).cast("int"), F.lit(0))
    return both.withColumn("copies", F.col("whole") + more).drop("whole", "rest", "rank", "more", "rid", "_s", "_rid")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, source, size, key (hash of the text), source_size, target and copies of every document."""
    text = F.col(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("key"))
    return mix_counts(stored(rows, "mix-rows"), **kw)


def resample(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Identical rows are each taken as often as the first of them."""
    counts = mix_documents(docs, id_col, source_col, text_col, **kw).filter("copies > 0").groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("source").alias("_s")).agg(F.max("copies").alias("_n"))
    counts = stored(counts, "mix-copies")
    size = counts.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("_s")), F.lit(0)).alias("s")).first()
    hint = F.broadcast if fits_broadcast(size["n"], 96 + size["s"]) else (lambda df: df)
    rows = row_and(docs, F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"))
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s"))
    return rows.join(hint(counts), same).select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select(*row_columns(docs))


def op10_mix(spark, sf_dir):
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS key,
    CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS level FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS water
    FROM r WINDOW o AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT water FROM l WHERE water <= level ORDER BY level, source NULLS LAST LIMIT 1)) AS target FROM l),
z AS (SELECT d.source, d.size, count(*) AS n, 1.0::DOUBLE / sqrt(greatest(d.size, 1)::DOUBLE) AS fall FROM d GROUP BY d.source, d.size),
y AS (SELECT z.*, t.source_size, t.target, (t.target - 3 * coalesce(sum((z.n * z.size)::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum((z.n * z.size)::DOUBLE * fall) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
    FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY z.source ORDER BY z.size)),
x AS (SELECT *, min(size) FILTER (WHERE level * fall <= 3) OVER (PARTITION BY source) AS from_size, arg_min(level, size) FILTER (WHERE level * fall <= 3) OVER (PARTITION BY source) AS c FROM y),
w AS (SELECT *, CASE WHEN target <= 0 THEN 0 WHEN c IS NULL OR size < from_size THEN 3 ELSE greatest(0, least(3, c * fall)) END AS copies FROM x),
p AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p, greatest(0, target - sum(n * size * floor(copies)) OVER (PARTITION BY source)) AS rest FROM w),
k AS (SELECT d.rid, d.doc_id, d.size, d.key, d.source, p.source_size, p.target, p.whole, p.rest, CASE WHEN p.p > 0 AND p.rest > 0 THEN u / (1 - u) * (1 - p.p) / p.p ELSE 'infinity'::DOUBLE END AS rank
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.size = p.size),
c AS (SELECT *, CASE WHEN rank < 'infinity'::DOUBLE AND sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS more FROM k),
g AS (SELECT *, rest - sum(size * more) OVER (PARTITION BY source) AS gap FROM c),
f AS (SELECT rid FROM g WHERE more = 0 AND rest > 0 AND size > 0 AND whole < 3 AND size < 2 * gap
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap - size), rank, doc_id NULLS LAST, key) = 1)
SELECT doc_id, size, source_size, target,
    (size * (whole + more + CASE WHEN rid IN (SELECT rid FROM f) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
