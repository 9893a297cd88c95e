"""Replaying mint operations: what is granted once everything that it is made of is held.

An operation (seq, gene, parents) is granted if each of its parents is held
then, that is, some granted operation with a smaller seq made it. Operations of
one gene are independent claims: the first granted one makes it, later granted
ones change nothing. Since an operation depends on smaller seqs alone, the
fixed point is unique, and equals the fold over the operations in order.

It is reached by generations. A round takes the genes whose time of holding was
found or became earlier in the round before, joins them with the operations
that wait for them, and grants those that lack nothing more. A round reads only
what it touches: waiting edges (one row for each operation and distinct
parent) and the times so far. The number of rounds is the length of the longest
chain of grants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.storage import Scratch


def replay(ops: DataFrame, group: tuple[str, ...] = (), limit: int = 10_000) -> DataFrame:
    """Add ``generation`` (null: refused) and ``is_new`` (the op that made its gene) to ops.

    ops: ``group`` columns, seq (unique in a group), gene and parents (array,
    null or empty: an origin; duplicates count once; a null parent is never
    held). Groups are genealogies of their own. A chain of more than ``limit``
    generations is an error.
    """
    spark, keys = ops.sparkSession, list(group)
    with Scratch(spark, "mints") as scratch:
        parents = F.array_distinct(F.coalesce("parents", F.array().cast(ops.schema["parents"].dataType)))
        rows = scratch.write(ops.select(*keys, "seq", "gene", parents.alias("parents")))
        waits = scratch.write(rows.select(*keys, "seq", F.explode("parents").alias("parent")))
        lacks = rows.select(*keys, "seq", "gene", F.size("parents").alias("lacks"))
        granted = scratch.write(lacks.filter("lacks = 0").select(*keys, "seq", "gene", F.lit(0).alias("generation")))
        earliest = lambda df: df.groupBy(*keys, "gene").agg(F.min("seq").alias("since"))
        held = scratch.write(earliest(granted))
        news, lacks = held, scratch.write(lacks.filter("lacks > 0"))
        for generation in range(1, limit + 1):
            # edges met by what is held newly or earlier; an edge is met once and then gone
            met = waits.join(news.withColumnRenamed("gene", "parent"), [*keys, "parent"]).filter("since < seq").select(*keys, "seq", "parent")
            met = scratch.write(met)
            if met.isEmpty():
                break
            waits = scratch.write(waits.join(met, [*keys, "seq", "parent"], "left_anti"))
            lacks = lacks.join(met.groupBy(*keys, "seq").agg(F.count("*").alias("_met")), [*keys, "seq"], "left")
            lacks = scratch.write(lacks.select(*keys, "seq", "gene", (F.col("lacks") - F.coalesce("_met", F.lit(0))).alias("lacks")))
            step = scratch.write(lacks.filter("lacks = 0").select(*keys, "seq", "gene", F.lit(generation).alias("generation")))
            granted, lacks = granted.unionByName(step), lacks.filter("lacks > 0")
            found = earliest(step).join(held.withColumnRenamed("since", "_before"), [*keys, "gene"], "left")
            news = scratch.write(found.filter("_before IS NULL OR since < _before").select(*keys, "gene", "since"))
            held = scratch.write(earliest(held.withColumnRenamed("since", "seq").unionByName(news.withColumnRenamed("since", "seq"))))
        else:
            raise ValueError(f"more than {limit} generations")
        first = F.row_number().over(Window.partitionBy(*keys, "gene").orderBy("seq")) == 1
        made = granted.withColumn("is_new", first).drop("gene")
        out = ops.join(made, [*keys, "seq"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
        return scratch.result(out)


#: Holdings that one task of :func:`grantable` joins.
TASK_ROWS = 1 << 20


def grantable(children: DataFrame, holdings: DataFrame) -> DataFrame:
    """Pairs (who, child) where ``who`` holds every parent of the child.

    children: child, parents (at least one); holdings: who, gene. Holders of a
    child's first parent meet what they hold of its others; only those that
    match are counted, in partitions whose number grows with the holdings.
    """
    spark, key = holdings.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with Scratch(spark, "grantable") as scratch:
        held = scratch.write(holdings.select("who", "gene"))
        spark.conf.set(key, str(max(int(before), held.count() // TASK_ROWS + 1)))
        try:
            own = children.select("child", F.array_distinct("parents").alias("parents"))
            first = own.select("child", F.element_at("parents", 1).alias("gene"), F.expr("slice(parents, 2, size(parents))").alias("rest")).filter("gene IS NOT NULL")
            met = held.join(first, "gene").select("who", "child", "rest")
            alone = met.filter("size(rest) = 0").select("who", "child").distinct()
            rest = met.filter("size(rest) > 0").select("who", "child", F.size("rest").alias("_need"), F.explode("rest").alias("gene"))
            both = rest.join(held, ["who", "gene"], "left_semi").groupBy("who", "child").agg(F.countDistinct("gene").alias("_have"), F.max("_need").alias("_need"))
            return scratch.result(both.filter("_have = _need").select("who", "child").unionByName(alone))
        finally:
            spark.conf.set(key, before)
