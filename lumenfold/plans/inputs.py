"""Stand-ins: which tables play ticks, pixels, palettes and trades.

The engine's domain has no table among the inputs, so each query reads one of
these views. Every view has its DuckDB text beside it (``*_SQL``), to be used
as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import to_q16

#: Levels of a curve.
LEVELS = 32
#: Slots of a palette.
SLOTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TICKS_SQL = "ticks AS (SELECT user_id AS burst, event_type AS channel, ts, event_id AS tick_id, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events)"


def ticks(spark, sf_dir) -> DataFrame:
    """burst, channel, ts, tick_id and an integer reading v (cents)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("burst"), F.col("event_type").alias("channel"), "ts", F.col("event_id").alias("tick_id"), F.rint(F.col("value") * 100).cast("long").alias("v"))


def tick_order():
    return Window.partitionBy("burst").orderBy("ts", "tick_id")


PIXELS_SQL = (
    "pixels AS (SELECT label AS frame, vec_id AS idx, CAST(round_even(CAST(embedding[1] AS DOUBLE) * 65536, 0) AS BIGINT) AS l, "
    "CAST(round_even(CAST(embedding[2] AS DOUBLE) * 65536, 0) AS BIGINT) AS a, CAST(round_even(CAST(embedding[3] AS DOUBLE) * 65536, 0) AS BIGINT) AS b FROM embeddings)"
)


def pixels(spark, sf_dir) -> DataFrame:
    """frame, idx and a Q16 colour (l, a, b): the first three components of each vector."""
    e = table(spark, sf_dir, "embeddings")
    lanes = [to_q16(F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("lab")]
    return e.select(F.col("label").alias("frame"), F.col("vec_id").alias("idx"), *lanes)


PALETTE_SQL = PIXELS_SQL + f", palette AS (SELECT * FROM (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY idx) - 1 AS INTEGER) AS slot, l, a, b FROM pixels) WHERE slot < {SLOTS})"


def palette(spark, sf_dir) -> DataFrame:
    """frame, slot, l, a, b: the first SLOTS colours of each frame."""
    w = Window.partitionBy("frame").orderBy("idx")
    return pixels(spark, sf_dir).withColumn("slot", (F.row_number().over(w) - 1).cast("int")).filter(F.col("slot") < SLOTS).select("frame", "slot", "l", "a", "b")


CURVES_SQL = f"samples AS (SELECT CAST(i AS INTEGER) AS curve, vec_id AS id, CAST(least({LEVELS - 1}, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.5) * {LEVELS}))) AS INTEGER) AS level FROM embeddings, generate_series(1, 8) g(i)), hist AS (SELECT curve, level, count(*) AS n FROM samples GROUP BY ALL)"


def samples(spark, sf_dir) -> DataFrame:
    """curve, id, level: eight components of each vector as levels of eight curves of equal mass."""
    e = table(spark, sf_dir, "embeddings")
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor((F.col("x").cast("double") + 0.5) * LEVELS))).cast("int")
    return e.select(F.col("vec_id").alias("id"), F.posexplode(F.slice("embedding", 1, 8)).alias("p", "x")).select((F.col("p") + 1).alias("curve"), "id", level.alias("level"))


TRADES_SQL = "trades AS (SELECT l_orderkey * 8 + l_linenumber AS trade_id, l_orderkey AS offer, l_partkey AS want, o_custkey AS proposer, l_suppkey AS counter, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'proposed' ELSE 'withdrawn' END AS state, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS epoch FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def trades(spark, sf_dir) -> DataFrame:
    """trade_id, offer, want, proposer, counter, state, epoch: one trade an order line."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("withdrawn")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trade_id"), F.col("l_orderkey").alias("offer"), F.col("l_partkey").alias("want"),
        F.col("o_custkey").alias("proposer"), F.col("l_suppkey").alias("counter"), state.alias("state"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("epoch"),
    )


MEMBERS_SQL = "members AS (SELECT c_custkey AS id, c_nationkey AS guild, CAST(floor(c_acctbal) AS BIGINT) AS prestige, c_custkey % 97 AS tenure FROM customer)"


def members(spark, sf_dir) -> DataFrame:
    """id, guild, prestige, tenure: customers as members of a guild each."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("guild"), F.floor("c_acctbal").cast("long").alias("prestige"), (F.col("c_custkey") % 97).alias("tenure"))
