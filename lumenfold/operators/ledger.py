"""Trades, grants and genealogies as relations.

A ledger has trade_id, offer, want, proposer, counter, state and epoch. Merges
are unions of sets, so they commute and repeat without effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grants(trades: DataFrame) -> DataFrame:
    """(creator, gene) pairs that accepted trades grant: want to the proposer, offer to the counterparty."""
    a = trades.filter("state = 'accepted'")
    both = F.array(F.struct(F.col("proposer").alias("creator"), F.col("want").alias("gene")), F.struct(F.col("counter").alias("creator"), F.col("offer").alias("gene")))
    return a.select(F.explode(both).alias("g")).select("g.creator", "g.gene").distinct()


def holdings(trades: DataFrame) -> DataFrame:
    return grants(trades).groupBy("creator").agg(F.count("*").alias("genes"), F.min("gene").alias("first_gene"))


def demand(trades: DataFrame) -> DataFrame:
    """Accepted trades of each proposer."""
    return trades.groupBy("proposer").agg(F.count_if(F.col("state") == "accepted").alias("demand"))


def reliability(trades: DataFrame) -> DataFrame:
    """Accepted share of settled trades; 1.0 with nothing settled."""
    settled = F.count_if(F.col("state") != "proposed")
    return trades.groupBy("proposer").agg(F.when(settled == 0, 1.0).otherwise(F.count_if(F.col("state") == "accepted") / settled).alias("reliability"))


def merge(*sets: DataFrame) -> DataFrame:
    """Union of grow-only sets."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality of bags, as two empty differences."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def popularity(adoptions: DataFrame, gene: str, adopter: str) -> DataFrame:
    return adoptions.groupBy(gene).agg(F.countDistinct(adopter).alias("popularity"))


def canonical(events: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Of the events of each key the least by ``order``, by a struct minimum instead of a sort."""
    m = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *columns))
    return events.groupBy(key).agg(m.alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in columns])


def lifecycle(events: DataFrame, key: str, order: list[Column], state: str, actor: str, owner: str) -> DataFrame:
    """State of each trade after its events: the first that settles it wins.

    A proposed trade alone may settle, and its owner may not accept it.
    """
    valid = (F.col(state) == "withdrawn") | ((F.col(state) == "accepted") & (F.col(actor) != F.col(owner)))
    m = F.min(F.when(valid, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col(state).alias("_s"))))
    return events.groupBy(key).agg(F.coalesce(m["_s"], F.lit("proposed")).alias("state"))


def orphans(genes: DataFrame, gene: str, parents: str) -> DataFrame:
    """Genes of which a parent is missing."""
    edges = genes.select(gene, F.explode(parents).alias("_p"))
    return edges.join(genes.select(F.col(gene).alias("_p")), "_p", "left_anti").select(gene).distinct()


def contested(claims: DataFrame, place, owner: str) -> DataFrame:
    """Number of distinct claims of each place, where there are several."""
    return claims.groupBy(*place).agg(F.countDistinct(owner).alias("claims")).filter("claims > 1")


def skyline(df: DataFrame, group, high: str, low: str) -> DataFrame:
    """Rows with ``high`` > 0 that no row of the group dominates (high not less, low not more, one strictly).

    A running maximum over rows ordered by low needs one sort per group in place of a theta join.
    """
    top = df.filter(F.col(high) > 0).groupBy(*group, low).agg(F.max(high).alias("_top"))
    w = Window.partitionBy(*group).orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    best = top.withColumn("_before", F.max("_top").over(w))
    return df.filter(F.col(high) > 0).join(best, [*group, low]).filter((F.col(high) == F.col("_top")) & (F.col("_before").isNull() | (F.col(high) > F.col("_before")))).drop("_top", "_before")


def median_key(grades: Column) -> Column:
    """Grades in the order in which lower medians are struck out: compares as majority judgment does."""
    n = F.size(grades)
    s = F.array_sort(grades)
    # strike order alternates around the lower median: m, m+1, m-1, m+2, ...
    middle = F.call_function("div", n - 1, F.lit(2))

    def at(i):
        step = F.call_function("div", i + 1, F.lit(2))
        up = F.when(n % 2 == 1, i % 2 == 0).otherwise(i % 2 == 1)
        return F.element_at(s, (middle + F.when(up, step).otherwise(-step) + 1).cast("int"))

    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))
