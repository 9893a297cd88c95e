"""Population search for a palette that covers a table of colours, by evolution strategy.

Members of a generation are rows (member, genes: k colours of three lanes).
Fitness is an aggregation over all points: the share that lies within a radius
of one of the member's colours; a generation is one pass over the points, in
which every task counts for all members at once, so only a row of counts a task
is shuffled. Ranking and recombination are windows over the members: the better
part are parents, each gene of a child is that of one of two parents, and a
mutation is added. All draws are hashes of (seed, generation, member, gene), so
reruns agree on any cluster. The best member so far always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.kernels import Refused
from lumenfold.operators.assign import LANES
from lumenfold.storage import Scratch

#: Most numbers of a population: it is held by every task.
MAX_GENES = 100_000


def draw(*parts) -> Column:
    """A number in (0, 1) that a hash of the parts decides."""
    return (F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 12).cast("double") + 0.5) / float(1 << 52)


def normal(*parts) -> Column:
    """A standard normal draw (Box and Muller)."""
    return F.sqrt(-2.0 * F.log(draw(*parts, "r"))) * F.cos(2.0 * F.pi() * draw(*parts, "a"))


def coverage(points: DataFrame, members: DataFrame, radius: float) -> DataFrame:
    """member, genes and fitness. points: l, a, b."""
    rows = members.orderBy("member").collect()  # MAX_GENES bounds it
    sums = []
    for r in rows:
        near = [(F.col("l") - g[0]) ** 2 + (F.col("a") - g[1]) ** 2 + (F.col("b") - g[2]) ** 2 for g in zip(*[iter(r["genes"])] * len(LANES))]
        sums.append(F.count_if(F.least(*near, F.lit(float("inf"))) <= radius * radius).alias(f"m{r['member']}"))
    counts = points.agg(F.count("*").alias("n"), *sums).first()
    n = max(1, counts["n"])
    return members.sparkSession.createDataFrame([(r["member"], r["genes"], counts[f"m{r['member']}"] / n) for r in rows], "member long, genes array<double>, fitness double")


def children(ranked: DataFrame, parents: int, sigma: float, seed: int, generation: int) -> DataFrame:
    """The next generation of a population (member, genes, fitness): the best member, and children of the ``parents`` best ones."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("fitness").desc(), "member")  # a population, not data
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    pool = ranked.filter(F.col("rank") <= parents).select("rank", F.col("genes").alias("_p"))
    pick = lambda side: (F.floor(draw(seed, generation, F.col("member"), side) * parents) + 1).cast("int")
    born = ranked.select("member", "rank", "genes", pick("one").alias("_one"), pick("two").alias("_two"))
    for side in ("_one", "_two"):
        own = pool.select(F.col("rank").alias(side), F.col("_p").alias(f"{side}_genes"))
        born = born.join(F.broadcast(own), side)
    mixed = F.transform(
        F.arrays_zip("_one_genes", "_two_genes"),
        lambda g, i: F.when(draw(seed, generation, F.col("member"), i, "side") < 0.5, g["_one_genes"]).otherwise(g["_two_genes"]) + sigma * normal(seed, generation, F.col("member"), i),
    )
    return born.select("member", F.when(F.col("rank") == 1, F.col("genes")).otherwise(mixed).alias("genes"))


def evolve(points: DataFrame, k: int, radius: float, generations: int, members: int = 8, parents: int = 3, sigma: float = 0.1, seed: int = 1, start: list[float] | None = None) -> tuple[list[float], list[float]]:
    """The best genes (k colours of three numbers) after so many generations, and the best fitness of each, the start's first.

    Everyone starts at ``start`` (default: zeros) and a mutation, but member 0,
    who starts without one.
    """
    if k <= 0 or not 0 < parents <= members or members * k * len(LANES) > MAX_GENES:
        raise Refused(f"{members} members of {k} colours, {parents} parents")
    spark = points.sparkSession
    genes = F.array(*[F.lit(float(g)) for g in (start or [0.0] * (k * len(LANES)))])
    first = spark.range(members).select(F.col("id").alias("member"), F.transform(genes, lambda g, i: g + F.when(F.col("id") > 0, sigma * normal(seed, 0, F.col("id"), i)).otherwise(0.0)).alias("genes"))
    with Scratch(spark, "evolution") as scratch:
        data = scratch.write(points.select(*LANES))
        population = coverage(data, first, radius)
        story = [population.agg(F.max("fitness")).first()[0]]
        for g in range(1, generations + 1):
            population = coverage(data, children(population, parents, sigma, seed, g), radius)
            story.append(population.agg(F.max("fitness")).first()[0])
        best = population.orderBy(F.col("fitness").desc(), "member").first()
    return list(best["genes"]), story
