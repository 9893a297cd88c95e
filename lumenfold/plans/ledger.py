"""Queries over trades, genealogies, guilds and votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import graph, ledger
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import MEMBERS_SQL, TRADES_SQL, members, table, trades

T = f"WITH {TRADES_SQL}"
G = f"{T}, grants AS (SELECT proposer AS creator, want AS gene FROM trades WHERE state = 'accepted' UNION SELECT counter, offer FROM trades WHERE state = 'accepted')"


@query("grants", f"{G} SELECT * FROM grants")
def grants(spark, d):
    return ledger.grants(trades(spark, d))


@query("holdings", f"{G} SELECT creator, count(*) AS genes, min(gene) AS first_gene FROM grants GROUP BY creator")
def holdings(spark, d):
    return ledger.holdings(trades(spark, d))


@query("demand", f"{T} SELECT proposer, count(*) FILTER (WHERE state = 'accepted') AS demand FROM trades GROUP BY proposer")
def demand(spark, d):
    return ledger.demand(trades(spark, d))


@query("reliability", f"{T} SELECT proposer, CASE WHEN count(*) FILTER (WHERE state <> 'proposed') = 0 THEN 1.0 ELSE count(*) FILTER (WHERE state = 'accepted')::DOUBLE / count(*) FILTER (WHERE state <> 'proposed') END AS reliability FROM trades GROUP BY proposer")
def reliability(spark, d):
    return ledger.reliability(trades(spark, d))


@query("ledger_merge", f"{G} SELECT * FROM grants WHERE gene % 3 <> 0 UNION SELECT * FROM grants WHERE gene % 2 = 0")
def ledger_merge(spark, d):
    """Two replicas that saw different grants merge to their union."""
    g = ledger.grants(trades(spark, d))
    return ledger.merge(g.filter("gene % 3 <> 0"), g.filter("gene % 2 = 0"), g.filter("gene % 2 = 0"))


@query("popularity", f"{T} SELECT want, count(DISTINCT proposer) AS popularity FROM trades WHERE state = 'accepted' GROUP BY want")
def popularity(spark, d):
    return ledger.popularity(trades(spark, d).filter("state = 'accepted'"), "want", "proposer")


@query("canonical_events", f"{T} SELECT want, min((epoch, proposer, trade_id))[1] AS epoch, min((epoch, proposer, trade_id))[2] AS proposer, min((epoch, proposer, trade_id))[3] AS trade_id FROM trades GROUP BY want")
def canonical_events(spark, d):
    order = [F.col("epoch"), F.col("proposer"), F.col("trade_id")]
    return ledger.canonical(trades(spark, d), "want", order, ["epoch", "proposer", "trade_id"])


@query("trade_lifecycle", f"{T}, e AS (SELECT offer, CASE WHEN state = 'withdrawn' OR (state = 'accepted' AND counter <> proposer) THEN (epoch, trade_id, state) END AS k FROM trades) SELECT offer, coalesce(min(k)[3], 'proposed') AS state FROM e GROUP BY offer")
def trade_lifecycle(spark, d):
    return ledger.lifecycle(trades(spark, d), "offer", [F.col("epoch"), F.col("trade_id")], "state", "counter", "proposer")


@query("cell_claims", f"{T} SELECT want % 64 AS x, offer % 64 AS y, count(DISTINCT counter) AS claims FROM trades GROUP BY ALL HAVING count(DISTINCT counter) > 1")
def cell_claims(spark, d):
    t = trades(spark, d).select((F.col("want") % 64).alias("x"), (F.col("offer") % 64).alias("y"), "counter")
    return ledger.contested(t, ["x", "y"], "counter")


@query("claim_sets", f"{T} SELECT want % 64 AS x, array_to_string(list_sort(list(DISTINCT counter % 16)), ',') AS owners FROM trades GROUP BY ALL")
def claim_sets(spark, d):
    t = trades(spark, d).select((F.col("want") % 64).alias("x"), (F.col("counter") % 16).alias("o"))
    return t.groupBy("x").agg(F.array_join(F.array_sort(F.collect_set("o")).cast("array<string>"), ",").alias("owners"))


@query("rect_owner", "WITH regions(ord, owner, c, r, w, h) AS (VALUES (0, 'header', 0, 0, 40, 1), (1, 'deck', 0, 1, 10, 30), (2, 'cube', 10, 1, 20, 20), (3, 'shutter', 20, 15, 15, 10)) SELECT p_partkey, coalesce(arg_min(owner, ord), 'field') AS owner FROM part LEFT JOIN regions ON p_size >= c AND p_size < c + w AND p_partkey % 40 >= r AND p_partkey % 40 < r + h GROUP BY p_partkey")
def rect_owner(spark, d):
    """First region that holds a point; the regions are few and fixed, so they are one array literal."""
    regions = [("header", 0, 0, 40, 1), ("deck", 0, 1, 10, 30), ("cube", 10, 1, 20, 20), ("shutter", 20, 15, 15, 10)]
    x, y = F.col("p_size"), F.col("p_partkey") % 40
    owner = F.coalesce(*[F.when((x >= c) & (x < c + w) & (y >= r) & (y < r + h), F.lit(n)) for n, c, r, w, h in regions], F.lit("field"))
    return table(spark, d, "part").select("p_partkey", owner.alias("owner"))


@query("claim_conflicts", "WITH c AS (SELECT DISTINCT l_suppkey AS place, l_returnflag AS owner FROM lineitem) SELECT a.place, a.owner AS a, b.owner AS b FROM c a JOIN c b ON a.place = b.place AND a.owner < b.owner WHERE NOT (a.owner = 'A' AND b.owner = 'N')")
def claim_conflicts(spark, d):
    """Pairs of owners of a place, less fused pairs: owners of a place are a small distinct set."""
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("place"), F.col("l_returnflag").alias("owner")).distinct()
    s = c.groupBy("place").agg(F.array_sort(F.collect_set("owner")).alias("o"))
    p = s.select("place", F.explode("o").alias("a"), "o").select("place", "a", F.explode(F.filter("o", lambda x: x > F.col("a"))).alias("b"))
    return p.filter("NOT (a = 'A' AND b = 'N')")


@query("skyline", "WITH p AS (SELECT p_partkey, p_brand, p_size AS high, p_retailprice AS low FROM part) SELECT a.p_partkey, a.p_brand FROM p a WHERE a.high > 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.p_brand = a.p_brand AND b.high >= a.high AND b.low <= a.low AND (b.high > a.high OR b.low < a.low))")
def skyline(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").alias("high"), F.col("p_retailprice").alias("low"))
    return ledger.skyline(p, ["p_brand"], "high", "low").select("p_partkey", "p_brand")


PARENTS = "edges AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey // 3 > 0)"


def _edges(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("child"), F.call_function("div", F.col("c_custkey"), F.lit(3)).alias("parent"))
    return c.filter("parent > 0")


@query("lineage_closure", f"WITH RECURSIVE {PARENTS}, c(node, ancestor) AS (SELECT child, parent FROM edges UNION SELECT c.node, e.parent FROM c JOIN edges e ON e.child = c.ancestor) SELECT * FROM c")
def lineage_closure(spark, d):
    return graph.closure(_edges(spark, d))


@query("influence", f"WITH RECURSIVE {PARENTS}, c(node, ancestor) AS (SELECT child, parent FROM edges UNION SELECT c.node, e.parent FROM c JOIN edges e ON e.child = c.ancestor) SELECT ancestor AS gene, count(*) AS influence FROM c GROUP BY ancestor")
def influence(spark, d):
    return graph.closure(_edges(spark, d)).groupBy(F.col("ancestor").alias("gene")).agg(F.count("*").alias("influence"))


@query("generation", f"WITH RECURSIVE {PARENTS}, g(node, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey // 3 = 0 UNION ALL SELECT e.child, depth + 1 FROM g JOIN edges e ON e.parent = g.node) SELECT node, max(depth) AS depth FROM g GROUP BY node")
def generation(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return graph.generations(nodes, _edges(spark, d))


@query("orphan_genes", "SELECT c_custkey FROM customer WHERE c_custkey // 2 > 0 AND c_custkey % 5 = 0 AND c_custkey // 2 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)")
def orphan_genes(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 5 = 0 AND c_custkey > 1").select("c_custkey", F.array(F.call_function("div", F.col("c_custkey"), F.lit(2))).alias("parents"))
    return ledger.orphans(c, "c_custkey", "parents")


GUILDS = "e AS (SELECT DISTINCT least(s_suppkey, s_nationkey + 100000) AS a, greatest(s_suppkey, s_nationkey + 100000) AS b FROM supplier), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT x, x FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.reach), lab AS (SELECT node, min(reach) AS label FROM r GROUP BY node)"


def _guilds(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 100000).cast("long").alias("b"))
    return graph.components(s)


@query("guild_components", f"WITH RECURSIVE {GUILDS} SELECT node, label FROM lab")
def guild_components(spark, d):
    return _guilds(spark, d)


@query("oversize_guilds", f"WITH RECURSIVE {GUILDS} SELECT label, count(*) AS size FROM lab GROUP BY label HAVING count(*) > 1")
def oversize_guilds(spark, d):
    return _guilds(spark, d).groupBy("label").agg(F.count("*").alias("size")).filter("size > 1")


def _ranked(spark, d, *order):
    return members(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("guild").orderBy(*order))).select("guild", "id", "rank")


M = f"WITH {MEMBERS_SQL}"


@query("govern_merit", f"{M} SELECT guild, id, row_number() OVER (PARTITION BY guild ORDER BY prestige DESC, id) AS rank FROM members")
def govern_merit(spark, d):
    return _ranked(spark, d, F.desc("prestige"), "id")


@query("govern_gerontocracy", f"{M} SELECT guild, id, row_number() OVER (PARTITION BY guild ORDER BY tenure DESC, id) AS rank FROM members")
def govern_gerontocracy(spark, d):
    return _ranked(spark, d, F.desc("tenure"), "id")


@query("govern_monarchy", f"{M}, s AS (SELECT *, min(id) OVER (PARTITION BY guild) AS king FROM members) SELECT guild, id, row_number() OVER (PARTITION BY guild ORDER BY id <> king, prestige DESC, id) AS rank FROM s")
def govern_monarchy(spark, d):
    m = members(spark, d)
    kings = m.groupBy("guild").agg(F.min("id").alias("king"))
    order = Window.partitionBy("guild").orderBy(F.col("id") != F.col("king"), F.desc("prestige"), "id")
    return m.join(kings, "guild").withColumn("rank", F.row_number().over(order)).select("guild", "id", "rank")


@query("council", f"{M} SELECT guild, id, row_number() OVER (PARTITION BY guild ORDER BY prestige DESC, id) AS rank FROM members QUALIFY rank <= 7")
def council(spark, d):
    return _ranked(spark, d, F.desc("prestige"), "id").filter("rank <= 7")


@query(
    "majority_judgment",
    """WITH v AS (SELECT s_nationkey AS cand, list_sort(list(CAST(floor(s_acctbal / 1000) AS BIGINT))) AS g FROM supplier GROUP BY 1), k AS (SELECT cand, g, len(g) AS n, (len(g) - 1) // 2 AS m FROM v),
    s AS (SELECT cand, [g[m + (CASE WHEN (n % 2 = 1) = (i % 2 = 0) THEN (i + 1) // 2 ELSE -((i + 1) // 2) END) + 1] FOR i IN range(n)] AS key FROM k)
    SELECT cand, row_number() OVER (ORDER BY key DESC, cand) AS rank FROM s""",
)
def majority_judgment(spark, d):
    """Candidates (nations) by the grades of their suppliers; one row a candidate is ordered."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("cand")).agg(F.collect_list(F.floor(F.col("s_acctbal") / 1000).cast("long")).alias("g"))
    k = s.select("cand", ledger.median_key(F.col("g")).alias("key"))
    return k.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("key"), "cand"))).select("cand", "rank")


@query("browse_feed", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5")
def browse_feed(spark, d):
    o = table(spark, d, "orders").filter("o_orderdate IS NOT NULL")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return o.withColumn("rank", r).filter("rank <= 5").select("o_orderkey", "o_custkey", "rank")


@query("key_search", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#23' OR list_contains(string_split(lower(p_name), ' '), 'green')")
def key_search(spark, d):
    p = table(spark, d, "part")
    return p.filter((F.col("p_brand") == "Brand#23") | F.array_contains(F.split(F.lower("p_name"), " "), "green")).select("p_partkey")


@query("even_subsample", "WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label, k::INTEGER AS k, vec_id FROM n JOIN (SELECT unnest(generate_series(0, 7)) AS k) g ON i = k * n // 8")
def even_subsample(spark, d):
    """Eight evenly spread rows of each frame: row floor(k n / 8)."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label")
    n = e.select("label", "vec_id", (F.row_number().over(w.orderBy("vec_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    k = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda x: F.call_function("div", x * F.col("n"), F.lit(8)) == F.col("i"))
    return n.select("label", F.explode(k).alias("k"), "vec_id")


@query("weave_counts", "WITH RECURSIVE w(n, word) AS (SELECT 0, '' UNION ALL SELECT n + p, word || s FROM w, (VALUES (4, 'a'), (2, 'b'), (1, 'c')) t(p, s) WHERE n + p <= 10) SELECT n, count(*) AS words, min(word) AS first_word FROM w GROUP BY n")
def weave_counts(spark, d):
    """Words of parts 4, 2 and 1 by their sum, up to 10."""
    return spark.sql("""WITH RECURSIVE w(n, word) AS (SELECT 0, CAST('' AS STRING) UNION ALL SELECT n + p, concat(word, s) FROM w JOIN (VALUES (4, 'a'), (2, 'b'), (1, 'c')) t(p, s) ON n + p <= 10)
        SELECT n, count(*) AS words, min(word) AS first_word FROM w GROUP BY n""")


@query("crc_sha", "SELECT page_id, sha256(url) AS sha256, length(html) AS n FROM pages")
def crc_sha(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("url").cast("binary"), 256).alias("sha256"), F.length("html").cast("long").alias("n"))


@query("rate_distortion", "WITH x AS (SELECT l_returnflag AS method, l_linenumber AS k, l_discount AS y FROM lineitem) SELECT method, k, round(avg(y), 6) AS mean, round(1.96 * stddev_samp(y) / sqrt(count(*)), 8) AS ci FROM x GROUP BY ALL")
def rate_distortion(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("k"), F.col("l_discount").alias("y"))
    return x.groupBy("method", "k").agg(F.round(F.avg("y"), 6).alias("mean"), F.round(1.96 * F.stddev_samp("y") / F.sqrt(F.count("*")), 8).alias("ci"))
