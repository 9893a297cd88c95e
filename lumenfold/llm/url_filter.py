"""URL filters: a trie over reversed host labels and path segments.

Rules are strings ``host/path`` with an action, ``allow`` or ``block``. A rule
fits its host and every subdomain of it, if the url's path starts with the
rule's path. Among fitting rules the longest (in characters) wins; of equally
long ones the one with the longer host, then ``block`` before ``allow``.

The trie is broadcast, so its size is checked first: a rule set of more than
``max_broadcast_rules`` rows takes the join path, which explodes each url's
host suffixes and path prefixes (a handful of keys a url) and joins them with
the rules, both sides hash-partitioned.

Null urls, urls without ``://`` and empty urls have an empty host and path and
fit no rule. Repeated rows each get their own verdict. An empty table gives an
empty result. Rules that are null or have no host are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import lower_ascii, table

#: Host and path of a url: after the first ://, up to / ? # or the end.
URL_PATTERN = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
#: The contract's rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Tasks over which one key of the join form is dealt.
SALTS = 16
MAX_BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATTERN, 2)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in host), slash + path


def precedence(rule: str, action: str) -> tuple[int, int, int]:
    host, _ = split_rule(rule)
    return len(rule), len(host), int(action == "block")


class UrlTrie:
    """Nodes are dicts; key ``""`` never names a label, so slots use ints.

    Host labels come from the right. Slot 0 of a host node holds the path
    trie: whole segments lead down, and slot 0 there lists the open tails
    (the part behind the rule's last slash) with their rules.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for rule, action in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(0, {})
            *whole, tail = path[1:].split("/") if path else [None]
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(0, []).append((tail, rule, action))

    def _paths(self, node: dict, path: str):
        for tail, rule, action in node.get(0, ()):
            if tail is None or path.startswith("/" + tail):
                yield rule, action
        if not path.startswith("/"):
            return
        segments = path[1:].split("/")
        for i, segment in enumerate(segments[:-1]):
            node = node.get(segment)
            if node is None:
                return
            for tail, rule, action in node.get(0, ()):
                if tail is not None and segments[i + 1].startswith(tail):
                    yield rule, action

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, found = None, (None, None)
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if 0 in node:
                for rule, action in self._paths(node[0], path):
                    rank = precedence(rule, action)
                    if best is None or rank > best:
                        best, found = rank, (rule, action)
        return found


def _by_trie(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("action", T.StringType())])

    @F.pandas_udf(kind)
    def look_up(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        return pd.DataFrame([match(h, p) for h, p in zip(host, path)], columns=["rule", "action"], dtype=object)

    return pages.withColumn("_m", look_up("_host", "_path"))


def _by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates of a distinct (host, path) are its host suffixes times its whole path prefixes.

    Most urls share a suffix such as ``com`` and many may share one host and
    path, so both joins deal their keys over ``SALTS`` tasks.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    keyed = rules.select(
        lower_ascii(F.substring_index("rule", "/", 1)).alias("_h"),
        F.regexp_extract("rule", r"^[^/]*((?:/.*)?/)[^/]*$", 1).alias("_p"),
        F.regexp_extract("rule", r"([^/]*)$", 1).alias("_tail"),
        F.expr("instr(rule, '/') > 0").alias("_slash"), "rule", "action", salts.alias("_salt"),
    )
    distinct = pages.select("_host", "_path").distinct()
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pieces = F.split("_path", "/", -1)
    prefixes = F.when(F.col("_path").startswith("/"), F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/"))))).otherwise(F.array(F.lit("")))
    keys = distinct.withColumn("_salt", F.pmod(F.xxhash64("_host", "_path"), F.lit(SALTS)).cast("int")).withColumn("_h", F.explode(suffixes)).withColumn("_p", F.explode(prefixes))
    hit = keys.join(keyed, ["_h", "_p", "_salt"]).filter(~F.col("_slash") | F.substring(F.col("_path"), F.length("_p") + 1, 1 << 30).startswith(F.col("_tail")))
    best = hit.groupBy("_host", "_path").agg(
        F.max(F.struct(F.length("rule").alias("n"), F.length("_h").alias("h"), (F.col("action") == "block").alias("b"), "rule", "action")).alias("_m")
    )
    dealt = pages.withColumn("_salt", F.spark_partition_id() % SALTS)
    return dealt.join(best.withColumn("_salt", salts), ["_host", "_path", "_salt"], "left")


def filter_urls(pages: DataFrame, rules, url_col: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules``: pairs (rule, action), or a DataFrame of columns rule and action.
    Columns of ``pages`` with these four names are replaced.
    """
    if isinstance(rules, DataFrame):
        rules = rules.filter("rule IS NOT NULL AND action IN ('allow', 'block') AND rule NOT LIKE '/%' AND rule <> ''").select("rule", "action")
        small = rules.limit(max_broadcast_rules + 1).collect()
        trie_rules = [tuple(r) for r in small] if len(small) <= max_broadcast_rules else None
    else:
        trie_rules = [(r, a) for r, a in rules if r and not r.startswith("/")]
        if len(trie_rules) > max_broadcast_rules:
            rules, trie_rules = pages.sparkSession.createDataFrame(trie_rules, "rule string, action string"), None
    # aside: the row as a struct, so no column of the input can clash
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    out = _by_trie(rows, trie_rules) if trie_rules is not None else _by_join(rows, rules)
    keep = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_m.rule").alias("rule"), F.coalesce("_m.action", F.lit(default)).alias("verdict"))


def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rule, h, p, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.action, 'allow') AS verdict FROM (
    SELECT u.*, (SELECT arg_max(struct_pack(rule := rule, action := action), length(rule)) FROM r
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS m FROM u)
"""
