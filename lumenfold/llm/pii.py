"""Personal data: patterns, and terms that disclose them.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone
numbers, leftmost and non-overlapping per kind, found over whole texts. Offsets
come from one split and one extraction per pattern, whose pieces interleave.

Information-theoretic sanitisation adds terms. The protected entities are the
kinds of base spans and every single value of them (one address, one number).
With p(e) the share of documents that hold entity e, the information of e is
IC(e) = -log p(e), and a term t discloses PMI(t, e) = log(p(e | t) / p(e)) of
it; all counts are of whole documents, by the words outside base spans. As
counts are small, p(e | t) is its lower confidence bound (Wilson's, one-sided,
``Z``), so that words which meet an entity by chance stay. The term discloses
too much if PMI >= ``ALPHA`` * IC for an entity that it meets in a document,
p(e) < 1, and it is not a bare number. (So a word of one document discloses a
value only if that is rare in the corpus, p(e) <= 0.0127, and a word of two
documents a value of one of them only if p(e) <= 0.00087.) Every
place of such a term outside base spans, in any document, becomes a span of kind
``term``; the sanitised text has each span replaced by the kind it is or, for a
term, the kind of the entity it discloses most of (largest PMI, then in the
order of ``KINDS``).

All counts cover all documents. Patterns run once over the texts; their spans,
and each document's words, are stored. Only words of documents that hold an
entity can tell one; the words of all documents are counted inside the tasks
before they are shuffled to meet these candidates. A term of one document brings that document along in its count; the others meet the documents
by a broadcast whose size is checked, or else by a shuffle. Texts are joined
once, with the spans and terms of the documents that have any.

Everything inside a text takes time in proportion to its length or a little
more: lists are walked in chunks, texts are cut by byte offsets, and terms are
looked for in a copy whose base spans are blank.

Defined cases: null texts are empty and have no spans; identical rows (same id
and text) each get the same result; a digit group that fails its check is
dropped without another try; empty tables give no rows. Text of any length is
read whole. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import SEPARATORS, discard, fits_broadcast, lower_ascii, stored, table, words_of

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, with possessive repeats and without retries inside a run, which changes no match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it has no match that counts.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Elements that one step of a walk over a list handles.
CHUNK = 128
ALPHA = 0.7
#: Standard deviations of the confidence bound: 95 % of one side.
Z = 1.645


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    ) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """use(value), with ``value`` evaluated once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(items: Column, state: Column, step, out, kind: str) -> Column:
    """struct<s, o>: the last state of a walk over a non-empty array, and out(state, item) of every item.

    A list that grows by one is copied each time, so it grows inside a chunk,
    and the list of chunks by one a chunk. kind: type of an output.
    """

    def chunk(first: Column, own: Column) -> Column:
        return F.aggregate(own, F.struct(first.alias("s"), F.array().cast(f"array<{kind}>").alias("o")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["o"], F.array(out(a["s"], x))).alias("o")))

    def walk(every: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int"))
        return F.aggregate(
            starts, F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o")),
            lambda a, c: _once(chunk(a["s"], F.slice(every, c * CHUNK + 1, F.lit(CHUNK))), lambda r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o"))),
        )

    return _once(_once(items, walk), lambda w: F.struct(w["s"].alias("s"), F.flatten(w["o"]).alias("o")))


PLACE = "start int, end int, from int, to int"
MATCH = f"struct<{', '.join(p.replace(' ', ':') for p in PLACE.split(', '))}, m:string>"
SPAN = f"struct<{', '.join(p.replace(' ', ':') for p in PLACE.split(', '))}>"


def walk_matches(text: Column, pattern) -> Column:
    """array<MATCH> of all matches: start and end in code points, from and to in bytes, ends exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    cut = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.split(text, pattern, F.lit(-1)).alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))
    n, size = F.length, lambda x: F.octet_length(x)
    # lengths of pieces and matches tell where each match starts
    step = lambda s, x: F.struct((s["at"] + n(x["p"]) + n(x["m"])).alias("at"), (s["byte"] + size(x["p"]) + size(x["m"])).alias("byte"))

    def place(s: Column, x: Column) -> Column:
        at, byte = s["at"] + n(x["p"]), s["byte"] + size(x["p"])
        return F.struct(at.alias("start"), (at + n(x["m"])).alias("end"), byte.alias("from"), (byte + size(x["m"])).alias("to"), x["m"].alias("m"))

    def walk(c: Column) -> Column:
        both = F.zip_with(F.slice(c["pieces"], 1, F.size(c["matches"])), c["matches"], lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        return F.when(F.size(c["matches"]) > 0, _fold(both, zero, step, place, MATCH)["o"]).otherwise(F.array().cast(f"array<{MATCH}>"))

    return _once(cut, walk)


def spans_of(text: Column, kind: str) -> Column:
    """array<SPAN> of one kind."""
    return F.transform(F.filter(walk_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["m"])), lambda s: F.struct(s["start"], s["end"], s["from"], s["to"]))


def base_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Add one span array a kind: spans_email, spans_ip, spans_card, spans_phone."""
    text, none = F.col(text_col), F.array().cast(f"array<{SPAN}>")
    for kind in KINDS:
        there = text.contains(NEEDS[kind]) if NEEDS[kind] == "@" else text.rlike(NEEDS[kind])
        rows = rows.withColumn(f"spans_{kind}", F.when(there, spans_of(text, kind)).otherwise(none))
    return rows


def _labelled(spans: Column, label) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to"), label(s).alias("label")))


def _every() -> Column:
    """All base spans with their kind, sorted."""
    return F.array_sort(F.flatten(F.array(*[_labelled(F.col(f"spans_{k}"), lambda s, k=k: F.lit(k)) for k in KINDS])))


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with sorted spans replaced by put(span, start), start behind all spans before it; a span inside others goes."""

    def build(raw: Column, own: Column) -> Column:
        cut = lambda a, b: F.when(b > a, F.substring(raw, a + 1, b - a).cast("string")).otherwise(F.lit(""))
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))
        step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.greatest(s["byte"], x["to"]).alias("byte"))
        out = lambda s, x: F.concat(cut(s["byte"], x["from"]), F.when(x["end"] > s["at"], put(x, F.greatest(s["at"], x["start"]))).otherwise(F.lit("")))
        return _once(_fold(own, zero, step, out, "string"), lambda w: F.concat(F.array_join(w["o"], ""), cut(w["s"]["byte"], F.octet_length(raw))))

    return _once(F.struct(text.cast("binary").alias("raw"), spans.alias("own")), lambda c: F.when(F.size(c["own"]) > 0, build(c["raw"], c["own"])).otherwise(c["raw"].cast("string")))


def blanked(text: Column, spans: Column) -> Column:
    """The text with a space for every character of its spans, so that places stay (base spans are ASCII)."""
    return _replaced(text, spans, lambda s, start: F.repeat(F.lit(" "), s["end"] - start))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its sorted, labelled spans replaced by [label]; of overlapping ones the first label stays, and nothing of the text they cover."""
    return _replaced(text, spans, lambda s, start: F.when(start == s["start"], F.concat(F.lit("["), s["label"], F.lit("]"))).otherwise(F.lit("")))


def _values(text: Column, kind: str) -> Column:
    """The values of one kind in a text, each once, as array<struct<kind, value>>: a hash of a number's digits, of lower case otherwise."""
    cut = _once(text.cast("binary"), lambda raw: F.transform(f"spans_{kind}", lambda s: lower_ascii(F.substring(raw, s["from"] + 1, s["to"] - s["from"]).cast("string"))))
    if kind in ("card", "phone"):
        cut = F.transform(cut, _digits)
    return F.transform(F.array_distinct(cut), lambda v: F.struct(F.lit(kind).alias("kind"), F.xxhash64(v).alias("value")))


def _places(text: Column, words: Column) -> Column:
    """array<MATCH>: every place of one of ``words`` as a whole word."""
    own = f"[^{SEPARATORS}]"
    return walk_matches(text, F.concat(F.lit(f"(?i)(?<!{own})(?:"), F.array_join(words, "|"), F.lit(f")(?!{own})")))


def least_share(both, of):
    """Wilson's lower bound of the share both / of; of columns or numbers."""
    p, z = both / of, Z * Z / of
    root = (z * p * (1 - p) + z * z / 4) ** 0.5
    return (p + z / 2 - root) / (1 + z)


def _hint(df: DataFrame, of: str, extra: int = 64):
    """``F.broadcast`` if the stored ``df``, whose longest column is the string ``of``, is small enough."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length(of)), F.lit(0)).alias("s")).first()
    return F.broadcast if fits_broadcast(size["n"], extra + size["s"]) else (lambda x: x)


def _pmi(both, of, share):
    """Information that a term of ``of`` documents gives about an entity of that share, met in ``both`` of them."""
    return F.log(least_share(both, of) / share)


def telling_terms(held: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """The disclosing terms of one document (doc_id, key, term, discloses), and those of several (term, discloses).

    held: doc_id, key, words, values and, per kind, whether the document holds it.
    """
    n_kind = held.agg(F.count("*").alias("n"), *[F.sum(F.col(k).cast("long")).alias(k) for k in KINDS]).first()
    total = float(max(1, n_kind["n"]))
    enough = lambda pmi, share: (share < 1) & (pmi >= -F.log(share) * alpha - 1e-12)
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, -i)]), F.col("kind"))
    holders = held.filter(" OR ".join(KINDS))
    candidates = stored(
        holders.select("doc_id", "key", F.explode("words").alias("term"), *[F.col(k).cast("long").alias(k) for k in KINDS])
        .groupBy("term").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), *[F.sum(k).alias(k) for k in KINDS])
        .filter(~F.col("term").rlike(r"^[0-9]+\z")), "pii-candidates")
    counts = held.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    words = stored(candidates.join(counts, "term"), "pii-terms")
    # values: in how many documents each stands, and the rarest of each document
    places = holders.select("doc_id", "key", F.explode("values").alias("v")).select("doc_id", "key", "v.*")
    n_value = stored(places.groupBy("kind", "value").agg(F.count("*").alias("n_value")), "pii-values")
    few = F.broadcast if fits_broadcast(n_value.count(), 64) else (lambda df: df)
    counted = stored(places.distinct().join(few(n_value), ["kind", "value"]), "pii-counted")
    rarest = counted.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.min(F.struct("n_value", (-place).alias("place"), "kind")).alias("e"))
    share = F.col("e.n_value") / total
    single = words.filter("n_term = 1").join(rarest, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")))
    single = single.filter(enough(_pmi(F.lit(1.0), F.lit(1.0), share), share)).select("doc_id", "key", "term", F.col("e.kind").alias("discloses"))
    # terms of several documents: kinds; values of several documents, paired with words; and of the values that stand in one
    # document only, which all have one PMI for a word of it, the first in order of KINDS
    words = words.filter("n_term > 1")
    by_kind = words.select("term", "n_term", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_both"), F.lit((n_kind[k] or 0) / total).alias("share")) for k in KINDS])).alias("k")).select("term", "n_term", "k.*")
    one = F.col("n_value") == 1
    repeated = counted.groupBy("doc_id", "key").agg(
        F.collect_list(F.when(~one, F.struct("kind", "value", "n_value"))).alias("repeated"),
        F.max(F.when(one, F.struct(place.alias("place"), "kind"))).alias("alone"),
    )
    same = F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h.key") == F.col("r.key"))
    pairs = holders.alias("h").join(repeated.alias("r"), same).select("h.words", "r.repeated", "r.alone")
    # the most that a term of several documents can disclose of a value it meets so often
    hopeful = enough(_pmi(F.col("n_both"), F.greatest("n_both", F.lit(2)), F.col("n_value") / total), F.col("n_value") / total)
    by_value = (
        pairs.select("words", F.explode("repeated").alias("v")).select("v.*", F.explode("words").alias("term"))
        .groupBy("kind", "value", "term").agg(F.count("*").alias("n_both"), F.first("n_value").alias("n_value"))
        .filter(hopeful).select("term", "kind", "n_both", (F.col("n_value") / total).alias("share"))
    )
    by_alone = pairs.filter("alone IS NOT NULL").select("alone", F.explode("words").alias("term")).groupBy("term").agg(F.max("alone")["kind"].alias("kind"))
    by_alone = by_alone.select("term", "kind", F.lit(1).cast("long").alias("n_both"), F.lit(1 / total).alias("share"))
    if total > 1 and bool(least_share(1, 2) * total >= total**alpha * (1 - 1e-9)):  # else no word of two documents tells a value of one
        by_value = by_value.unionByName(by_alone)
    by_value = by_value.join(words.select("term", "n_term"), "term").select("term", "n_term", "kind", "n_both", "share")
    met = by_kind.unionByName(by_value).filter("n_both > 0").withColumn("pmi", _pmi(F.col("n_both"), F.col("n_term"), F.col("share")))
    several = met.filter(enough(F.col("pmi"), F.col("share"))).groupBy("term").agg(F.max(F.struct("pmi", place.alias("place"), "kind"))["kind"].alias("discloses"))
    return single, stored(several, "pii-telling")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """doc_id, span arrays of the four kinds, ``terms``: array<struct<start, end, from, to, label>>, and ``sanitised``: the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    spans = [f"spans_{k}" for k in KINDS]
    held = stored(
        base_spans(rows).select(
            "doc_id", "key", *spans, *[(F.size(s) > 0).alias(k) for k, s in zip(KINDS, spans)],
            F.flatten(F.array(*[_values(F.col("text"), k) for k in KINDS])).alias("values"),
            F.array_distinct(words_of(blanked(F.col("text"), _every()))).alias("words"),
        ), "pii-words")
    single, several = telling_terms(held, alpha)
    own = held.select("doc_id", "key", F.explode("words").alias("term")).join(_hint(several, "term")(several), "term").select("doc_id", "key", "term", "discloses").union(single)
    own = own.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("term", "discloses"))).alias("telling"))
    base = held.filter(" OR ".join(KINDS)).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", *spans)
    same = F.col("b.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("b.key") == F.col("o.key"))
    marks = base.alias("b").join(own.alias("o"), same, "full").select(F.coalesce("b.key", "o.key").alias("_key"), F.coalesce("b.doc_id", "o.doc_id").alias("_id"), *spans, "telling")
    marks = stored(marks, "pii-marks")
    discard(held, several)
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    joined = joined.select("doc_id", "text", *[F.coalesce(s, F.array().cast(f"array<{SPAN}>")).alias(s) for s in spans], "telling")
    found = _places(blanked(F.col("text"), _every()), F.array_sort(F.map_keys("telling")))
    terms = _labelled(found, lambda w: F.element_at("telling", lower_ascii(w["m"])))
    none = F.array().cast(f"array<{SPAN[:-1]}, label:string>>")
    joined = joined.withColumn("terms", F.when(F.col("telling").isNotNull(), terms).otherwise(none))
    return joined.select("doc_id", *spans, "terms", sanitised(F.col("text"), F.array_sort(F.concat(_every(), "terms"))).alias("sanitised"))


def span_list(kinds) -> Column:
    """kind:start:end of spans by kind, then start, comma-joined. kinds: (name, array column) pairs."""

    def part(kind, spans):
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.flatten(F.array(*[part(k, c) for k, c in kinds])), ",")


def op6_pii(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = [(k, F.col(f"spans_{k}")) for k in KINDS]
    return found.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base],
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list([*base, ("term", F.col("terms"))]).alias("spans"), "sanitised",
    )
