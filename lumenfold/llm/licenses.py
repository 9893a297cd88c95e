"""License scans by diagonal voting.

Every text's rolling word k-grams are joined with the k-grams of license
templates on their hash (and, as hashes may collide, on their words). A match
of document position p and template position q votes for the diagonal p - q.
Votes are counted per document, template and diagonal; a template found whole
votes on one diagonal at every position, while inserted or missing words move
the rest to a neighbouring diagonal, so diagonals at most ``DRIFT`` apart whose
spans lie near each other are merged. A merged span is verified by the share
of the template's k-grams that it covers, each k-gram counted once.

Templates are of two kinds. Phrases (``PHRASES``) must stand word by word: all
k-grams on one diagonal. Longer notices (``NOTICES``) need ``LEAST_COVER`` of
their k-grams. The k-gram table is fixed by these constants (a few hundred
rows), so it is broadcast; templates given by the caller are checked against
``MAX_TEMPLATE_GRAMS`` and joined by a shuffle beyond it.

Everything is DataFrame operations, and only matches and one row a document
are shuffled, never texts.

Defined cases: null texts are empty and hold no words; texts shorter than k
words have no k-gram; identical rows (same id and text) each get the same
result; empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD_TABLE, inline_rows, table, words_of

K = 2
DRIFT = 3
LEAST_COVER = 0.7
MAX_TEMPLATE_GRAMS = 100_000

#: The contract's phrases and labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening sentences of common license notices, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under the creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


def template_grams(spark, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """One row per template and position: gram, template, label, exact, place, n_grams."""
    rows = []
    for number, (text, label, exact) in enumerate([(t, x, True) for t, x in phrases] + [(t, x, False) for t, x in notices]):
        words = [w.decode() for w in text.encode().translate(WORD_TABLE).split()]
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {text!r}")
        n = len(words) - k + 1
        rows += [(" ".join(words[i : i + k]), number, label, exact, i, n) for i in range(n)]
    rows.append(("", -1, "", False, 0, 0))  # what the row in front of each document meets
    return inline_rows(spark, rows, "gram string, template int, label string, exact boolean, place int, n_grams int")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, k: int = K, least_cover: float = LEAST_COVER) -> DataFrame:
    """One row per document: doc_id, n_words, spans.

    spans: array<struct<exact, label, start, end, cover>> in words, end
    exclusive, sorted.
    """
    grams = template_grams(docs.sparkSession, phrases, notices, k).withColumn("hash", F.xxhash64("gram"))
    n_grams = sum(max(0, len(t.split()) - k + 1) for t, _ in [*phrases, *notices])
    hint = F.broadcast if n_grams <= MAX_TEMPLATE_GRAMS else (lambda df: df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), words_of(text).alias("words"))
    n = F.size("words")
    rolling = F.col("words")
    for j in range(1, k):
        shifted = F.slice("words", j + 1, F.greatest(n - j, F.lit(0)))
        rolling = F.zip_with(rolling, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    # zip_with pads the shorter side with null, so the last k - 1 grams are null and match nothing;
    # the row in front carries the document itself through the join
    rows = rows.select("doc_id", "key", n.alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), rolling)).alias("pos", "gram"))
    rows = rows.filter("gram IS NOT NULL").withColumn("hash", F.xxhash64("gram"))
    votes = rows.join(hint(grams), ["hash", "gram"]).select(
        "doc_id", "key", "n_words", "template", "label", "exact", "place", "n_grams", (F.col("pos") - 1).alias("pos"))
    doc = ["doc_id", "key", "n_words"]
    # votes per diagonal; copies: how often the same row occurs
    diagonal = votes.groupBy(*doc, "template", "label", "exact", "n_grams", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("place").alias("places"))
    # one element a diagonal; those of notices that cannot reach their cover in this text go before spans are merged
    by_doc = diagonal.groupBy(*doc).agg(
        F.sum(F.when(F.col("template") == -1, F.col("votes"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "diagonal", "first", "last", "places", "n_grams", "label", "exact")))).alias("hits"),
    )
    exact = F.transform(
        F.filter("hits", lambda h: h["exact"] & (F.size(h["places"]) == h["n_grams"])),
        lambda h: F.struct(h["exact"], h["label"], h["diagonal"].alias("start"), (h["diagonal"] + h["n_grams"] + (k - 1)).alias("end"), F.lit(1.0).alias("cover")),
    )
    able = F.array(*[F.lit(None).cast("int"), *[_able(number, least_cover) for number in range(len(phrases), len(phrases) + len(notices))]])
    loose = _merged(F.filter(F.col("hits"), lambda h: ~h["exact"] & F.array_contains("able", h["template"])), k, least_cover)
    by_doc = by_doc.withColumn("able", able)
    spans = F.array_sort(F.concat(exact, loose))
    return by_doc.withColumn("spans", spans).select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).drop("_n")


def _able(template: int, least_cover: float):
    """The template's number if the text holds enough of its places on whatever diagonals, else null."""
    own = F.filter("hits", lambda h: h["template"] == template)
    places = F.size(F.array_distinct(F.flatten(F.transform(own, lambda h: h["places"]))))
    return F.when(places >= F.get(own, 0)["n_grams"] * least_cover, F.lit(template))


def _merged(hits, k: int, least_cover: float):
    """Merge neighbouring diagonals of one template, in order of template and diagonal; keep what covers enough."""
    kind = "array<struct<template:int,diagonal:int,first:int,last:int,places:array<int>,n_grams:int,label:string>>"

    def step(acc, h):
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (last["template"] == h["template"]) & (h["diagonal"] - last["diagonal"] <= DRIFT) & (h["first"] - last["last"] <= h["n_grams"]) & (last["first"] - h["last"] <= h["n_grams"])
        joined = F.struct(
            h["template"].alias("template"), h["diagonal"].alias("diagonal"), F.least(last["first"], h["first"]).alias("first"), F.greatest(last["last"], h["last"]).alias("last"),
            F.array_union(last["places"], h["places"]).alias("places"), h["n_grams"].alias("n_grams"), h["label"].alias("label"))
        own = F.struct(*[h[c].alias(c) for c in ("template", "diagonal", "first", "last", "places", "n_grams", "label")])
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(own))).cast(kind)

    merged = F.aggregate(hits, F.array().cast(kind), step)
    good = F.filter(merged, lambda m: F.size(m["places"]) >= m["n_grams"] * least_cover)
    return F.transform(good, lambda m: F.struct(F.lit(False).alias("exact"), m["label"], m["first"].alias("start"), (m["last"] + k).alias("end"), (F.size(m["places"]) / m["n_grams"]).cast("double").alias("cover")))


def op5_licenses(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
