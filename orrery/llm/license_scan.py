"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram hash of a document's words is joined to the positions of the templates' k-grams. A match at document position
i and template position j votes for diagonal i - j. Votes are counted by (document, template, diagonal); diagonals that lie near
each other merge to one candidate span, so that a template with some words added, left out or replaced still gathers its votes; a
span is verified by the share of the template's words that its votes cover.

Each position gives one gram for each k in use: base phrases have two to four words, and use k of 2 or 3; longer templates use 4.
The templates are a fixed list, of some hundred grams, and so is the broadcast side of the join. Documents are read, split and
hashed once, and only votes are shuffled, in sums: a document's row travels with its votes as a sentinel, in place of a join back.

A gram's row holds the gram, not its text, and neighbouring diagonals are cut where the gap is too wide, so that work and memory grow with a text's length and matches alone.

Defined cases: a null text counts as empty; an empty text gives a row without labels; repeated rows (the same doc_id, null ids
included, and the same text) travel as one with their number and give a row each; other columns are ignored; an empty table gives an empty
result. Of two labels at one place, both are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import ASCII_LOWER, ASCII_UPPER, need, spread

#: Words are cut before lower-casing: the class holds A-Z beside what the lower-cased text's pattern holds. Fixed values.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()

    @property
    def k(self) -> int:
        n = len(self.words)
        return n if n <= 3 else 4


#: Phrases whose places are counted, and further license texts. Fixed values.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Share of a template's words that a span's votes must cover, and how far apart merged diagonals may lie, in words.
MIN_COVER, NEAR = 0.8, 3


def _gram(words, start, k: int):
    """The k words from a place in an array column, joined; null where fewer are left."""
    return F.when(start + k <= F.size(words), F.concat_ws(" ", *(F.get(words, start + i) for i in range(k))))


def _hashed(k: int):
    """The hash of the k-gram at each start."""
    return F.transform("starts", lambda i: F.struct(i.alias("start"), F.lit(k).alias("gram_words"), _gram(F.col("words"), i, k).alias("found")))


def template_grams(spark, templates: tuple[Template, ...]) -> DataFrame:
    """A row for each template position: k, gram, template number, place in it, number of grams."""
    rows = [(t.k, " ".join(t.words[j : j + t.k]), n, j, len(t.words)) for n, t in enumerate(templates) for j in range(len(t.words) - t.k + 1)]
    return spark.createDataFrame(rows, "k int, gram string, template int, place int, template_words int")


def votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each match of a gram, and one for each document with a null template: id, copy (of the text), n_words, template, place, start."""
    grams = template_grams(docs.sparkSession, templates)
    grams = F.broadcast(grams.withColumn("hash", F.xxhash64("k", "gram")))
    ks = sorted({t.k for t in templates})
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("copy"), F.regexp_extract_all(lower, F.lit(RAW_WORD), F.lit(0)).alias("words"))

    # The hash of a gram is taken from the words themselves, as that of a template's gram is; words of no template can start none.
    first = sorted({" ".join(t.words[j : j + 1]) for t in templates for j in range(len(t.words) - t.k + 1)})
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(first))
    rows = rows.select("id", "copy", "words", F.when(F.size("words") > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"))
    hits = F.flatten(F.array(*(_hashed(k) for k in ks)))
    one = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("gram_words"), F.lit(None).cast("string").alias("found")))
    found = rows.select("id", "copy", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(one, hits)).alias("g")).select("id", "copy", "n_words", "g.start", "g.found", F.xxhash64("g.gram_words", "g.found").alias("hash"))
    joined = found.join(grams, "hash", "left").where((F.col("start") == -1) | (F.col("gram") == F.col("found")))
    return joined.select("id", "copy", "n_words", F.when(F.col("start") >= 0, F.col("template")).alias("template"), "place", F.when(F.col("start") >= 0, F.col("start")).alias("start"), "k", "template_words")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", min_cover: float = MIN_COVER, near: int = NEAR) -> DataFrame:
    """The verified spans: a row for each document, with an array of spans (label, base, first_word, last_word, cover).

    first_word and last_word are the first and last word of the span, words from 0; cover is the share of the template's words found.
    """
    need(docs, doc_id, text)
    spark = docs.sparkSession
    named = F.broadcast(spark.createDataFrame([(n, t.label, t.base) for n, t in enumerate(templates)], "template int, label string, base boolean"))
    # Votes by diagonal, as sums on the map side; the places voted for are at most the template's, whatever the document's length.
    by_diagonal = (
        votes(docs, templates, doc_id, text)
        .groupBy("id", "copy", "template", (F.col("start") - F.col("place")).alias("diagonal"))
        .agg(F.first("n_words").alias("n_words"), F.count("*").alias("rows"), F.collect_set("place").alias("places"), F.first("k").alias("k"), F.first("template_words").alias("template_words"))
    )
    # An exact place votes on one diagonal with all its grams; short templates need no merging, and their near places must stay apart.
    whole = F.size("places") == F.col("template_words") - F.col("k") + 1
    exact = F.collect_list(F.when(F.col("template").isNotNull() & whole, F.col("diagonal")))
    by_template = by_diagonal.groupBy("id", "copy", "template").agg(
        F.first("n_words").alias("n_words"), F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("rows"), exact.alias("exact"),
        F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("diagonal", "places")))).alias("diagonals"), F.first("k").alias("k"), F.first("template_words").alias("template_words"),
    )
    # Neighbouring diagonals merge: a chain of sorted diagonals begins where the one before is further than near words away. Each step reads the last one's columns, and slices are cut once.
    at = lambda i: F.get("diagonals", i)
    begins = F.filter(F.sequence(F.lit(0), F.size("diagonals") - 1), lambda i: (i == 0) | (at(i)["diagonal"] - at(i - 1)["diagonal"] > near))
    by_template = by_template.withColumn("begins", F.when(F.size("diagonals") > 0, begins).otherwise(F.array().cast("array<int>")))
    pieces = F.transform("begins", lambda b, j: F.slice("diagonals", b + 1, F.coalesce(F.get("begins", j + 1), F.size("diagonals")) - b))
    by_template = by_template.withColumn("pieces", pieces)
    chains = F.transform("pieces", lambda p: F.struct(F.get(p, F.lit(0))["diagonal"].alias("first"), F.element_at(p, -1)["diagonal"].alias("last"), F.array_distinct(F.flatten(F.transform(p, lambda d: d["places"]))).alias("places")))
    by_template = by_template.withColumn("chains", chains)
    covered = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c["places"], lambda p: F.sequence(p, p + F.col("k") - 1))))) / F.col("template_words")
    loose = F.filter(
        F.transform("chains", lambda c: F.struct((F.array_min(c["places"]) + c["first"]).cast("long").alias("first_word"), (F.array_max(c["places"]) + c["last"] + F.col("k") - 1).cast("long").alias("last_word"), covered(c).alias("cover"))),
        lambda s: s["cover"] >= min_cover,
    )
    tight = F.transform(F.array_sort("exact"), lambda d: F.struct(d.cast("long").alias("first_word"), (d + F.col("template_words") - 1).cast("long").alias("last_word"), F.lit(1.0).alias("cover")))
    spans = by_template.join(named, "template", "left").select(
        "id", "copy", "n_words", "rows", F.transform(F.when(F.col("k") == F.col("template_words"), tight).otherwise(loose), lambda s: F.struct(F.col("label").alias("label"), F.col("base").alias("base"), s["first_word"].alias("first_word"), s["last_word"].alias("last_word"), s["cover"].alias("cover"))).alias("spans")
    )
    whole = spans.groupBy("id", "copy").agg(F.max("n_words").alias("n_words"), F.max("rows").alias("rows"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return whole.select(F.col("id").alias(doc_id), "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("col")


def query(docs: DataFrame) -> DataFrame:
    """Result of op1: a row for each document. The score is the highest cover of a span, 0 without spans."""
    out = scan(spread(docs.select("doc_id", "text")))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    joined = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).cast(T.DoubleType()).alias("score"),
    )


#: Labels and score are the method's own; what the contract fixes is compared on its own columns.
BASE_ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p(label, phrase) AS (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])),
hits AS (SELECT doc_id, label, i - 1 AS start FROM (SELECT doc_id, label, phrase, words, unnest(range(1, len(words) + 1)) AS i FROM w, p) WHERE words[i:i + len(phrase) - 1] = phrase),
h AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels
FROM w LEFT JOIN h USING (doc_id)
"""
