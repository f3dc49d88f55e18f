"""License scan: exact set-similarity join of text blocks with license templates.

Method. A block is any run of ``WINDOW`` consecutive words of the text (of twice the template's words
if those are more; the whole text if shorter), across line breaks. A template is a short license
statement taken as a set of words. A block matches a template if it holds at least ``THRESHOLD`` of
the template's words. The join is exact: words are ordered by how many documents of the whole corpus
hold them, rarest first; by the pigeonhole principle a block that matches holds one of the template's
first ``size - need + 1`` words (prefix and positional filter), and the words within a block's length
of that word, which hold the block, have at least ``need`` of the template's (length filter). Blocks
around what passes are verified on the full sets; a block may begin at a word of the template, as
words before the first one add nothing.

Scale. The templates are a fixed list (bounded; its size is asserted), so they stand in the plan as
literals and every block is tested where it is read: documents are neither shuffled nor joined. The
corpus-wide word counts are one aggregate over the template words found, with a row per word and
task. Everything is DataFrame expressions.

Defined cases: null text is empty; a text without words has no places, no labels and score 0;
repeated rows are treated alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts

# Fixed values.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Statements by which public licenses are commonly declared; SPDX-style labels of the method.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
THRESHOLD = 0.9
WINDOW = 64
MAX_TEMPLATE_WORDS = 10_000  # the bound up to which templates stand in the plan


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct, rarest first
    need: int
    span: int  # words of a block

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z are already in lower case."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def with_words(docs: DataFrame) -> DataFrame:
    rows = texts(docs).withColumn("text", lower_ascii(F.col("text")))
    return rows.withColumn("words", words_of(F.col("text")))


def vocabulary(templates: dict[str, str]) -> list[str]:
    words = sorted({w for t in templates.values() for w in t.split()})
    if len(words) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{len(words)} template words; at most {MAX_TEMPLATE_WORDS} are held in the plan")
    return words


def ordered_templates(rows: DataFrame, templates: dict[str, str], threshold: float) -> list[Template]:
    """The templates with their words in the global order: by the number of documents that hold the word, rarest first.

    At most one row per template word comes to the driver.
    """
    vocab = vocabulary(templates)
    literal = F.array(*[F.lit(w) for w in vocab])
    counts = rows.select(F.explode(F.array_intersect("words", literal)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}
    out = []
    for label, text in templates.items():
        words = sorted(set(text.split()), key=lambda w: (n.get(w, 0), w))
        out.append(Template(label, tuple(words), math.ceil(threshold * len(words) - 1e-9), max(WINDOW, 2 * len(text.split()))))
    return out


def containment(t: Template, words: Column, spots: Column) -> Column:
    """The largest share of the template's words in a block, or less than is needed where the filters rule a match out.

    ``spots``: places (from 0) and words of all templates' prefix words.
    """
    literal = F.array(*[F.lit(w) for w in t.words])

    def shared(first: Column, n: Column) -> Column:
        return F.size(F.array_intersect(literal, F.slice(words, first + 1, n)))

    def first_begin(x: Column) -> Column:
        return F.greatest(x["i"] - (t.span - 1), F.lit(0))

    def begins(x: Column) -> Column:
        return F.filter(F.sequence(first_begin(x), x["i"]), lambda s: F.get(words, s).isin(list(t.words)))

    near = F.filter(spots, lambda x: x["w"].isin(list(t.prefix)) & (shared(first_begin(x), x["i"] - first_begin(x) + t.span) >= t.need))
    starts = F.array_distinct(F.flatten(F.transform(near, begins)))
    best = F.array_max(F.transform(starts, lambda s: shared(s, F.lit(t.span))))
    return F.coalesce(best, F.lit(0)) / F.lit(float(len(t.words)))


def places(words: Column, text: Column, phrase: str) -> Column:
    """Starts (from 0) at which the phrase's words stand consecutively."""
    parts = phrase.split()
    n = len(parts)
    def at(i: Column) -> Column:
        ok = F.element_at(words, i + 1) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok = ok & (F.element_at(words, i + 1 + k) == p)
        return ok
    some = F.contains(text, F.lit(parts[0])) & F.contains(text, F.lit(parts[-1])) & (F.size(words) >= n)
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - n), at)
    return F.when(some, starts).otherwise(F.array().cast("array<int>"))


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None
) -> DataFrame:
    """Per document: doc_id, words, starts (all phrase places), base_labels and labels (arrays), score.

    ``score``: the largest containment of a template among matching blocks; 1.0 for a phrase.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    rows = with_words(docs)
    ordered = ordered_templates(rows, templates, threshold)
    # A matching block holds a prefix word, and the text then contains it: most texts are ruled out at once.
    prefix = sorted({w for t in ordered for w in t.prefix})
    maybe = F.lit(False)
    for w in prefix:
        maybe = maybe | F.array_contains("words", w)
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(prefix))
    spots = F.when(maybe, spots).otherwise(F.array().cast("array<struct<i:int,w:string>>"))
    found = {label: places(F.col("words"), F.col("text"), p) for p, label in phrases.items()}
    rows = rows.select("doc_id", "words", spots.alias("spots"), *[c.alias(f"p_{k}") for k, c in found.items()])
    best = {t.label: containment(t, F.col("words"), F.col("spots")) for t in ordered}
    rows = rows.select("doc_id", "words", *[f"p_{k}" for k in found], *[c.alias(f"t_{k}") for k, c in best.items()])
    base = F.filter(F.array(*[F.when(F.size(f"p_{k}") > 0, F.lit(k)) for k in sorted(found)]), F.isnotnull)
    own = F.filter(F.array(*[F.when(F.col(f"`t_{k}`") >= threshold - 1e-9, F.lit(k)) for k in sorted(best)]), F.isnotnull)
    top = F.greatest(*[F.col(f"`t_{k}`") for k in best], F.lit(0.0))
    return rows.select(
        "doc_id", "words",
        F.concat(*[F.col(f"p_{k}") for k in found]).alias("starts"),
        base.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, own))).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.when(top >= threshold - 1e-9, top).otherwise(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
