"""Line-first cleaning: rules per line, then documents that lose too much text are rejected.

Method. Each line with a word is put to three rules and fails if one of them holds:

- punctuation: more than one mark (one of ``# * $ % & | < > { } [ ] \\``, or a run of ! or ?) in
  ``MARKED`` words, or no lower-case letter among ``SHOUTED`` or more upper-case ones;
- navigation: two or more ``|``, ``>`` or similar separators between words, or at most ``SHORT`` words
  that neither end in a closing mark nor hold a full stop (menu entries, buttons);
- boilerplate: a phrase of ``BOILERPLATE``, or a line that stands earlier in the text.

The lines that pass are the cleaned text. A document is kept if it meets the base rules (at least
``LEAST_WORDS`` words; at most ``REPEATED`` percent of them in runs of five words that stand twice)
and loses at most ``LOST`` percent of its words' characters.

Scale. DataFrame expressions only, one pass where the text is read: no shuffle, no state, one row in
and one row out. Work is in proportion to the text, but for a sort of the runs of those documents in
which runs repeat. A hot source or group of copies is as many independent rows; a single text is
never split over tasks.

Defined cases: null and empty texts have no words, fail the base rules and are not kept; a text that is
one very long line is one line; repeated rows are judged alike, each on its own; null doc_ids stay; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts

# White space, the characters counted as symbols, and the length of a run of words.
SPACES = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
RUN = 5
LEAST_WORDS, REPEATED = 10, 20

MARKED, SHOUTED, SHORT, LOST = 5, 8, 3, 30
MARK = r"[#*$%&|<>{}\[\]\\]+|[!?]{2,}"
SEPARATOR = r"[|>»›•·]"
CLOSING = r"[.!?…:;,。！？]"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript", "accept cookies",
    "click here", "sign up", "log in to", "subscribe to", "read more", "share this", "skip to content", "powered by", "lorem ipsum",
    "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACES}]+"), F.lit(0))


def word_chars(text: Column) -> Column:
    for c in "\x20\x09\x0a\x0b\x0c\x0d":
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_hashes(words: Column) -> Column:
    """A 64-bit hash of each run of five of at least five words, in order."""
    n = F.size(words)

    def joined(a: Column, b: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(b, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))

    def of_five(h: Column) -> Column:
        return let(joined(h, h, 1), lambda two: F.slice(joined(joined(two, two, 2), h, 4), F.lit(1), n - RUN + 1))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_five)


def covered(places: Column) -> Column:
    """Words covered by the runs that begin at ``places`` (ascending)."""
    steps = F.transform(places, lambda p, i: F.when(i == 0, RUN).otherwise(F.least(F.lit(RUN), p - F.get(places, i - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def repeat_words(words: Column) -> Column:
    """Of ``words`` those in runs of five that stand twice or more, the first included.

    Runs count as equal if their 64-bit hashes are: for a text of a million words that is wrong with
    probability 3e-8. What a lambda uses is bound by ``let``, so no plan computes it once per element.
    """
    none = F.lit(0).cast("long")

    def places(rows: Column) -> Column:
        same = lambda x, i: F.coalesce(x["runs"] == F.get(rows, i)["runs"], F.lit(False))
        hits = F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(hits, lambda x: x["at"])), covered)

    def of_runs(runs: Column) -> Column:
        rows = F.transform(runs, lambda x, i: F.struct(x.alias("runs"), i.alias("at")))
        return F.when(F.size(F.array_distinct(runs)) < F.size(runs), let(F.sort_array(rows), places)).otherwise(none)

    return let(words, lambda w: F.when(F.size(w) >= RUN, let(run_hashes(w), of_runs)).otherwise(none))


def holds_boilerplate(lowered: Column) -> Column:
    return reduce(or_, [F.contains(lowered, F.lit(x)) for x in BOILERPLATE])


def fails(line: Column) -> Column:
    """Whether a line with a word fails a rule (but the one of repeated lines)."""
    words = F.regexp_count(line, F.lit(f"[^{SPACES}]+"))
    marks = F.regexp_count(line, F.lit(MARK))
    marked = (marks > 0) & (MARKED * marks > words)
    shouted = ~F.rlike(line, F.lit(r"\p{Ll}")) & (F.regexp_count(line, F.lit(r"\p{Lu}")) >= SHOUTED)
    menu = F.regexp_count(line, F.lit(SEPARATOR)) >= 2
    entry = ~F.rlike(line, F.lit(CLOSING)) & (words <= SHORT)
    boiler = let(F.lower(line), holds_boilerplate)
    return marked | shouted | menu | entry | boiler


def analysed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the text, the base figures, its lines and the cleaned text."""
    rows = texts(docs)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]")))
    rows = rows.withColumns({"words": words_of(F.col("text")), "lines": lines})
    # Of equal lines the first is put to the rules; the others fail.
    rows = rows.withColumn("distinct_lines", F.array_distinct("lines"))
    rows = rows.withColumn("clean", F.array_join(F.filter("distinct_lines", lambda x: ~fails(x)), "\n"))
    return rows.select(
        "doc_id",
        "text",
        "clean",
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("distinct_lines")).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, the figures of ``analysed``, the cleaned text, the word characters it has, base_failed and kept."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    loses = 100 * (F.col("word_chars") - F.col("clean_chars")) > LOST * F.col("word_chars")
    rows = analysed(docs).drop("text").withColumn("clean_chars", word_chars(F.col("clean")))
    return rows.withColumns({"base_failed": base, "kept": ~base & ~loses})


def keep_clean(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that stay, the text without the lines that fail."""
    return cleaned(docs).where("kept").select("doc_id", F.col("clean").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "clean_chars",
        F.sha2("clean", 256).alias("clean_sha256"),
    )


def _oracle() -> str:
    count = lambda x, pattern: f"len(regexp_extract_all({x}, '{pattern}'))"
    chars = lambda x: f"length(regexp_replace({x}, '[{SPACES}]+', '', 'g'))"
    words = f"[^{SPACES}]+"
    fail = " OR ".join(
        [
            f"{MARKED} * {count('x', MARK)} > {count('x', words)}",
            f"(NOT regexp_matches(x, '\\p{{Ll}}') AND {count('x', chr(92) + 'p{Lu}')} >= {SHOUTED})",
            f"{count('x', SEPARATOR)} >= 2",
            f"(NOT regexp_matches(x, '{CLOSING}') AND {count('x', words)} <= {SHORT})",
            " OR ".join(f"contains(lower(x), '{phrase}')" for phrase in BOILERPLATE),
        ]
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{words}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines
  FROM documents
),
grams AS (SELECT r, i, array_to_string(w[i : i + {RUN - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {RUN - 2})) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
repeats AS (
  SELECT r, CAST(sum(CASE WHEN before IS NULL THEN {RUN} ELSE least({RUN}, i - before) END) AS BIGINT) AS n
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice) GROUP BY r
),
line AS (SELECT r, x, min(pos) AS pos FROM (SELECT r, unnest(lines) AS x, generate_subscripts(lines, 1) AS pos FROM d) GROUP BY r, x),
clean AS (SELECT r, string_agg(x, chr(10) ORDER BY pos) AS c FROM line WHERE NOT ({fail}) GROUP BY r),
figures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({chars('t')} AS BIGINT) AS word_chars,
         CAST({count('t', f'[{SYMBOLS}]')} AS BIGINT) AS n_symbols,
         CAST(len(lines) - coalesce((SELECT count(*) FROM line WHERE line.r = d.r), 0) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST({chars("coalesce(c, '')")} AS BIGINT) AS clean_chars, sha256(coalesce(c, '')) AS clean_sha256
  FROM d LEFT JOIN repeats USING (r) LEFT JOIN clean USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words)
         AND NOT 100 * (word_chars - clean_chars) > {LOST} * word_chars AS kept,
       n_lines, clean_chars, clean_sha256
FROM figures
"""


ORACLE = _oracle()
