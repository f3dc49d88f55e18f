"""Spelling variants: words one edit apart, found by composing acceptors, and the common form of each.

Method. The vocabulary (words of at least ``LEAST`` code points that occur ``OFTEN`` times) is
read as an acceptor; composed with a transducer that makes exactly one insertion, deletion or
replacement and with the acceptor again, it accepts the pairs of near words. The composition is
enumerated per partition of its initial states: a pair differs at one place, so both words share all
that stands before a range of places and all that stands after it. A word is dealt to the two halves
of its places; the words of one (length, range, what stands before and after) are the initial state,
and the pairs that differ inside the range are enumerated from it. In a task the acceptors are
minimised (equal right languages are one state, over all initial states of the task), the states
before the edit are pairs (p, p), those after it are intersections of right languages, which for equal
states are the language itself. The place of an edit is the length of the common prefix, so each pair
is enumerated exactly once.

Scale. Words are counted with partial sums where the text is read. What is shuffled is the vocabulary,
four rows a word. An initial state with over ``GROUP`` words is not read by one task: its range is cut
in halves again, at most log2(length) times, until the words differ in one place only; there an initial
state has at most as many words as its alphabet and its square have letters. So are ranges of over
``PLACES`` places, where two or more words share what stands around them. No list of pairs is made
but the result. Forms lead to words ten times as frequent, so chains are short; roots are found by
doubling steps.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty text; a run of any
length is one word; repeated rows count again; ties take the smallest word in code-point order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, stored, texts

LEAST, OFTEN, RATIO = 7, 2, 10
DROPPED = 31  # of so many (document, word) pairs about one loses a letter; None: none does
GROUP = 20_000  # words of one initial state; over the square of the alphabet (90 letters), so cutting ends
PLACES = 32  # of a range that acceptors are built over
ROWS = 200_000  # of the dealt vocabulary in a task
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = "word string, near string, near_n long"


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, dropped: int | None = DROPPED) -> DataFrame:
    """word, n: the words of ``docs`` and how often they occur; ``dropped``: one (doc_id, word) in so many loses a letter, by a checksum."""
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    rows = rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if dropped is not None:
        key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word")
        rows = rows.select("word", F.crc32(key.cast("binary")).alias("h"))
        cut = F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")
        rows = rows.select(F.when(F.col("h") % dropped == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, m, lo, hi) with the initial state they belong to: words of m or m + 1 letters equal before lo and after hi."""
    state = F.expr("concat_ws(':', m, lo, hi, substring(word, 1, lo), substring(word, length(word) - (m - hi) + 1))")
    return rows.select("word", "n", "m", "lo", "hi", state.alias("state"))


def halves(rows: DataFrame) -> DataFrame:
    """Each row for both halves of its range."""
    cut = "array(struct(lo as lo, cast((lo + hi) / 2 as int) as hi), struct(cast((lo + hi) / 2 as int) as lo, hi as hi))"
    return rows.select("word", "n", "m", F.explode(F.expr(cut)).alias("r")).select("word", "n", "m", "r.lo", "r.hi")


def initial_states(words: DataFrame, least: int, group: int) -> DataFrame:
    """The words dealt to initial states of at most ``group`` words and ``PLACES`` places: state, m, lo, hi, word, n."""
    # A word is the shorter one (or of equal length) for m letters, the longer one for one letter less.
    as_m = words.select("word", "n", F.explode(F.expr(f"filter(array(length(word), length(word) - 1), m -> m >= {least})")).alias("m"))
    open_ = dealt(halves(as_m.select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi"))))
    done = None
    while True:
        large = open_.groupBy("state").agg(F.count(F.lit(1)).alias("size"), F.first(F.col("hi") - F.col("lo")).alias("places"))
        many, wide = (F.col("size") > group) & (F.col("places") > 1), (F.col("size") > 1) & (F.col("places") > PLACES)
        large = stored(large.where(many | wide).select("state"), "spelling-large")
        if large.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(large, "state", "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = stored(dealt(halves(open_.join(large, "state", "left_semi"))), "spelling-open")


class Acceptor:
    """States by their arcs: equal right languages are one state. State 0 accepts the empty word and has no arcs."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {(): 0}
        self.arcs: list[dict[str, int]] = [{}]
        self.languages: dict[int, list[str]] = {0: [""]}
        self.common: dict[tuple[int, int], list[str]] = {}

    def state(self, words: list[str], lo: int, hi: int, at: int) -> int:
        """The state that accepts what stands from ``at`` in the sorted ``words[lo:hi]``, all of one length."""
        if at == len(words[lo]):
            return 0
        arcs = {}
        while lo < hi:
            letter, end = words[lo][at], lo + 1
            while end < hi and words[end][at] == letter:
                end += 1
            arcs[letter] = self.state(words, lo, end, at + 1)
            lo = end
        found = self.number.setdefault(tuple(arcs.items()), len(self.arcs))
        if found == len(self.arcs):
            self.arcs.append(arcs)
        return found

    def language(self, p: int) -> list[str]:
        if p not in self.languages:
            self.languages[p] = [c + rest for c, q in self.arcs[p].items() for rest in self.language(q)]
        return self.languages[p]

    def both(self, p: int, q: int) -> list[str]:
        """What both states accept."""
        if p == q:
            return self.language(p)
        key = (p, q) if p < q else (q, p)
        if key not in self.common:
            other = self.arcs[q]
            self.common[key] = [c + rest for c, r in self.arcs[p].items() if c in other for rest in self.both(r, other[c])]
        return self.common[key]

    def replaced(self, p: int, before: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs with one letter replaced."""
        arcs = list(self.arcs[p].items())
        for i, (x, q) in enumerate(arcs):
            for y, r in arcs[i + 1 :]:
                for rest in self.both(q, r):
                    yield before + x + rest, before + y + rest
            yield from self.replaced(q, before + x)

    def inserted(self, p: int, q: int, at_end: bool, before: str = "") -> Iterator[tuple[str, str]]:
        """Accepted pairs of a word of ``p`` and one of ``q`` with one letter more, inserted after their common prefix."""
        short, long = self.arcs[p], self.arcs[q]
        if not short:
            if at_end:
                for y in long:
                    yield before, before + y
            return
        for y, r in long.items():
            follows = self.arcs[r]
            for x, s in short.items():
                if x != y and x in follows:
                    for rest in self.both(s, follows[x]):
                        yield before + x + rest, before + y + x + rest
            if y in short:
                yield from self.inserted(short[y], r, at_end, before + y)


STATES = 500_000  # of an acceptor, before a task begins a new one


def compose(rows: DataFrame, tasks: int) -> DataFrame:
    """(word, near, near_n) of all near words inside the initial states, both ways round."""

    def pairs(acceptor: Acceptor, m: int, lo: int, hi: int, words: dict[str, int]) -> Iterator[tuple[str, str]]:
        first = next(iter(words))
        before, after = first[:lo], first[len(first) - (m - hi) :]
        inner = [w[lo : len(w) - (m - hi)] for w in words]
        short = sorted(w for w in inner if len(w) == hi - lo)
        if not short or len(inner) < 2:
            return
        p = acceptor.state(short, 0, len(short), 0)
        for u, v in acceptor.replaced(p):
            yield before + u + after, before + v + after
        if len(inner) > len(short):
            longer = sorted(w for w in inner if len(w) > hi - lo)
            q = acceptor.state(longer, 0, len(longer), 0)
            for u, v in acceptor.inserted(p, q, hi == m):
                yield before + u + after, before + v + after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            types = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "near", "near_n"])

        acceptor, last, words, out = Acceptor(), None, {}, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal acceptor, out
            if len(words) > 1:
                if len(acceptor.arcs) > STATES or len(acceptor.common) > STATES:
                    acceptor = Acceptor()
                for u, v in pairs(acceptor, *last[1:], words):
                    out += [(u, v, words[v]), (v, u, words[u])]
                    if len(out) >= 50_000:
                        yield batch(out)
                        out = []

        for b in batches:
            for state, m, lo, hi, word, n in zip(*(b.column(c).to_pylist() for c in ("state", "m", "lo", "hi", "word", "n")), strict=True):
                if last is None or state != last[0]:
                    yield from close()
                    last, words = (state, m, lo, hi), {}
                words[word] = n
        yield from close()
        yield batch(out)

    columns = ["state", "m", "lo", "hi", "word", "n"]
    return rows.select(*columns).repartition(tasks, "state").sortWithinPartitions("state").mapInArrow(run, PAIRS)


def near_words(words: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """(word, near, near_n): for each word of ``words`` (word, n) those that differ by one inserted, deleted or replaced code point."""
    tasks = parts(4 * words.count(), ROWS, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return compose(initial_states(words, least, group), tasks)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that forms lead to. Each round doubles the steps taken."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, dropped: int | None = DROPPED, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(texts(docs), least, often, dropped), "spelling-words")
    near = near_words(words, least, group).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    rows = words.join(near, "word", "left").withColumn("best_n", -F.col("best.order"))
    common = F.col("best_n") >= ratio * F.col("n")
    rows = stored(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")
        ),
        "spelling-forms",
    )
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
