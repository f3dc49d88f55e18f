"""Ranked lexical search: the documents with the largest impact products, by norm buckets.

Method. A document is a vector of impacts (a term's frequency, saturated and divided by length), an
item a vector of its terms' counts; the score is the product weighted by the terms' weights. Both are
scaled by the weights' square roots, so the score is an inner product, and documents are put in order
of length, the longest first. The first bucket gives each item a threshold (its tenth best score so
far). Every further bucket is put to an item only if item length times bucket length reaches the
threshold (Cauchy-Schwarz). Inside, a document must hold one of the item's focus coordinates (those
left out, times the bucket's length, stay below the threshold), and its product over the focus plus
the Cauchy-Schwarz bound of the rest must reach it. What survives is scored exactly in integers, and the
thresholds rise as buckets are done. Bounds are widened by one part in 10^9 against rounding, and a
bound equal to the threshold survives, so that ties are decided by doc_id.

Scale. Items are a stated query set; they are read in blocks of at most ``BLOCK_TERMS`` distinct terms,
the only thing sent to all tasks, and each block runs against all documents. Terms are counted where
the text is read; vectors hold the block's terms only and are written once, then dealt by length (and a
row's place, so that equal rows spread over tasks). A task keeps ten documents an item, so what
is gathered is ten rows an item and task.

Defined cases: null and empty texts have no terms, don't count in N and are never found; items without
terms have no rows; items with equal item_id are answered each on its own; repeated documents are
found as often as they stand; a null doc_id comes after all others at equal score; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, texts
from .wordbatch import by_bytes, coded, text_bytes

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOP = 10
BLOCK_TERMS = 200_000  # distinct terms of the items that are sent to all tasks at once
BUCKET = 4096  # documents
FIRST = 20_000  # documents that give the first thresholds, about
SLACK = 1 + 1e-9
VECTORS = "doc_id long, place long, n long, terms array<int>, tf array<int>"
FOUND = "item int, doc_id long, score long"


class Terms:
    """The terms of each text: ``codes[offsets[i]:offsets[i+1]]`` index ``uniques``; A-Z in lower case."""

    table = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

    def __init__(self, texts_: pa.Array):
        data, at = text_bytes(texts_)
        inside = self.table[data]
        begin = inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            first = at[:-1][at[:-1] < at[1:]]
            begin[first] = inside[first]
        starts = np.flatnonzero(begin)
        data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        kept = np.flatnonzero(inside)
        self.codes, self.uniques = coded(data[kept], np.searchsorted(kept, starts))
        self.offsets = np.searchsorted(starts, at)


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per document with a term: doc_id, place (of the row in its task), n (all its terms), and of ``terms`` those it has with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = pa.array(terms, pa.large_string()), 0
        for whole in batches:
            for b in by_bytes(whole, "text"):
                t = Terms(b.column("text"))
                n = np.diff(t.offsets)
                number = pc.fill_null(pc.index_in(t.uniques, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                of = number[t.codes] if len(t.codes) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                size = max(len(terms), 1)
                keys, counts = np.unique(owner[of >= 0] * size + of[of >= 0], return_counts=True)
                at = np.searchsorted(keys, np.arange(len(n) + 1) * size).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (keys % size, counts)]
                out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.arange(place, place + len(n))), pa.array(n), *lists], ["doc_id", "place", "n", "terms", "tf"])
                place += len(n)
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, VECTORS)


def impacts(n: np.ndarray, tf: np.ndarray, count: int, total: int) -> np.ndarray:
    """The integer impact of a term with frequency ``tf`` in a document of ``n`` terms."""
    m = 25 + (75 * n * count) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """The items of a block: ``terms`` with integer ``weights``; per item the terms' numbers and counts."""

    def __init__(self, rows: list[dict[int, int]], weights: np.ndarray):
        self.weights, self.root = weights, np.sqrt(weights.astype(float))
        self.rows = []
        for row in rows:
            terms, counts = np.array(sorted(row), np.int64), np.array([row[t] for t in sorted(row)], np.int64)
            scaled = counts * self.root[terms]
            order = np.argsort(-scaled, kind="stable")
            self.rows.append((terms[order], counts[order], scaled[order]))

    def best(self, doc_id: np.ndarray, null: np.ndarray, terms: np.ndarray, values: np.ndarray, offsets: np.ndarray, thresholds: np.ndarray, top: list, norms: np.ndarray) -> None:
        """Puts a bucket (documents with their terms and impacts) to each item; ``top`` and ``thresholds`` are kept up to date."""
        length = norms.max(initial=0.0)
        owner = np.repeat(np.arange(len(norms)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        rows, impact, scaled = owner[order], values[order], (values * self.root[terms])[order]
        starts = np.searchsorted(terms[order], np.arange(len(self.weights) + 1))
        for i, (of, counts, weight) in enumerate(self.rows):
            least = thresholds[i] / SLACK
            rest = np.sqrt(np.append(np.cumsum((weight**2)[::-1])[::-1], 0.0))  # length from each coordinate on
            if not len(of) or rest[0] * length < least:
                continue
            focus = int(np.argmax(rest * length < least)) if least > 0 else len(of)
            partial, used = np.zeros(len(norms)), np.zeros(len(norms))
            for t, w in zip(of[:focus], weight[:focus], strict=True):
                at = slice(starts[t], starts[t + 1])
                partial[rows[at]] += w * scaled[at]
                used[rows[at]] += scaled[at] ** 2
            bound = partial + rest[focus] * np.sqrt(np.maximum(norms**2 - used, 0.0) + 1e-9 * norms**2)
            some = np.flatnonzero((used > 0) & (bound >= least))
            if not len(some):
                continue
            place = np.full(len(norms), -1)
            place[some] = np.arange(len(some))
            score = np.zeros(len(some), np.int64)
            for t, c in zip(of, counts, strict=True):
                at = slice(starts[t], starts[t + 1])
                hit = place[rows[at]]
                score[hit[hit >= 0]] += c * self.weights[t] * impact[at][hit >= 0]
            good = np.flatnonzero((score > 0) & (score >= thresholds[i]))
            if len(good):
                found = [(-int(s), bool(z), int(d)) for s, z, d in zip(score[good], null[some[good]], doc_id[some[good]], strict=True)]
                top[i] = sorted(top[i] + found)[:TOP]
                if len(top[i]) == TOP:
                    thresholds[i] = max(thresholds[i], -top[i][-1][0])


def search(rows: DataFrame, items: Items, count: int, total: int, thresholds: np.ndarray) -> DataFrame:
    """(item, doc_id, score): of each task's rows, the longest first, the best of each item that reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, top = thresholds.copy(), [[] for _ in items.rows]
        for whole in batches:
            for lo in range(0, whole.num_rows, BUCKET):
                b = whole.slice(lo, BUCKET)
                lists, tf = b.column("terms"), b.column("tf")
                at = np.asarray(lists.offsets, dtype=np.int64)
                terms, n = np.asarray(lists.flatten(), dtype=np.int64), b.column("n").to_numpy()
                values = impacts(np.repeat(n, np.diff(at)), np.asarray(tf.flatten(), dtype=np.int64), count, total)
                ids = b.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                items.best(pc.fill_null(ids, 0).to_numpy(), null, terms, values, at - at[0], least, top, b.column("norm").to_numpy())
        flat = [(i, None if z else d, -s) for i, found in enumerate(top) for s, z, d in found]
        columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tf", "norm").mapInArrow(run, FOUND)


def with_norms(rows: DataFrame, root: np.ndarray, count: int, total: int) -> DataFrame:
    """Adds the length of each document's scaled impact vector; a row without the items' terms goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column("terms").offsets, dtype=np.int64)
            terms, tf = (np.asarray(b.column(c).flatten(), dtype=np.int64) for c in ("terms", "tf"))
            values = impacts(np.repeat(b.column("n").to_numpy(), np.diff(at)), tf, count, total) * root[terms]
            sums = np.concatenate([[0.0], np.cumsum(values**2)])
            norm = np.sqrt([sums[y] - sums[x] for x, y in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]) if len(at) > 1 else np.zeros(0)
            yield b.append_column("norm", pa.array(norm * SLACK, pa.float64()))

    return rows.mapInArrow(run, VECTORS + ", norm double").where(F.size("terms") > 0)


def best_of(found: DataFrame) -> DataFrame:
    """rank, item, doc_id, score: the best of each item; every task has sent ten rows an item at most."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[object, Counter]]]:
    """The items (item_id, counts of their terms) in blocks of at most ``block_terms`` distinct terms (or one item)."""
    block, seen = [], set()
    for r in items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        terms = Counter(x.translate(LOWER) for x in TERM.findall(r.text))
        if block and len(seen | terms.keys()) > block_terms:
            yield block
            block, seen = [], set()
        block.append((r.item_id, terms))
        seen |= terms.keys()
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: of each row of ``items`` the ten documents with the highest scores above 0."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for block in blocks(items, block_terms):
        out = out.unionByName(_block(docs, block, schema))
    return out


def _block(docs: DataFrame, block: list[tuple[object, Counter]], schema: str) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, counts in block for t in counts})
    number = {t: i for i, t in enumerate(terms)}
    rows = stored(vectors(texts(docs), terms), "search-vectors")
    count, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not count or not terms:
        return spark.createDataFrame([], schema)
    df = np.zeros(len(terms), np.int64)  # one number a term of the block
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r.t] = r.n
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    found = Items([{number[t]: c for t, c in counts.items()} for _, counts in block], weights)

    # By length, the longest first; equal lengths are spread by the rows' places.
    lengths = with_norms(rows, found.root, count, total)
    order = [F.col("norm").desc(), F.col("place"), F.col("doc_id")]
    buckets = stored(lengths.repartitionByRange(*order).sortWithinPartitions(*order), "search-buckets")
    share = min(1.0, FIRST / count)
    cut = buckets.agg(F.percentile_approx("norm", 1 - share, 10_000)).first()[0] or 0.0
    none = np.zeros(len(block), np.int64)
    first = stored(best_of(search(buckets.where(F.col("norm") >= cut), found, count, total, none)), "search-first")
    thresholds = none.copy()
    for r in first.where(F.col("rank") == TOP).collect():  # one row an item of the block
        thresholds[r.item] = r.score
    lengths_of = [math.sqrt(float((w**2).sum())) for _, _, w in found.rows]
    # No item reaches its threshold with a shorter document.
    shortest = min((t / SLACK / x for t, x in zip(thresholds.tolist(), lengths_of, strict=True) if x > 0), default=0.0)
    rest = search(buckets.where((F.col("norm") < cut) & (F.col("norm") >= shortest)), found, count, total, thresholds)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, {schema.split(', rank')[0]}")
    best = best_of(first.drop("rank").unionByName(rest))
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
),
q AS (
  SELECT row_number() OVER () AS item, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM benchmark
),
lengths AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
asked AS (SELECT item, term, count(*) AS c FROM (SELECT item, unnest(terms) AS term FROM q) GROUP BY item, term),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, whole GROUP BY term
),
scores AS (
  SELECT item, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN lengths USING (r), whole GROUP BY item, r
),
best AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN lengths USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best JOIN q USING (item) WHERE rank <= 10
"""
