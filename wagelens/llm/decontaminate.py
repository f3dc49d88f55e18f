"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Method. Words are lower-cased (A-Z) without punctuation at their ends. Seeds are an item's runs of
``GRAM`` words (the whole item if shorter), of which the rarer half is kept, counted by the items that
hold them: copies in the documents, whole or edited, cannot raise that count, and openings that many
items share drop out. A document's runs, and its runs with one word left out, meet the seeds, so a
word put in hides none. Where ``MEET`` different seeds of an item (one, if it has under ``SMALL``)
meet the document at about one place, item and document are aligned there by Smith-Waterman (match 2,
mismatch -1, gap -1 per word). Score: the best alignment over the item's perfect score; pairs of
``THRESHOLD`` or more are returned. The stretch aligned holds any alignment of that score through the
seeds: it has at most ``slack`` gaps. Stretches that share too few words with the item to reach the
threshold are not aligned. A pair of that score whose seeds are all broken is not proposed (an edit in
every third word or closer); the tests measure the share of pairs found against aligning all pairs.

Scale. Documents are read where they lie and nothing of them is shuffled: seeds and words of the items
go to the tasks, in blocks of at most ``MAX_SEEDS`` seeds (or one item), and each block runs against
all documents. Texts are taken a few MB at a time.

Defined cases: null and empty texts match nothing; repeated rows are reported once per doc_id and
item; null doc_id is reported as such; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, texts
from .wordbatch import PART_BYTES, Words, by_bytes, grams, mix, word_hashes

GRAM = 3
GAPPED = ((0, 1, 3), (0, 2, 3))  # a run of three words of an item with a word put in
THRESHOLD = 0.6
MEET, SMALL = 2, 6
MAX_SEEDS = 2_000_000


def clean(words: pa.Array) -> pa.Array:
    """Words without punctuation at their ends; a word of punctuation alone stays."""
    bare = pc.replace_substring_regex(words, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return pc.if_else(pc.equal(bare, ""), words, bare)


def hashes(texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, and where each text begins (one entry more than texts)."""
    w = Words(texts_, lower=True)
    return word_hashes(clean(w.uniques))[w.codes] if len(w.codes) else np.zeros(0, np.uint64), w.offsets


def pattern_hashes(h: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the entries at ``places`` from each entry on; for consecutive places that of the run (``grams``)."""
    n = max(len(h) - places[-1], 0)
    out = mix(h[:n])
    for k in places[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def item_seeds(items: DataFrame) -> DataFrame:
    """item, item_id, text, at, gram: each row of ``items`` with words and the seeds kept of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, offsets = hashes(b.column("text"))
            at, keys = [], []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                key = grams(h[lo:hi], min(GRAM, int(hi - lo))) if hi > lo else np.zeros(0, np.uint64)
                at.append(np.arange(len(key)))
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("item"), b.column("item_id"), b.column("text"), pa.array(at, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["item", "item_id", "text", "at", "gram"]
            )

    numbered = items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "text")
    all_ = stored(numbered.mapInArrow(run, "item long, item_id long, text string, at array<long>, gram array<long>").where(F.size("gram") > 0), "decon-items")
    each = all_.select("item", F.explode(F.arrays_zip("at", "gram")).alias("s")).select("item", "s.at", "s.gram")
    held = each.groupBy("gram").agg(F.count_distinct("item").alias("held"))
    counted = stored(each.join(held, "gram"), "decon-seeds")
    half = counted.groupBy("item").agg(F.percentile_approx("held", 0.5, 10_000).alias("half"))
    kept = counted.join(half, "item").where("held <= half").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "gram"))).alias("seeds"))
    return all_.select("item", "item_id", "text").join(kept, "item").select("item", "item_id", "text", F.col("seeds.at").alias("at"), F.col("seeds.gram").alias("gram"))


class Items:
    """A block of items: their words, and for each seed the items and places that it stands at."""

    def __init__(self, rows: list, threshold: float):
        h, offsets = hashes(pa.array([r["text"] for r in rows], pa.large_string()))
        self.ids = [r["item_id"] for r in rows]
        self.words = [h[lo:hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
        self.threshold = threshold
        size = np.diff(offsets)
        self.step, self.gaps = size // 2 + 1, np.array([slack(int(n), threshold) for n in size], np.int64)
        counts = np.array([len(r["gram"]) for r in rows], np.int64)
        self.least = np.where(counts < SMALL, 1, MEET)
        item, at = np.repeat(np.arange(len(rows)), counts), np.concatenate([np.array(r["at"], np.int64) for r in rows])
        key = np.concatenate([np.array(r["gram"], np.int64) for r in rows])
        order = np.argsort(key, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.patterns = [tuple(range(n)) for n in range(1, GRAM) if (size == n).any()] + [tuple(range(GRAM)), *GAPPED]

    def met(self, h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Text, item, item place and start of the item in the text, of each seed met in the texts."""
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        found = []
        for places in self.patterns:
            key = pattern_hashes(h, places).view(np.int64)
            near = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[near] == key) & (owner[: len(key)] == owner[places[-1] : places[-1] + len(key)]))
            n = self.first[near[hit] + 1] - self.first[near[hit]]
            of = np.repeat(self.first[near[hit]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(hit - offsets[owner[hit]], n)
            found.append((np.repeat(owner[hit], n), self.item[of], self.at[of], np.maximum(pos - self.at[of], 0)))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def stretches(self, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and step at which enough different seeds meet."""
        text, item, at, start = self.met(h, offsets)
        rows = np.unique(np.stack([text, item, start // self.step[item], at], axis=1), axis=0)
        if not len(rows):
            return
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        groups = rows[new, :3]
        count = np.diff(np.append(np.flatnonzero(new), len(rows)))
        # Seeds of one place may fall into two steps side by side.
        both = count.copy()
        beside = (groups[1:, :2] == groups[:-1, :2]).all(axis=1) & (groups[1:, 2] == groups[:-1, 2] + 1)
        both[1:] = np.maximum(both[1:], np.where(beside, count[1:] + count[:-1], 0))
        both[:-1] = np.maximum(both[:-1], np.where(beside, count[1:] + count[:-1], 0))
        yield from (tuple(int(v) for v in g) for g in groups[both >= self.least[groups[:, 1]]])

    def best(self, texts_: pa.Array) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item): the best score of at least the threshold, and the word at which it ends."""
        h, offsets = hashes(texts_)
        out: dict[tuple[int, int], tuple[float, int]] = {}
        for t, i, k in self.stretches(h, offsets):
            words, item = h[offsets[t] : offsets[t + 1]], self.words[i]
            lo, hi = max(0, k * self.step[i] - self.gaps[i]), (k + 1) * self.step[i] + len(item) + self.gaps[i]
            if np.isin(item, words[lo:hi]).sum() < self.threshold * len(item) - 1e-9:
                continue
            got, at = smith_waterman(item, words[lo:hi])
            score = got / (2 * len(item))
            if score >= self.threshold and score > out.get((t, i), (0.0, 0))[0]:
                out[t, i] = score, int(lo + at)
        return out


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score (match 2, mismatch -1, gap -1) and the place in ``b`` at which it ends."""
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    step = np.arange(len(b) + 1)
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == x, 2, -1), row[1:] - 1), 0)
        row = np.maximum(np.maximum.accumulate(new + step) - step, 0)  # gaps along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def slack(n: int, threshold: float) -> int:
    """The most gaps in an alignment of an item of ``n`` words with a score of ``threshold``: each costs 1 of 2 per word."""
    return int(2 * n * (1 - threshold) + 1e-9)


def blocks(seeds: DataFrame, max_seeds: int) -> Iterator[list]:
    """The items with their seeds, in blocks of at most ``max_seeds`` seeds (or one item)."""
    block, size = [], 0
    for r in seeds.toLocalIterator():
        if block and size + len(r["gram"]) > max_seeds:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r["gram"])
    if block:
        yield block


def aligned(text: DataFrame, items: Items) -> DataFrame:
    """doc_id, item_id, score, end_word of every document and item of the block that it holds a copy of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, "text", PART_BYTES):
                found = items.best(b.column("text"))
                columns = [
                    b.column("doc_id").take(pa.array([t for t, _ in found], pa.int64())), pa.array([items.ids[i] for _, i in found], pa.int64()),
                    pa.array([x[0] for x in found.values()], pa.float64()), pa.array([x[1] for x in found.values()], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "end_word"])

    return text.mapInArrow(run, "doc_id long, item_id long, score double, end_word long")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """doc_id, item_id, score, end_word of every document and test item that it holds a copy of."""
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, good = texts(docs), None
    for block in blocks(item_seeds(tests), max_seeds):
        part = aligned(text, Items(block, threshold))
        good = part if good is None else good.unionByName(part)
    if good is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    return good.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max_by("end_word", "score").alias("end_word"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item, all columns as they are."""
    bad = stored(contaminated(docs, items).select(F.col("doc_id").alias("__bad")).distinct(), "decon-bad")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
