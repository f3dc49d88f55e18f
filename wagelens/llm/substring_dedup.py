"""Substring dedup: repeated passages of ``WINDOW`` words, found with an FM-index per shard.

Method. A window is ``WINDOW`` consecutive words of a document. Each window has an *anchor*: its
run of ``GRAM`` words with the smallest hash (the leftmost of equals), so equal windows have equal
anchors at equal places. Anchors whose run stands only once in the corpus are left out: their
windows can't repeat. Around every other anchor the document's words form a segment that holds all
windows of that anchor. Equal segments are merged and counted; the distinct segments are dealt to
shards by their anchor, so equal windows always meet in one shard. There a compressed FM-index
(Burrows-Wheeler transform in a wavelet matrix with rank counts) is built over the shard's
segments, and the windows of the segments are streamed through it by backward search: what matches
over the whole window at two or more places that count (a window counts where its own anchor is)
is repeated. Windows of a segment that stands twice are repeated without a search. Intervals go
back to the documents.

Scale. Documents move once, compressed, in blocks of bounded size; anchors are about one in ten
words, a hash and a count for each block, so a common one is a row a block; only repeated anchors carry text. Shards hold a bounded number of
segments. An anchor with over ``HOT`` segments (a common line between different neighbours) is dealt
window by window instead, by the window's own hash, so it spreads over the shards and equal windows
merge before the shuffle. Comparison is by words, not by hashes: a shard's symbols are its words.

Defined cases: null text has no words; a text shorter than a window keeps all words; windows that
overlap themselves in one document count as places of their own; repeated rows make all windows of
each repeated; null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, parts, stored, texts
from .fm_index import FmIndex
from .vocab import block_rows, in_blocks
from .wordbatch import Words, grams, text_bytes

WINDOW = 35
GRAM = 16
BLOCK_BYTES = 4 << 20
SHARD_SEGMENTS = 10_000
HOT = 10_000

ANCHORS = "gram long, block int, n long"
SEGMENTS = "gram long, k1 long, k2 long, mask long, words string, block int, doc int, start int"


def anchors_of(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window, place of its anchor, hash of the anchor's run; places count through all texts."""
    run = grams(w.hashes(), gram)
    n = len(w.codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = w.owner()
    starts = np.flatnonzero(owner[:n] == owner[window - 1 :])
    least = run[:n].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, run[k : k + n], out=least)
    place = np.zeros(n, np.int64)
    for k in range(window - gram, -1, -1):
        place[run[k : k + n] == least] = k
    at = starts + place[starts]
    return starts, at, run[at].view(np.int64)


def find_anchors(packed: DataFrame, window: int, gram: int) -> DataFrame:
    """The runs that are anchors in each block and at how many places; a common run is one row a block."""

    def run(table: pa.Table) -> pa.Table:
        _, at, key = anchors_of(Words.by_parts(block_rows(table)[1]), window, gram)
        runs, n = np.unique(key[np.unique(at, return_index=True)[1]], return_counts=True)
        block = np.full(len(runs), table.column("block")[0].as_py(), np.int32)
        return pa.table({"gram": runs, "block": block, "n": n})

    return packed.groupBy("block").applyInArrow(run, ANCHORS)


def repeated_anchors(anchors: DataFrame, hot: int) -> DataFrame:
    """The runs that are anchors at more than one place of the corpus, for each block that has them."""
    everywhere = F.sum("n").over(Window.partitionBy("gram"))
    return anchors.withColumn("n", everywhere).where("n > 1").select("block", "gram", (F.col("n") > hot).alias("hot"))


def cut_segments(packed: DataFrame, anchors: DataFrame, window: int, gram: int) -> DataFrame:
    """A row per repeated anchor: its words, which windows (bits from ``start``) are its own, and where it stands."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        shape = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SEGMENTS.split(", ")])
        if not docs.num_rows or not found.num_rows:
            return shape.empty_table()
        w = Words.by_parts(block_rows(docs)[1])
        starts, at, key = anchors_of(w, window, gram)
        runs, order = np.unique(found.column("gram").to_numpy(), return_index=True)
        hot = found.column("hot").to_numpy()[order]
        place = np.minimum(np.searchsorted(runs, key), len(runs) - 1)
        keep = runs[place] == key
        starts, at, key, spread = starts[keep], at[keep], key[keep], hot[place[keep]]
        if not len(at):
            return shape.empty_table()
        # Windows of one anchor follow each other; those of a hot one are segments of their own.
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | spread[1:]))
        p, key, spread = at[first], key[first], spread[first]
        doc = np.searchsorted(w.offsets, p, "right") - 1
        base, end = w.offsets[doc], w.offsets[doc + 1]
        lo = np.where(spread, starts[first], np.maximum(base, p - (window - gram)))
        hi = np.where(spread, lo + window, np.minimum(end, p + window))
        sizes = np.diff(np.append(first, len(starts)))
        mask = np.bitwise_or.reduceat(np.uint64(1) << (starts - np.repeat(lo, sizes)).astype(np.uint64), first).view(np.int64)
        # The words of the block with a blank behind each, and where each begins.
        line = pc.binary_join_element_wise(w.uniques.take(pa.array(w.codes)), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, byte = text_bytes(line)
        data = data.tobytes()
        text = [data[a:b] for a, b in zip(byte[lo].tolist(), (byte[hi] - 1).tolist(), strict=True)]
        names = b"".join([hashlib.blake2b(b"%d %b" % x, digest_size=16).digest() for x in zip(mask.tolist(), text, strict=True)])
        k1, k2 = np.frombuffer(names, np.int64).reshape(-1, 2).T
        block = np.full(len(p), docs.column("block")[0].as_py(), np.int32)
        columns = [np.where(spread, k1, key), k1, k2, mask, pa.array(text, pa.binary()).cast(pa.string()), block, doc.astype(np.int32), (lo - base).astype(np.int32)]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=shape)

    return packed.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(run, SEGMENTS)


def search_shards(segments: DataFrame, window: int) -> DataFrame:
    """Of distinct segments (shard, k1, k2, mask, words, n): k1, k2, found (bits of the repeated windows)."""

    def run(table: pa.Table) -> pa.Table:
        w = Words.by_parts(table.column("words").combine_chunks())
        mask, n = table.column("mask").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        # Symbols from 1, with a 0 behind each segment.
        at = w.offsets[:-1] + np.arange(len(w))
        text = np.zeros(len(w.codes) + len(w), np.int64)
        text[np.arange(len(w.codes)) + w.owner()] = w.codes + 1
        bits = [np.flatnonzero((mask >> np.uint64(k)) & np.uint64(1)) for k in range(64)]
        places = [at[rows] + k for k, rows in enumerate(bits)]
        weight = np.zeros(len(text) + 1, np.int64)
        for rows, p in zip(bits, places, strict=True):
            weight[p] = n[rows]
        found = np.where(n >= 2, mask, np.uint64(0))
        once = [(k, rows[n[rows] == 1]) for k, rows in enumerate(bits)]
        starts = np.concatenate([at[rows] + k for k, rows in once])
        if len(starts) and len(w) > 1:
            index = FmIndex(text)
            before = np.concatenate([[0], np.cumsum(weight[index.order])])
            lo, hi = index.search(text, starts, window)
            repeated = before[hi] - before[lo] >= 2
            i = 0
            for k, rows in once:
                hit = rows[repeated[i : i + len(rows)]]
                found[hit] |= np.uint64(1 << k)
                i += len(rows)
        some = pa.array(found != 0)
        return pa.table({"k1": table.column("k1"), "k2": table.column("k2"), "found": found.view(np.int64)}).filter(some)

    return segments.groupBy("shard").applyInArrow(run, "k1 long, k2 long, found long")


def without_repeats(packed: DataFrame, found: DataFrame, window: int) -> DataFrame:
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        shape = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        if not docs.num_rows:
            return shape.empty_table()
        ids, text = block_rows(docs)
        w = Words.by_parts(text)
        edge = np.zeros(len(w.codes) + 1, np.int64)
        if hits.num_rows:
            start = w.offsets[hits.column("doc").to_numpy()] + hits.column("start").to_numpy()
            bits = hits.column("found").to_numpy().view(np.uint64)
            for k in range(64):
                at = start[(bits >> np.uint64(k)) & np.uint64(1) == 1] + k
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
        stay = np.cumsum(edge)[:-1] == 0
        words = w.uniques.to_numpy(zero_copy_only=False).astype(object)
        ends = np.concatenate([[0], np.cumsum(stay)])[w.offsets]
        left = words[w.codes[stay]] if len(w.codes) else words
        kept = [" ".join(left[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([ids.cast(pa.int64()), pa.array(w.lengths), pa.array(w.lengths - np.diff(ends)), pa.array(kept, pa.string())], schema=shape)

    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, shard_segments: int = SHARD_SEGMENTS, hot: int = HOT
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words left, joined by one blank)."""
    if not gram <= window <= gram + 62:
        raise ValueError("a segment's windows are bits of one number: gram <= window <= gram + 62")
    packed, _ = in_blocks(texts(docs), block_bytes)
    anchors = find_anchors(packed, window, gram)
    repeated = repeated_anchors(anchors, hot)
    segments = stored(cut_segments(packed, repeated, window, gram), "substring-segments")
    shards = parts(segments.count(), shard_segments)
    distinct = segments.groupBy("gram", "k1", "k2").agg(F.first("mask").alias("mask"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))
    dealt = distinct.select(F.expr(f"cast(pmod(xxhash64(gram), {shards}) as int)").alias("shard"), "k1", "k2", "mask", "words", "n")
    found = stored(search_shards(dealt, window), "substring-found")
    hits = segments.select("k1", "k2", "block", "doc", "start").join(found, ["k1", "k2"]).select("block", "doc", "start", "found")
    again, _ = in_blocks(texts(docs), block_bytes)
    return without_repeats(again, hits, window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
