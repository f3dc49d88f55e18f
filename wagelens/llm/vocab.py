"""Encoding texts word by word with each distinct word of the corpus encoded once.

Texts are dealt to blocks (compressed on the way); each block lists its distinct words, split over
buckets; a bucket gathers its words from all blocks, encodes every distinct one once, and returns
to each block the ids of that block's words; there the texts are put together from them. What moves
is the compressed text once, and per block its distinct words and their ids. Blocks have a bounded
number of bytes (or one text), buckets a bounded share of the blocks' words: both counts follow the
input. No dictionary of the corpus is broadcast or held in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbatch import Split, ragged, split_parts, word_hashes

BLOCK_BYTES = 6 << 20
BLOCKS_PER_BUCKET = 2
PART_WORDS = 1 << 17
HELD_BYTES = 16 << 20

#: rows (bucket, words, blocks, blobs) -> the same with ids array<array<int>>, one per word
Encode = Callable[[DataFrame], DataFrame]


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(table)
    return out.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the rows of each block, from about ``HELD_BYTES`` of rows at a time: small packs compress badly."""

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        of = rows.column(0).to_numpy()
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        for some in np.split(order, cuts) if len(order) else []:
            part = rows.select(["doc_id", "text"]).take(pa.array(some)).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([of[some[0]]], pa.int32()), pa.array([pack(part)], pa.binary())], ["block", "data"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= HELD_BYTES:
            yield from packed(pa.Table.from_batches(held).combine_chunks())
            held, size = [], 0
    if held:
        yield from packed(pa.Table.from_batches(held).combine_chunks())


def in_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, data): the texts packed and dealt by doc_id to blocks of about ``block_bytes``; and the number of blocks.

    Used more than once in a plan, the exchange behind it runs once.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.expr(f"cast(pmod(xxhash64(doc_id), {blocks}) as int)").alias("block"), "doc_id", "text")
    parts = max(1, min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.mapInArrow(to_blocks, "block int, data binary").repartition(parts, "block"), blocks


def block_rows(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """doc_id and text of a block's rows, in the same order wherever the block is read."""
    parts = pa.concat_tables([unpack(d.as_py()) for d in table.column("data").combine_chunks()])
    parts = parts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return parts.column("doc_id").combine_chunks(), parts.column("text").cast(pa.large_string()).combine_chunks()


def as_list(values: pa.Array) -> pa.ListArray:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _dealt(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block's words go to the buckets, and the bucket of each: the same wherever the block is read."""
    rank = pc.array_sort_indices(words).to_numpy()
    bucket = (word_hashes(words) % np.uint64(buckets)).astype(np.int32)
    order = rank[np.argsort(bucket[rank], kind="stable")]
    return order, bucket[order]


def encoded(docs: DataFrame, split: Split, encode: Encode, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and ids (array<int>, the concatenated ids of its words) of every row of ``docs`` (doc_id, text)."""
    packed, blocks = in_blocks(docs, block_bytes)
    buckets = max(1, -(-blocks // BLOCKS_PER_BUCKET))

    def distinct(table: pa.Table) -> pa.Table:
        _, words, _ = split_parts(block_rows(table)[1], split)
        order, bucket = _dealt(words, buckets)
        rows = {"bucket": [], "block": [], "words": []}
        for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1) if len(order) else []:
            rows["bucket"].append(int(bucket[part[0]]))
            rows["block"].append(table.column("block")[0].as_py())
            rows["words"].append(pack(pa.table({"w": words.take(pa.array(order[part]))})))
        return pa.table(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("words", pa.binary())]))

    def gathered(table: pa.Table) -> pa.Table:
        blobs = table.column("words").combine_chunks()
        found = pa.concat_tables([unpack(b.as_py()) for b in blobs]).column("w").unique().cast(pa.string())
        return pa.table(
            {
                "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                "words": as_list(found),
                "blocks": as_list(table.column("block").combine_chunks()),
                "blobs": as_list(blobs),
            }
        )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, ids = b.column("words")[i].values.cast(pa.large_string()), b.column("ids")[i].values
                offsets, values = np.asarray(ids.offsets, dtype=np.int64), np.asarray(ids.flatten(), dtype=np.int32)
                offsets = offsets - offsets[0]
                bucket = b.column("bucket")[i].as_py()
                for block, blob in zip(b.column("blocks")[i].as_py(), b.column("blobs")[i].values, strict=True):
                    rows = pc.index_in(unpack(blob.as_py()).column("w").combine_chunks(), value_set=words)
                    flat, ends = ragged(values, offsets, np.asarray(rows, dtype=np.int64))
                    lists = pa.table({"n": np.diff(ends).astype(np.int32)}), pa.table({"v": flat})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int32()), pa.array([bucket], pa.int32()), pa.array([pack(lists[0])], pa.binary()), pa.array([pack(lists[1])], pa.binary())],
                        ["block", "bucket", "n", "v"],
                    )

    def assembled(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
        ids, text = block_rows(docs_)
        codes, uniques, offsets = split_parts(text, split)
        del text
        order, _ = _dealt(uniques, buckets)
        got = answers.sort_by("bucket")
        n = [unpack(x.as_py()).column("n").to_numpy() for x in got.column("n")]
        v = [unpack(x.as_py()).column("v").to_numpy() for x in got.column("v")]
        lengths = np.concatenate([np.zeros(0, np.int32), *n])
        if len(lengths) != len(order):
            raise RuntimeError("a block's words and their ids differ")
        place = np.empty(len(order), np.int64)  # of each word in the order of the answers
        place[order] = np.arange(len(order))
        values, at = np.concatenate([np.zeros(0, np.int32), *v]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        words = place[codes] if len(codes) else codes
        # The ids of some texts at a time.
        cuts = np.unique([0, *np.searchsorted(offsets, np.arange(PART_WORDS, len(words), PART_WORDS)), len(ids)])
        lists = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            flat, ends = ragged(values, at, words[offsets[lo] : offsets[hi]])
            lists.append(pa.ListArray.from_arrays(pa.array(ends[offsets[lo : hi + 1] - offsets[lo]].astype(np.int32)), pa.array(flat.astype(np.int32))))
        return pa.table({"doc_id": ids.cast(pa.int64()), "ids": pa.chunked_array(lists, pa.list_(pa.int32()))})

    words = packed.groupBy("block").applyInArrow(distinct, "bucket int, block int, words binary")
    gather = words.groupBy("bucket").applyInArrow(gathered, "bucket int, words array<string>, blocks array<int>, blobs array<binary>")
    answers = encode(gather).select("bucket", "words", "blocks", "blobs", "ids").mapInArrow(answered, "block int, bucket int, n binary, v binary")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assembled, "doc_id long, ids array<int>")
