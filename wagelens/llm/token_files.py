"""Token ids in ORC: integer run lengths, row indexes, Bloom filters on document ids.

Method. Texts are encoded with the given ``tokenizers`` file, an end id closes each document, and
the rows (doc_id, offset in the file, ids) are written as ORC in ascending doc_id order: one file
per range of doc_ids (quantiles taken from the doc_id column), sorted inside. ORC run-length-encodes
the integers; row indexes and a Bloom filter on doc_id let readers skip stripes and row groups;
stripes are read in parallel. Reading back, a document's start is its file's first position (a sum
over one row per file) plus its offset.

Scale. Texts are encoded where they are read, a few MB at a time; what is shuffled is the packed ids,
once. A tokenizer is slow and words repeat, so a worker process encodes a distinct word once and remembers
up to ``REMEMBERED``: for this tokenizer white space separates words and is dropped, and a mark after a
letter or digit begins a new piece, so the ids of a text are those of its pieces, one after the other.
Pieces are put into lower case, as the tokenizer does, to have fewer distinct ones; an added token's
spelling in any case is left as it is, because the tokenizer looks for added tokens in the raw text.
A doc_id with more rows than a file holds on average, or null, is spread over as many files as it needs.

Defined cases: null text is empty and has the end id alone; rows with the same doc_id stand
together, in an order given by a hash; null doc_id comes first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import documents, scratch_path, texts
from .wordbatch import Words, by_bytes, ragged

END_ID = 2
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # ASCII punctuation but the apostrophe and what added tokens begin and end with
REMEMBERED = 750_000  # words of a worker process with their ids, some 150 MB
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
ROWS = "doc_id long, offset long, ids array<int>"


def added_tokens(tokenizer_file: str) -> tuple[str, ...]:
    with open(tokenizer_file, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


class WordIds:
    """The ids of words; those of the words seen last are remembered, at most ``limit`` and one slice's."""

    def __init__(self, tokenizer_file: str, limit: int, added: tuple[str, ...] = ()):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.added = Tokenizer.from_file(tokenizer_file), limit, added
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.values, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def of(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each of the distinct ``words`` stand: entry i is ``values[ends[i]:ends[i + 1]]``."""
        names = words.to_pylist()
        at = np.fromiter((self.place.get(x, -1) for x in names), np.int64, len(names))
        if (at < 0).any():
            if len(self.place) + int((at < 0).sum()) > self.limit:
                self.forget()
                at[:] = -1
            new = np.flatnonzero(at < 0)
            self.learn([names[i] for i in new])
            at[new] = [self.place[names[i]] for i in new]
        return at

    def learn(self, words: list[str]) -> None:
        # Words that hold an added token's spelling stand alone.
        alone = [w for w in words if any(x.lower() in w.lower() for x in self.added)] if self.added else []
        held = set(alone)
        rest = [w for w in words if w not in held]
        parts = [(self.together, rest[lo : lo + 20_000]) for lo in range(0, len(rest), 20_000)]
        values, counts = [self.values], []
        for encode, some in [*parts, (self.apart, alone)]:
            if some:
                ids, n = encode(some)
                values.append(ids)
                counts.append(np.asarray(n, np.int64))
                self.place.update(zip(some, range(len(self.place), len(self.place) + len(some)), strict=True))
        self.values = np.concatenate(values)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])

    def apart(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), [len(x) for x in found]

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray | list[int]]:
        """The words as one text with an added token between each two, at which tokenizers cut a text first."""
        mark = next((self.tokenizer.token_to_id(x) for x in self.added), None)
        if mark is None:
            return self.apart(words)
        ids = np.array(self.tokenizer.encode_batch_fast([self.added[0].join(words)], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(ids == mark)
        if len(cuts) != len(words) - 1:
            return self.apart(words)
        return ids[ids != mark], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1


def remembered(tokenizer_file: str, added: tuple[str, ...]) -> WordIds:
    """The words of this worker process, which outlives a task: kept with the tokenizers library, for one file at a time."""
    import os

    import tokenizers

    kept, name = vars(tokenizers).setdefault("_words_of_this_worker", {}), (tokenizer_file, os.stat(tokenizer_file).st_mtime_ns, added)
    if name not in kept:
        kept.clear()
        kept[name] = WordIds(tokenizer_file, REMEMBERED, added)
    return kept[name]


def packed_ids(end_id: int, ids: pa.ListArray) -> pa.Table:
    """Each list with the end id after it as compressed bytes, for the way to its file; n ids, ``width`` bytes each."""
    at, flat = np.asarray(ids.offsets, dtype=np.int64), np.asarray(ids.flatten(), dtype=np.int32)
    at = at - at[0]
    width = 2 if max(flat.max(initial=0), end_id) < 1 << 16 else 4
    whole = [np.append(flat[s:e], end_id).astype(f"<u{width}").tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
    data = [pa.compress(x, codec="zstd", asbytes=True) for x in whole]
    return pa.table({"n": np.diff(at) + 1, "width": pa.array([width] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})


def unpacked_ids(n: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd"), f"<u{width}").astype(np.int32)


def encode(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and the packed ids (n, width, data) of every row, the end id included; ``place`` is the row's in its task."""
    keep = added_tokens(tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = remembered(tokenizer_file, keep), 0
        for whole in batches:
            for b in by_bytes(whole, "text"):
                w = Words(b.column("text"), marks=MARKS, keep=keep)
                at = known.of(w.uniques)
                flat, ends = ragged(known.values, known.ends, at[w.codes] if len(w.codes) else np.zeros(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends[w.offsets].astype(np.int32)), pa.array(flat))
                packed = packed_ids(end_id, lists)
                columns = [b.column("doc_id"), pa.array(np.arange(place, place + b.num_rows)), *[packed.column(c).combine_chunks() for c in ("n", "width", "data")]]
                place += b.num_rows
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n", "width", "data"])

    return texts(docs).mapInArrow(run, "doc_id long, place long, n long, width int, data binary")


def file_cuts(docs: DataFrame) -> list[int | None]:
    """The doc_ids at which files begin after the first: quantiles, one for each shuffle partition.

    A doc_id that fills several files stands several times; None in front for files of null doc_ids.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found, rows, known = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5]), F.count("*"), F.count("doc_id")).first()
    nulls = -(-parts * (rows - known) // rows) if rows else 0
    return [None] * nulls + sorted(found or [])


def write(rows: DataFrame, path: str, cuts: list[int | None]) -> None:
    """Writes the packed ids of ``encode`` as ORC files in ascending doc_id order; ``offset`` counts the ids before in the file.

    ``cuts`` (see ``file_cuts``) come from the ids of the documents alone, so the rows are computed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                n = b.column("n").to_numpy()
                ids = [unpacked_ids(*x) for x in zip(n.tolist(), b.column("width").to_pylist(), b.column("data").to_pylist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(at + ends[:-1]), lists], ["doc_id", "offset", "ids"])
                at += int(ends[-1])

    nulls = sum(c is None for c in cuts)
    known = F.lit([c for c in cuts if c is not None]).cast("array<long>")
    below, until = (F.size(F.filter(known, test)) for test in (lambda c: c < F.col("doc_id"), lambda c: c <= F.col("doc_id")))
    share = F.col("tie").cast("double") / 2.0**64 + 0.5  # of the rows of one doc_id

    def spread(files: Column) -> Column:
        return F.least(F.floor(share * files), files - 1).cast("int")

    part = F.when(F.col("doc_id").isNull(), spread(F.lit(max(nulls, 1)))).otherwise(
        nulls + F.col("below") + F.when(F.col("until") > F.col("below"), 1 + spread(F.col("until") - F.col("below"))).otherwise(0)
    )
    dealt = rows.withColumns({"tie": F.xxhash64("data", "place"), "below": below, "until": until}).withColumn("part", part)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions(*order)
    dealt.select("doc_id", "n", "width", "data").mapInArrow(run, ROWS).write.options(**ORC_OPTIONS).orc(path)


def file_number():
    return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, offset (ids before it in its file), ids, file; filters on doc_id reach the ORC reader."""
    return spark.read.schema(ROWS).orc(path).withColumn("file", file_number())


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Per file: its number and the ids in all files before (one row per file; the one window is over those)."""
    totals = (
        spark.read.schema(ROWS).orc(path)
        .select(file_number().alias("file"), (F.col("offset") + F.size("ids")).alias("n"))
        .groupBy("file").agg(F.max("n").alias("n"))
    )
    return totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("first"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            lists = b.column("ids")
            at = np.asarray(lists.offsets, dtype=np.int64)
            flat = np.asarray(lists.flatten(), dtype="<u4")
            at = at - at[0]
            crc = [zlib.crc32(memoryview(flat[s:e])) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("offset"), b.column("file"), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                ["doc_id", "offset", "file", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).mapInArrow(run, "doc_id long, offset long, file int, n_tokens long, ids_crc32 long")
    at = rows.join(positions(spark, path), "file")
    return at.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    docs = documents(spark, sf_dir)
    write(encode(docs, public_tokenizers.path("word_bpe_49k.json")), path, file_cuts(docs))
    return digests(spark, path)
