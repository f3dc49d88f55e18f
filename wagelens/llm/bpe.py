"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding.

Method. A text is cut into pieces by the tokenizer's pattern; each distinct piece of the corpus is
encoded once (see ``vocab`` for how words and their ids travel). A piece is its bytes (in hexadecimal)
and where its parts begin; Spark's ``aggregate`` folds merges over it: each step joins the leftmost
adjacent pair of the lowest rank, until no pair has a rank. Ranks come from a map that a scalar subquery
gives, cut into ``BUCKETS`` small maps by a hash because Spark searches a map from its start.
Decoding looks up each id's bytes in a literal array and concatenates them.

Scale. The rank file is bounded (the vocabulary's size is checked); it is the only thing in the plan.
A piece looks up as many pairs as it has bytes and two for each merge; its parts are copied at each
merge, so it costs the square of its length: texts are cut by the pattern, so pieces are short.

Defined cases: null text is empty and has no ids; repeated rows are encoded again; null doc_id is
kept; an empty table gives no rows; other columns are ignored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import json
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, texts
from .vocab import BLOCK_BYTES, encoded
from .wordbatch import coded, text_bytes

BUCKETS = 1 << 14
MAX_RANKS = 1 << 20  # the largest vocabulary that is put into a plan
NO_RANK = 2**31 - 1
PLACES = 2**32  # more than a piece has bytes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The endings that the pattern takes off after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")


class Pieces:
    """The matches of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    Found for all texts at once from runs of code points of one class: a run is a piece; white space
    before something else gives up its last character, which joins what follows if it is a blank; an
    apostrophe alone takes a known ending.
    """

    def __init__(self, texts_: pa.Array):
        data, at = text_bytes(texts_)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(points)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(lead, at)] = True
        first[n] = True
        kind = self.kinds(points)
        begin = first.copy()
        if n:
            begin[1:n] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(begin)  # the last entry is n
        starts, ends = runs[:-1], runs[1:]
        gaps = (kind[starts] == SPACE) & ~first[ends] if n else np.zeros(0, bool)
        last = ends[gaps] - 1
        begin[last] = True
        joined = last[points[last] == 32] + 1 if n else last
        begin[joined] = False
        # Apostrophes that stand alone where a piece begins, before a letter of the same text.
        marks = starts[(points[starts] == 39) & (ends - starts == 1)] if n else starts
        marks = marks[begin[marks] & ~first[marks + 1]]
        marks = marks[kind[marks + 1] == LETTER] if len(marks) else marks
        letter = lambda i, k: np.where((i + k < n) & ~first[np.minimum(i + 1, n)], points[np.minimum(i + k, max(n - 1, 0))], 0) if len(i) else i
        one = np.isin(letter(marks, 1), [ord(c) for c in SHORT_ENDINGS])
        two = np.zeros(len(marks), bool)
        for a, b in LONG_ENDINGS:
            two |= (letter(marks, 1) == ord(a)) & (letter(marks, 2) == ord(b)) & ~first[np.minimum(marks + 2, n)]
        for hit, size in ((one, 2), (two, 3)):
            begin[marks[hit] + 1] = False
            begin[marks[hit] + size] = True
        cut = np.flatnonzero(begin[:n])
        byte = lead[cut]
        self.codes, self.uniques = coded(data, byte)
        self.offsets = np.searchsorted(byte, at)

    @staticmethod
    def kinds(points: np.ndarray) -> np.ndarray:
        import regex

        seen = np.zeros(0x110000, bool)
        seen[points] = True
        table = np.zeros(0x110000, np.int8)
        tests = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\p{White_Space}"))]
        for p in np.flatnonzero(seen):
            table[p] = next((k for k, t in tests if t.match(chr(p))), OTHER)
        return table[points]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{len(ranks)} ranks; at most {MAX_RANKS} are put into a plan")
    return ranks


def _bucket(key: str) -> int:
    """What Spark's ``hash`` gives for an ASCII text, cut to the buckets: Murmur3 of its words of four bytes, then of its last bytes one by one."""
    data, mask = key.encode(), 0xFFFFFFFF
    whole = len(data) & ~3
    blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)] + list(data[whole:])
    h = 42
    for k in blocks:
        k = k * 0xCC9E2D51 & mask
        h ^= ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return (h ^ h >> 16) & BUCKETS - 1


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: the maps {hex of the bytes: rank} by bucket, as JSON."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[_bucket(key)][key] = rank
    return spark.createDataFrame([(json.dumps(maps, separators=(",", ":")),)], "ranks string")


def rank_of(maps: Column, key: Column) -> Column:
    """Rank of a byte string given in hexadecimal, or NO_RANK."""
    bucket = F.get(maps, F.hash(key).bitwiseAND(BUCKETS - 1))
    return F.coalesce(F.try_element_at(bucket, key), F.lit(NO_RANK).cast("long"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merge_step(maps: Column, key: Column, state: Column) -> Column:
    """Joins the leftmost pair of the lowest rank; only the two pairs that this changes are looked up again.

    ``state``: for each piece the rank of the pair that it begins, times ``PLACES``, plus where it
    begins in ``key``; without a pair the rank is NO_RANK, as it is for one entry more in front (at 0)
    and one behind (at the end). So the least entry is the leftmost pair of the lowest rank, and the
    one in front if no pair has a rank.
    """
    at = lambda i: F.get(state, i) % PLACES
    cut = lambda lo, hi: F.substring(key, lo + 1, hi - lo)

    def put(p: Column) -> Column:
        # p, counted from 1, is the pair's first piece. A pair with an end is null and so has no rank.
        keys = F.array(F.when(p > 2, cut(at(p - 2), at(p + 1))), cut(at(p - 1), at(p + 2)))
        pairs = F.transform(keys, lambda k, j: rank_of(maps, k) * PLACES + at(p - 2 + j))
        return F.when(p == 1, state).otherwise(F.concat(F.slice(state, F.lit(1), p - 2), pairs, F.slice(state, p + 2, F.size(state))))

    return let(F.array_position(state, F.array_min(state)).cast("int"), put)


def word_ids(maps: Column, word: Column) -> Column:
    """array<int>: the ids of one piece."""

    def fold(key: Column) -> Column:
        n = F.length(key)
        pairs = F.transform(F.sequence(F.lit(1), n - 1, F.lit(2)), lambda i: F.substring(key, i, F.lit(4)))
        first = F.transform(pairs, lambda k, i: F.when(F.length(k) == 4, rank_of(maps, k)).otherwise(F.lit(NO_RANK).cast("long")) * PLACES + 2 * i)
        ends = lambda at: F.array(at.cast("long") + NO_RANK * PLACES)
        state = F.concat(ends(F.lit(0)), first, ends(n))

        def ids(done: Column) -> Column:
            pieces = F.transform(F.slice(done, F.lit(2), F.size(done) - 2), lambda x, i: F.substring(key, x % PLACES + 1, F.get(done, i + 2) % PLACES - x % PLACES))
            return F.transform(pieces, lambda k: rank_of(maps, k).cast("int"))

        one = rank_of(maps, key)
        many = F.aggregate(F.sequence(F.lit(2), (n / 2).cast("int")), state, lambda s, _: merge_step(maps, key, s), ids)
        return F.when(one != NO_RANK, F.array(one.cast("int"))).otherwise(many)

    return let(F.hex(word.cast("binary")), fold)


def fold_words(ranks: dict[bytes, int], rows: DataFrame) -> DataFrame:
    """Adds the ids of each of the row's distinct words. The maps are read once for a row, bound to a variable.

    They come as a scalar subquery: a literal of this size is written out, several times, in each
    description of the plan that the driver makes while the query runs.
    """
    given = rows.withColumn("ranks", rank_table(rows.sparkSession, ranks).scalar())
    maps = F.from_json("ranks", "array<map<string,bigint>>")
    return given.withColumn("ids", let(maps, lambda m: F.transform("words", lambda w: word_ids(m, w)))).drop("ranks")


def encode(docs: DataFrame, ranks: dict[bytes, int], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids (array<int>) of every row. Smaller blocks take less memory, larger ones repeat fewer words."""
    return encoded(texts(docs), Pieces, partial(fold_words, ranks), block_bytes)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    top = max(ranks.values(), default=-1) + 1
    table = [""] * top
    for token, rank in ranks.items():
        table[rank] = token.hex()
    pieces = F.split(F.lit(",".join(table)), ",", -1)
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = encode(documents(spark, sf_dir), ranks)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )
