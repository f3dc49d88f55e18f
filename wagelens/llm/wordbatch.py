"""Words of a batch of texts as integer codes: Arrow and numpy helpers used inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins (one entry more than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


SLICE_BYTES = 4 << 20


def by_bytes(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in ``column`` have about ``limit`` bytes (or one row): what is made from them is bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()  # else a worker keeps what its largest slice took, also while it is idle


PART_BYTES = 1 << 20

#: text array -> object with codes, offsets, uniques
Split = Callable[[pa.Array], object]


def split_parts(texts: pa.Array, split: Split, limit: int = PART_BYTES) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes, distinct words and offsets of all texts as ``split`` gives them, split about ``limit`` bytes (or one text) at a time.

    Words stand in the order of their first place, as if all were split at once; the arrays that splitting needs are of a part's size.
    """
    found = [split(b.column(0)) for b in by_bytes(pa.record_batch([texts], ["text"]), 0, limit)] or [split(texts)]
    names = pa.concat_arrays([w.uniques for w in found]).dictionary_encode()
    place = np.asarray(names.indices, dtype=np.int64)
    words = np.cumsum([0, *(len(w.uniques) for w in found)])
    pieces = np.cumsum([0, *(len(w.codes) for w in found)])
    codes = np.empty(pieces[-1], np.int64)
    for w, name, piece in zip(found, words, pieces, strict=False):
        codes[piece : piece + len(w.codes)] = place[name + w.codes]
    offsets = [w.offsets[:-1] + piece for w, piece in zip(found, pieces, strict=False)]
    return codes, names.dictionary, np.concatenate([*offsets, pieces[-1:]])


def coded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct words of the pieces of ``data`` that begin at ``starts`` (the first at 0)."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    ends = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    both = words.dictionary_encode()
    return np.asarray(both.indices, dtype=np.int64), both.dictionary


def _inside(data: np.ndarray, spellings: tuple[str, ...]) -> np.ndarray:
    """Which bytes are part of a spelling, A-Z and a-z taken as equal."""
    out = np.zeros(len(data), bool)
    whole = data.tobytes().lower()
    for s in spellings:
        s = s.encode().lower()
        at = whole.find(s)
        while at >= 0:
            out[at : at + len(s)] = True
            at = whole.find(s, at + 1)
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text: ``codes[offsets[i]:offsets[i+1]]`` index ``uniques``.

    ``lower`` puts A-Z into lower case. ``marks`` are bytes before which a word also ends if an
    ASCII letter or digit stands there; A-Z are then put into lower case where an ASCII byte follows,
    but not inside a spelling of ``keep`` in any case: whether it is that spelling stays to be seen.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, marks: bytes = b"", keep: tuple[str, ...] = ()):
        data, at = text_bytes(texts)
        size = len(data)
        gap = _table(SPACES)[data]
        begin = ~gap
        if size:
            inner = begin[1:] & begin[:-1]
            if marks:
                plain = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")[data]
                inner &= ~(_table(marks)[data[1:]] & plain[:-1])
            begin[1:] &= ~inner
            first = at[:-1][at[:-1] < at[1:]]
            begin[first] = ~gap[first]
        starts = np.flatnonzero(begin)
        if lower or marks:
            upper = (data >= 65) & (data <= 90)
            if marks and size:
                upper[:-1] &= data[1:] < 128
            if keep:
                upper &= ~_inside(data, keep)
            data = np.where(upper, data | 32, data).astype(np.uint8)
        before = np.concatenate([[0], np.cumsum(~gap)])
        self.codes, self.uniques = coded(data[~gap], before[starts])
        self.offsets = np.searchsorted(starts, at)

    @classmethod
    def by_parts(cls, texts: pa.Array) -> Words:
        """The same, with less memory for many texts."""
        words = cls.__new__(cls)
        words.codes, words.uniques, words.offsets = split_parts(texts, cls)
        return words

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in the order of the words."""
        return word_hashes(self.uniques)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.lengths)


def word_hashes(words: pa.Array) -> np.ndarray:
    values = words.to_numpy(zero_copy_only=False).astype(object)
    return pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal in, equal out, all bits spread."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries; there are ``len(h) - n + 1``, or none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = mix(h[: len(h) - n + 1])
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each ``values[offsets[i]:offsets[i+1]]``, 0 for an empty one."""
    sums = np.cumsum(values)
    total = np.zeros(len(sums) + 1, sums.dtype)  # of one type, so that 64-bit sums stay whole
    total[1:] = sums
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[offsets[r]:offsets[r+1]]`` of ``rows``, one after the other, and where each ends and begins."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], lengths)
    return values[index], ends
