"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Method. Each text becomes ``len(FEATURES)`` statistics of its words and lines, transformed towards a
bell shape (logarithms of counts, ratios with a floor). Per class the mean and covariance come from
sums over all labelled training rows; each class covariance is shrunk towards the pooled one and
that towards a multiple of the identity. The score is the logistic of the difference of the two
Mahalanobis log densities, taken with Cholesky factors that are computed once and cached.

Scale. Statistics are computed where the text is read, about a MB of texts at a time; what is stored and
joined with the labels is one row of numbers per document. The sums are one aggregate with partial
sums; the driver sees two small matrices. Every labelled row whose fold is not held out is used.

Defined cases: null and empty texts have all counts 0 and get a score like any other; unlabelled
rows (and null labels) are scored but not learnt from; without rows of both classes the score is
the share of class 1 among the training rows (0.5 without any); repeated rows count as often as
they stand; a null doc_id is never held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, text_or_empty, texts
from .wordbatch import Words, by_bytes, segment_sums

FEATURES = (
    "words", "word_length", "long_words", "upper", "symbols", "bars", "marks", "digits", "marked_words", "upper_words",
    "distinct", "top_word", "repeats", "line_words", "repeated_lines", "stops",
)
POOLED = 0.15  # weight of the pooled covariance in each class covariance
RIDGE = 0.02  # weight of the scaled identity
THRESHOLD = 0.3
FOLDS = 5
FLOOR = 1e-3
SLICE_BYTES = 1 << 20  # of texts whose words are held at a time


def word_stats(words: pa.Array) -> np.ndarray:
    """Per distinct word: characters, upper-case letters, symbols, bars, marks, digits, ends in a symbol, is upper case."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float)
    count = lambda pattern: pc.count_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(float)
    upper = count(r"\p{Lu}")
    symbols = count(r"[^\p{L}\p{N}.,;:!?'\"|-]")
    bars, marks, digits = count(r"\|"), count(r"[!?]"), count(r"\p{N}")
    marked = pc.match_substring_regex(words, r"[^\p{L}\p{N}.,;:'\")\]-]{2,}$").to_numpy(zero_copy_only=False).astype(float)
    shout = ((upper >= 2) & (upper >= 0.6 * length)).astype(float)
    return np.stack([length, upper, symbols, bars, marks, digits, marked, shout], axis=1)


def features(texts_: pa.Array) -> np.ndarray:
    """The transformed statistics, one row per text."""
    w = Words(texts_)
    n = w.lengths.astype(float)
    least = np.maximum(n, 1)
    if len(w.codes):
        per = word_stats(w.uniques)[w.codes]
    else:
        per = np.zeros((0, 8))
    sums = np.stack([segment_sums(per[:, k], w.offsets) for k in range(per.shape[1])], axis=1)
    chars = np.maximum(sums[:, 0], 1)
    ends = pc.ends_with(w.uniques, ".").to_numpy(zero_copy_only=False).astype(float) if len(w.uniques) else np.zeros(0)
    stops = segment_sums(ends[w.codes] if len(w.codes) else np.zeros(0), w.offsets)
    long_words = segment_sums((per[:, 0] > 14).astype(float), w.offsets)
    # Distinct words and the commonest word of each text.
    size = max(len(w.uniques), 1)
    pairs, times = np.unique(w.owner() * size + w.codes, return_counts=True)
    of = pairs // size
    distinct = np.bincount(of, minlength=len(w)).astype(float)[: len(w)]
    top = np.zeros(len(w))
    np.maximum.at(top, of, times)
    same = np.zeros(len(w.codes))
    if len(same) > 1:
        same[1:] = (w.codes[1:] == w.codes[:-1]) & (w.owner()[1:] == w.owner()[:-1])
    repeats = segment_sums(same, w.offsets)
    # Lines and the share of them that stand before in the text.
    lists = pc.split_pattern(pc.fill_null(texts_.cast(pa.large_string()), ""), "\n")
    at = np.asarray(lists.offsets, dtype=np.int64)
    at = at - at[0]
    lines = np.diff(at).astype(float)
    codes = np.asarray(lists.flatten().dictionary_encode().indices, dtype=np.int64)
    kinds = max(int(codes.max()) + 1 if len(codes) else 1, 1)
    line_of = np.repeat(np.arange(len(w)), np.diff(at))
    different = np.bincount(np.unique(line_of * kinds + codes) // kinds, minlength=len(w)).astype(float)[: len(w)]
    share = lambda x: np.log(x + FLOOR)
    return np.stack(
        [
            np.log1p(n), sums[:, 0] / least, share(long_words / least), share(sums[:, 1] / chars), share(sums[:, 2] / chars),
            share(sums[:, 3] / least), share(sums[:, 4] / least), share(sums[:, 5] / chars), share(sums[:, 6] / least),
            share(sums[:, 7] / least), np.log(np.maximum(distinct, 1)) - 0.75 * np.log(least), share(top / least),
            share(repeats / least), np.log1p(n / np.maximum(lines, 1)), share(1 - different / np.maximum(lines, 1)),
            share(stops / least),
        ],
        axis=1,
    )


def sliced_features(texts_: pa.Array, limit: int = SLICE_BYTES) -> np.ndarray:
    """``features``, taken of about ``limit`` bytes of texts at a time (or one text): what stands beside a batch is bounded."""
    batch = pa.RecordBatch.from_arrays([texts_], ["text"])
    return np.concatenate([np.zeros((0, len(FEATURES))), *[features(b.column(0)) for b in by_bytes(batch, 0, limit)]])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = sliced_features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, k]) for k in range(x.shape[1])]], ["doc_id", *FEATURES])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Model:
    """Means, inverse Cholesky factors, log determinants and log priors of class 0 and 1; ``share`` alone if a class is missing."""

    share: float
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    offset: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.share)
        logs = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """From the rows of the training folds: ``labels`` has doc_id and quality (0 or 1)."""
    d = len(FEATURES)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    rows = stats.join(marks, "doc_id").where(~held_out())
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()
    by = {r["y"]: r for r in sums}
    total = sum(r["n"] for r in sums)
    if len(by) < 2:
        return Model(by[1]["n"] / total if 1 in by else 0.0) if total else Model(0.5)
    mean, cov, n = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    for k, r in by.items():
        n[k] = r["n"]
        mean[k] = [r[f"s{i}"] / r["n"] for i in range(d)]
        for i, j in pairs:
            cov[k, i, j] = cov[k, j, i] = r[f"p{i}_{j}"] / r["n"] - mean[k, i] * mean[k, j]
    common = (n[0] * cov[0] + n[1] * cov[1]) / total
    whiten, offset = np.zeros((2, d, d)), np.zeros(2)
    scale = np.sqrt(np.maximum(np.diag(common), 1e-6))  # the ridge acts on standardised features
    for k in (0, 1):
        c = (1 - pooled) * cov[k] + pooled * common
        c = (1 - ridge) * c + ridge * np.diag(scale**2)
        factor = np.linalg.cholesky(c + 1e-9 * np.diag(scale**2))
        whiten[k] = np.linalg.inv(factor)
        offset[k] = np.log(n[k] / total) - np.log(np.diag(factor)).sum()
    return Model(n[1] / total, mean, whiten, offset)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy() for i in range(len(FEATURES))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows of the training folds and scores every row: doc_id, held_out, score, predicted."""
    stats = stored(statistics(docs), "quality-stats")
    out = scored(stats, fit(stats, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are.

    Only the text goes to Python, which returns one number a row; the other columns stay where they are.
    """
    model = fit(stored(statistics(docs), "quality-stats"), labels)

    @F.arrow_udf("double")
    def score(texts_: pa.Array) -> pa.Array:
        return pa.array(model.score(sliced_features(texts_)))

    return docs.where(score(text_or_empty(docs)) >= THRESHOLD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
