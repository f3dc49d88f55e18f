"""Near-duplicate groups by an LSH forest over min-hash signatures, links confirmed on full sets.

Method. A document's set holds its distinct runs of ``words`` lower-cased words (64-bit hashes).
Documents with equal sets form one class at once. Each class has ``TREES`` signature orders: a tree's
key is a sequence of ``DEPTH`` min-hashes, and classes that share a prefix of it stand together when
the order is sorted. A region is such a prefix of ``LEAST`` min-hashes, whatever its size. First
every class is compared with the smallest class of its regions, then with its neighbour in the sorted
orders (the longest common prefix). The classes of regions that still hold different components stay open; open classes are compared where they share
one of their rarest shingles early enough to be linked (an exact prefix and position filter).
Comparisons are on the full sets. What was left out are pairs already in one component, which change
nothing, and pairs that the filter proves to be below the threshold.

Chance: a pair of similarity 0.8 shares no region of depth 4 in any of 20 trees with probability
(1 - 0.8^4)^20 = 3e-5, one of 0.85 with 4e-7, one of 0.9 with 1e-9. One that shares a region ends in one
component, however many classes the region has.

Scale. What is shuffled: one sketch per document, TREES short keys per class, the texts once (by
doc_id, those of classes that share a region are kept) and the sets of pairs compared. A large group
of near copies costs one comparison per class and smallest neighbour, not one per pair. Joins on a
hot class or region are ones that Spark can split; sums are taken in parts first.

Defined cases: a null text is empty; a text without words has no set, is alone and is kept; a text
with fewer words than a run has one run, the whole; repeated rows are in one class; a null doc_id
counts as the largest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, texts
from .components import components
from .wordbatch import PART_BYTES, Words, by_bytes, grams, mix, segment_sums

TREES, DEPTH, LEAST = 20, 6, 4
BINS = 1 << 18  # of shingle counts; the only thing that is collected
PERCENT = 80
SLICE = 1 << 20  # shingles hashed at a time


def shingles(texts_: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of each text, sorted, as one array and its offsets."""
    w = Words(texts_, lower=True)
    h, owner = w.hashes(), w.owner()
    g = grams(h, k)
    ok = owner[: len(g)] == owner[k - 1 : k - 1 + len(g)]
    text, key = owner[: len(g)][ok], g[ok]
    short = np.flatnonzero((w.lengths > 0) & (w.lengths < k))
    if len(short):
        whole = [grams(h[w.offsets[i] : w.offsets[i + 1]], int(w.lengths[i]))[0] ^ np.uint64(w.lengths[i]) for i in short]
        text, key = np.concatenate([text, short]), np.concatenate([key, np.array(whole, np.uint64)])
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[new], np.searchsorted(text[new], np.arange(len(w) + 1))


def set_keys(values: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set: equal sets, equal names. None for an empty set."""
    with np.errstate(over="ignore"):
        a, b = segment_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), offsets), segment_sums(mix(values + np.uint64(0x14057B7EF767814F)), offsets)
    both = np.stack([a.astype(np.uint64), b.astype(np.uint64)], axis=1)
    return [x.tobytes() if n else None for x, n in zip(both, np.diff(offsets), strict=True)]


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """TREES * DEPTH 32-bit min-hashes of each non-empty set."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    out = np.full((len(full), len(a)), 2**32 - 1, np.uint32)
    at = offsets[full]
    for lo in range(0, len(values), SLICE):
        part = values[lo : lo + SLICE]
        first = max(np.searchsorted(at, lo, "right") - 1, 0)
        last = np.searchsorted(at, lo + len(part))
        cuts = np.maximum(at[first:last], lo) - lo
        for j in range(len(a)):
            low = np.minimum.reduceat(((part * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), cuts)
            out[first:last, j] = np.minimum(out[first:last, j], low)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, c (name of the set, null if empty), trees (one key per tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "text", PART_BYTES):
                values, offsets = shingles(part.column("text"), k)
                # Big-endian, so that keys compare as their min-hashes do.
                sig = iter(signatures(values, offsets).astype(">u4"))
                names = set_keys(values, offsets)
                trees = [None if c is None else (lambda s: [s[t * DEPTH : (t + 1) * DEPTH].tobytes() for t in range(TREES)])(next(sig)) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(names, pa.binary()), pa.array(trees, pa.list_(pa.binary()))],
                    ["doc_id", "n_shingles", "c", "trees"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, c binary, trees array<binary>")


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """Of (c, text): c and the set, once per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, "text", PART_BYTES):
                values, offsets = shingles(part.column("text"), k)
                names = set_keys(values, offsets)
                keep = [i for i, (n, c) in enumerate(zip(names, part.column("c").to_pylist(), strict=True)) if n == c]
                data = [values[offsets[i] : offsets[i + 1]].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.binary()), pa.array(data, pa.binary())], ["c", "items"])

    return rows.mapInArrow(run, "c binary, items binary").dropDuplicates(["c"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(n)[i].as_buffer(), np.uint64) for n in ("x", "y"))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inter = int((y[at] == x).sum())
                keep[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = sets.select(F.col("c").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("c").alias("b"), F.col("items").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def bin_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each of ``BINS`` bins of hash values occur in the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            for x in b.column("items"):
                total += np.bincount(bins(np.frombuffer(x.as_buffer(), np.uint64)), minlength=BINS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for b, n in sets.select("items").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        out[b] = n
    return out


def bins(values: np.ndarray) -> np.ndarray:
    return (values % np.uint64(BINS)).astype(np.int64)


def rare_shingles(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """c, root, n, ``at`` and one ``item`` a row: the rarest shingles of each set, one more than a partner may lack, and their places.

    All sets are put in one order (bin count, then hash value), so two sets that lie ``percent`` or
    more over each other have one of these shingles in common, whatever the counts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column("items")[i].as_buffer(), np.uint64)
                order = np.lexsort((x, counts[bins(x)]))
                few = x[order[: len(x) - -(-percent * len(x) // 100) + 1]].view(np.int64)
                same = [pa.array([b.column(n)[i].as_py()] * len(few), pa.binary()) for n in ("c", "root")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(np.full(len(few), len(x))), pa.array(np.arange(len(few))), pa.array(few)], ["c", "root", "n", "at", "item"]
                )

    return sets.select("c", "root", "items").mapInArrow(run, "c binary, root binary, n long, at long, item long")


def sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with different roots that share a rare shingle and can be linked.

    Sets share nothing before the first shingle that they share, so what each has from there on
    bounds the intersection; sizes are bounded by the same condition. One side of a pair is outside the item's main component, so a large group isn't paired with itself.
    """
    rows = stored(rare_shingles(sets, bin_counts(sets), percent), "near-rare")
    main = rows.groupBy("item").agg(F.min("root").alias("main"), F.max("root").alias("other")).where("main <> other").drop("other")
    out = rows.join(main, "item")
    a = out.where("root <> main").select("item", F.col("c").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), (F.col("n") - F.col("at")).alias("la"))
    b = out.select("item", F.col("c").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), (F.col("n") - F.col("at")).alias("lb"))
    fits = F.expr(f"ra <> rb and {100 + percent} * least(la, lb) >= {percent} * (na + nb)")
    return a.join(b, "item").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prefix(depth: int):
    return F.substring(F.col("key"), 1, 4 * depth)


def unresolved(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the regions that hold classes of different components, with their roots."""
    placed = shared.join(roots, shared["c"] == roots["node"], "left").select("tree", "p", "key", "c", F.coalesce("root", "c").alias("root"))
    open_ = placed.groupBy("tree", "p").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tree", "p")
    return stored(placed.join(open_, ["tree", "p"]).select("tree", "p", "key", "c", "root"), "near-placed")


def neighbours(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that stand side by side in a sorted order, share a region and have different roots.

    The order is dealt out by range, so a large region spreads over tasks. A pair across two tasks is
    not seen here; like all pairs that are not neighbours it is left to the comparison that follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows = list(zip(*(b.column(n).to_pylist() for n in ("tree", "p", "c", "root")), strict=True))
            pairs = [(min(x[2], y[2]), max(x[2], y[2])) for x, y in zip([last, *rows[:-1]], rows, strict=True) if x and x[:2] == y[:2] and x[3] != y[3]]
            last = rows[-1] if rows else last
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

    order = ["tree", "key", "c"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "p", "c", "root").mapInArrow(run, "a binary, b binary").distinct()


def near_groups(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, c (class), component_id, kept."""
    text = texts(docs)
    sketch = stored(sketches(text, k), "near-sketch")
    classes = stored(sketch.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("trees").alias("trees")), "near-classes")
    keys = classes.select("c", F.posexplode("trees").alias("tree", "key"))
    sizes = keys.groupBy("tree", prefix(LEAST).alias("p")).agg(F.min("c").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = keys.withColumn("p", prefix(LEAST))
    shared = stored(keyed.join(sizes, ["tree", "p"]).select("tree", "p", "key", "c", "hub"), "near-regions")

    # The full sets of the classes that share a region.
    some = shared.select("c").distinct().join(classes.select("c", "rep"), "c")
    rows = text.alias("t").join(some.alias("s"), F.expr("t.doc_id <=> s.rep")).select("s.c", "t.text")
    sets = stored(full_sets(rows, k), "near-sets")

    stars = shared.where("c <> hub").select(F.col("c").alias("a"), F.col("hub").alias("b")).distinct()
    links = stored(confirmed(stars, sets, percent), "near-links")
    first = components(links)

    # Neighbours in the sorted orders that are still in different components.
    placed = unresolved(shared, first)
    beside = stored(confirmed(neighbours(placed), sets, percent), "near-links")
    links = links.unionByName(beside)
    second = first if beside.isEmpty() else components(links)

    # What is left: all classes of regions that still hold different components, whatever the region's size.
    open_ = stored(unresolved(shared, second).select("c", "root").distinct().join(sets, "c"), "near-open")
    more = sharing_rare(open_, percent)
    extra = stored(confirmed(more, sets, percent), "near-links")
    final = second if extra.isEmpty() else components(links.unionByName(extra))

    # The smallest doc_id of each component, handed back to its classes and their documents.
    roots = classes.join(final, classes["c"] == final["node"], "left").select("c", "rep", F.coalesce("root", "c").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(roots.join(least, "root").select("c", "component_id"), "near-named")
    rows = sketch.drop("trees").join(named, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", "c", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns as they are; a repeated row is returned once."""
    kept = stored(near_groups(docs, k).where("kept").select(F.col("doc_id").alias("__id"), "n_shingles").distinct(), "near-kept")
    both = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]), "left_semi")
    return both.dropDuplicates(["doc_id", "text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), 2).drop("c")
