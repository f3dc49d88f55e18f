"""Join helpers: size-checked broadcast and the NULL-safe full outer merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame | None:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows; else return None.

    The table (a small derived dimension such as the name weights) is persisted and counted:
    it is computed once, the count is exact, and the broadcast or the fallback join reads the
    stored blocks. Later plans in the session that compute the same table find it in Spark's
    cache (``spark.catalog.clearCache()`` releases it). A lost executor only means its blocks are
    recomputed from the short lineage. The caller falls back to a shuffle join when None comes
    back.
    """
    stored = df.persist(StorageLevel.MEMORY_AND_DISK)
    if stored.count() <= max_rows:
        return F.broadcast(stored)
    # Too large to broadcast: do not hold a big table in the cache; the shuffle join that
    # follows recomputes it from its (short) lineage.
    stored.unpersist(blocking=False)
    return None


def outer_merge_all(sides: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of any number of tables on ``keys``; NULL matches NULL (as R's ``merge(all=TRUE)`` does).

    Every side holds at most one row per key (as report rows do): a second one raises an error that
    names the side. Instead of a chain of joins, each of which would shuffle what was merged before,
    the sides are put below each other, tagged, and grouped by the keys: one exchange for all of
    them, in which a NULL key is a key and the rows per key and side are counted as well. Columns are
    those of the sides in order; other names than the keys must differ between the sides.
    """
    rest = [[c for c in side.columns if c not in keys] for side in sides]
    flat = [c for names in rest for c in names]
    if len(set(flat)) != len(flat):
        raise ValueError(f"columns of more than one side: {sorted(c for c in set(flat) if flat.count(c) > 1)}")
    tagged = None
    for i, (side, names) in enumerate(zip(sides, rest, strict=True)):
        row = F.struct(F.lit(i).alias("__side"), *[F.col(c) for c in names]).alias(f"__{i}")
        part = side.select(*keys, row)
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    merged = tagged.groupBy(*keys).agg(
        *[F.first(f"__{i}", ignorenulls=True).alias(f"__{i}") for i in range(len(sides))],
        *[F.count(f"__{i}").alias(f"__n{i}") for i in range(len(sides))],
    )
    # The check is part of every value, so that no plan can leave it out.
    most = F.greatest(*[F.col(f"__n{i}") for i in range(len(sides))], F.lit(0))
    which = F.concat_ws(", ", *[F.when(F.col(f"__n{i}") > 1, F.lit(str(i))) for i in range(len(sides))])
    named = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys])
    twice = F.raise_error(F.concat(F.lit("outer_merge: more than one row for "), named, F.lit(" on side "), which))
    checked = lambda value: F.when(most > 1, twice).otherwise(value)
    cols = [checked(F.col(f"__{i}.{c}")).alias(c) for i, names in enumerate(rest) for c in names]
    key_cols = [checked(F.col(k)).alias(k) if j == 0 else F.col(k) for j, k in enumerate(keys)]
    return merged.select(*key_cols, *cols)


def outer_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`outer_merge_all` of two tables."""
    return outer_merge_all([left, right], keys)
