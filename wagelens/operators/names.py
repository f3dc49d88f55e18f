"""Name weights and the lookup that attaches them to payroll rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import bounded_broadcast

UNMATCHED_DROP = "drop"  # rows whose first name has no weight are removed (first profile)
UNMATCHED_ZERO = "zero"  # they stay with both weights 0 and Common = 0, Uncommon = 1 (second profile)
UNMATCHED_KEEP = "keep"  # plain lookup: they stay with NULL weights


def name_sex_counts(names: DataFrame) -> DataFrame:
    """Registrations summed per upper-cased name and sex over all states and years."""
    return names.groupBy(F.upper(F.col("name")).alias("name"), F.col("sex")).agg(
        F.sum("count").alias("count")
    )


def name_spread(counts: DataFrame) -> DataFrame:
    """``name, sex, count`` long -> ``name, F, M`` wide, a missing sex counted as 0.

    The pivot values are given, so Spark does not run a job to find them.
    """
    wide = counts.groupBy("name").pivot("sex", ["F", "M"]).agg(F.sum("count"))
    return wide.fillna(0, ["F", "M"])


def name_weights(names: DataFrame) -> DataFrame:
    """``name, F, M, M_weight, F_weight`` straight from registration rows.

    Summing per (name, sex) and spreading the sexes into columns is one aggregate of
    conditional sums keyed by the upper-cased name: one shuffle, partial sums map-side. A
    name whose counts add up to 0 gets NULL weights (it then counts as unmatched).
    """
    name = F.upper(F.col("name")).alias("name")
    counts = names.groupBy(name).agg(
        F.coalesce(F.sum(F.when(F.col("sex") == "F", F.col("count"))), F.lit(0)).alias("F"),
        F.coalesce(F.sum(F.when(F.col("sex") == "M", F.col("count"))), F.lit(0)).alias("M"),
    )
    total = F.col("M") + F.col("F")
    return counts.select(
        "name",
        "F",
        "M",
        F.try_divide(F.col("M").cast("double"), total.cast("double")).alias("M_weight"),
        F.try_divide(F.col("F").cast("double"), total.cast("double")).alias("F_weight"),
    )


def weights_from_spread(spread: DataFrame) -> DataFrame:
    """Add ``M_weight = M/(M+F)`` and ``F_weight = F/(M+F)`` to a spread table."""
    total = (F.col("M") + F.col("F")).cast("double")
    return spread.withColumns(
        {
            "M_weight": F.try_divide(F.col("M").cast("double"), total),
            "F_weight": F.try_divide(F.col("F").cast("double"), total),
        }
    )


def weight_lookup(weights: DataFrame, max_broadcast_rows: int | None = 1_000_000) -> tuple[DataFrame, bool]:
    """The lookup side of the name join: ``__name, __m, __f``, and whether it is broadcast.

    Broadcast only when its row count is at most ``max_broadcast_rows`` (checked, see
    :func:`bounded_broadcast`); ``None`` means never broadcast.
    """
    w = weights.select(
        F.col("name").alias("__name"),
        F.col("M_weight").alias("__m"),
        F.col("F_weight").alias("__f"),
    )
    if max_broadcast_rows is None:
        return w, False
    small = bounded_broadcast(w, max_broadcast_rows)
    return (small, True) if small is not None else (w, False)


def join_weights(rows: DataFrame, lookup: DataFrame, unmatched: str = UNMATCHED_DROP, name_col: str = "first_name") -> DataFrame:
    """Join a prepared :func:`weight_lookup` side to ``rows`` and apply the unmatched policy.

    The lookup side has one row per name (weights are grouped by name), so every payroll row
    keeps exactly one output row.
    """
    joined = rows.join(lookup, rows[name_col] == lookup["__name"], "left")
    if unmatched == UNMATCHED_KEEP:
        return joined.select(
            *[rows[c] for c in rows.columns], F.col("__m").alias("Male"), F.col("__f").alias("Female")
        )
    if unmatched == UNMATCHED_DROP:
        # Left join + not-null filter: Catalyst turns this into an inner join.
        return joined.where(F.col("__m").isNotNull() & F.col("__f").isNotNull()).select(
            *[rows[c] for c in rows.columns],
            F.col("__m").alias("Male"),
            F.col("__f").alias("Female"),
        )
    if unmatched == UNMATCHED_ZERO:
        matched = F.col("__m").isNotNull()
        return joined.select(
            *[rows[c] for c in rows.columns],
            F.coalesce(F.col("__m"), F.lit(0.0)).alias("Male"),
            F.coalesce(F.col("__f"), F.lit(0.0)).alias("Female"),
            F.when(matched, F.lit(1)).otherwise(F.lit(0)).alias("Common"),
            F.when(matched, F.lit(0)).otherwise(F.lit(1)).alias("Uncommon"),
        )
    raise ValueError(f"unknown unmatched policy {unmatched!r}")


def hot_names(rows: DataFrame, name_col: str = "first_name", tasks: int | None = None) -> list[str]:
    """Names with more rows than a task of the name shuffle gets on average; at most as many as tasks.

    One aggregate with partial counts, of the name column alone.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("__name")).agg(F.count("*").alias("__n"))
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = counts.agg(F.sum("__n")).first()[0] or 0
        return [r["__name"] for r in counts.where(F.col("__n") * tasks > total).collect()]
    finally:
        counts.unpersist(blocking=False)


def join_weights_split(rows: DataFrame, lookup: DataFrame, unmatched: str, name_col: str, hot: Sequence[str]) -> DataFrame:
    """:func:`join_weights` with a lookup side too large to broadcast, without moving rows of hot or NULL names.

    Rows with a NULL name can match nothing and rows with a hot name only the few weights of such
    names: both stay where they are and are joined with those weights, which are broadcast (at most
    one row per hot name). Only the other rows are shuffled on the name, and no name of theirs is
    more than an average task. The rows of NULL names are not read where unmatched ones are dropped.
    """
    name, is_hot = rows[name_col], F.lit(False)
    few = lookup.where(F.lit(False))
    if hot:
        is_hot = name.isin(list(hot))
        few = lookup.where(F.col("__name").isin(list(hot)))
    moved = join_weights(rows.where(name.isNotNull() & ~is_hot), lookup.hint("shuffle_merge"), unmatched, name_col)
    stays = is_hot if unmatched == UNMATCHED_DROP else name.isNull() | is_hot
    if unmatched == UNMATCHED_DROP and not hot:
        return moved
    return moved.unionByName(join_weights(rows.where(stays), F.broadcast(few), unmatched, name_col))


def attach_weights(
    rows: DataFrame,
    weights: DataFrame,
    unmatched: str = UNMATCHED_DROP,
    max_broadcast_rows: int | None = 1_000_000,
    name_col: str = "first_name",
) -> DataFrame:
    """Look up each row's first name (exact, case-sensitive) and add ``Male``, ``Female``.

    ``unmatched='drop'`` keeps matched rows only; ``'zero'`` keeps every row, sets the weights of
    unmatched ones to 0 and adds ``Common`` (1 if matched) and ``Uncommon`` (1 - Common).

    The weights table is broadcast when its row count is at most ``max_broadcast_rows``. Otherwise
    the names are counted first: hot and NULL names stay where they are and the other rows are
    shuffled on the name (:func:`join_weights_split`). A NULL first name never matches.
    """
    lookup, small = weight_lookup(weights, max_broadcast_rows)
    if small or rows.isStreaming:
        return join_weights(rows, lookup, unmatched, name_col)
    return join_weights_split(rows, lookup, unmatched, name_col, hot_names(rows, name_col))
