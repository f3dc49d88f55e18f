"""Aggregates: means, sums, weighted means with R's NULL rules, and the measure cube.

NULL rule (strict): the published scripts call ``mean``/``sum``/``weighted.mean`` without dropping missing
values, so one missing amount in a group makes that group's result missing. Every aggregate
here carries the counts needed to apply that rule after the fact. The lenient rule (R's
``na.rm = TRUE``) leaves missing amounts out, with their weights: the cube holds the weight sums of
all rows and of the rows with an amount, so both rules read the same cube.

Money is summed as decimals (exact, fractions of a cent included); weighted sums are doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import exact
from .names import UNMATCHED_DROP, UNMATCHED_ZERO, join_weights, weight_lookup

CUBE_KEYS = ["fiscal_year", "agency", "title"]

# Additive measures of the cube; every report measure is a ratio or a sum of these.
CUBE_MEASURES = [
    "n", "n_salary", "salary_sum", "n_ot", "ot_sum",
    "w_m", "xw_m", "bad_m", "w_f", "xw_f", "bad_f",
    "w_c", "xw_c", "bad_c", "w_u", "xw_u", "bad_u", "wv_m", "wv_f",
]


# ---------------------------------------------------------------------------------------------
# Report-level formulas over summed measures


def mean_from_sums(total: Column, n_valid: Column, n_all: Column, strict: bool = True) -> Column:
    """Mean from a sum; NULL if any amount in the group was missing (``strict``), or else if all were."""
    if not strict:
        return F.when(n_valid > 0, total.cast("double") / n_valid.cast("double"))
    return F.when(n_valid == n_all, total.cast("double") / n_all.cast("double"))


def total_from_sums(total: Column, n_valid: Column, n_all: Column, strict: bool = True) -> Column:
    """Total from a sum; NULL if any amount in the group was missing (``strict``); otherwise of those present, 0 for none."""
    if not strict:
        return F.coalesce(total.cast("double"), F.lit(0.0))
    return F.when(n_valid == n_all, total.cast("double"))


def weighted_from_sums(sum_xw: Column, sum_w: Column, n_bad: Column) -> Column:
    """``sum(x*w) / sum(w)``.

    NULL if a missing amount carried a non-zero weight (rows with weight 0 are left out of the
    numerator, as R's ``weighted.mean`` does), or if the weights sum to 0.
    """
    return F.when(n_bad == 0, F.try_divide(sum_xw.cast("double"), sum_w.cast("double")))


# ---------------------------------------------------------------------------------------------
# Plain group operators over row-level data (A3, A4, A5)


def group_mean(df: DataFrame, keys: Sequence[str], amount: str, alias: str = "mean") -> DataFrame:
    """Mean of a money column per group of ``keys`` (NULL if any amount is missing)."""
    return df.groupBy(*keys).agg(
        F.sum(exact(F.col(amount))).alias("__s"), F.count(exact(F.col(amount))).alias("__v"), F.count("*").alias("__n")
    ).select(*keys, mean_from_sums(F.col("__s"), F.col("__v"), F.col("__n")).alias(alias))


def group_sum(df: DataFrame, keys: Sequence[str], amount: str, alias: str = "total") -> DataFrame:
    """Sum of a money column per group of ``keys`` (NULL if any amount is missing)."""
    return df.groupBy(*keys).agg(
        F.sum(exact(F.col(amount))).alias("__s"), F.count(exact(F.col(amount))).alias("__v"), F.count("*").alias("__n")
    ).select(*keys, total_from_sums(F.col("__s"), F.col("__v"), F.col("__n")).alias(alias))


def weighted_mean(df: DataFrame, keys: Sequence[str], amount: str, weight: str, alias: str = "weighted_mean") -> DataFrame:
    """Weighted mean of a money column per group (R's ``weighted.mean`` without ``na.rm``)."""
    w = F.col(weight)
    x = F.nanvl(F.col(amount).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(
        F.sum(F.when(w != 0, w * x)).alias("__xw"),
        F.sum(w).alias("__w"),
        F.sum(F.when((w != 0) & x.isNull(), 1).otherwise(0)).alias("__bad"),
        (F.count("*") - F.count(weight)).alias("__wnull"),
    ).select(
        *keys,
        F.when(F.col("__wnull") == 0, weighted_from_sums(F.col("__xw"), F.col("__w"), F.col("__bad"))).alias(alias),
    )


# ---------------------------------------------------------------------------------------------
# The measure cube


def _row_measures(rows: DataFrame, pre_aggregate: bool) -> DataFrame:
    """Per-row (or per first name, when ``pre_aggregate``) counts and money sums."""
    sal, ot = exact(F.col("base_salary")), exact(F.col("total_ot_paid"))
    if pre_aggregate:
        return rows.groupBy(*CUBE_KEYS, "first_name").agg(
            F.count("*").alias("n"),
            F.count(sal).alias("n_salary"),
            F.sum(sal).alias("salary_sum"),
            F.count(ot).alias("n_ot"),
            F.sum(ot).alias("ot_sum"),
        )
    return rows.select(
        *CUBE_KEYS,
        "first_name",
        F.lit(1).cast("long").alias("n"),
        sal.isNotNull().cast("long").alias("n_salary"),
        sal.alias("salary_sum"),
        ot.isNotNull().cast("long").alias("n_ot"),
        ot.alias("ot_sum"),
    )


def _weighted_contributions(df: DataFrame, has_flags: bool) -> DataFrame:
    """Weight-times-measure columns of one row (or one pre-aggregated name group)."""
    n, nv, s = F.col("n"), F.col("n_salary"), F.col("salary_sum")
    cols = [F.col(c) for c in CUBE_KEYS] + [n, nv, s, F.col("n_ot"), F.col("ot_sum")]
    for tag, w in (("m", F.col("Male")), ("f", F.col("Female"))):
        cols += [
            (w * n).alias(f"w_{tag}"),
            F.when(w != 0, w * s.cast("double")).otherwise(F.lit(0.0)).alias(f"xw_{tag}"),
            F.when(w != 0, n - nv).otherwise(F.lit(0)).alias(f"bad_{tag}"),
            (w * nv).alias(f"wv_{tag}"),
        ]
    common = F.col("Common").cast("long") if has_flags else F.lit(1).cast("long")
    uncommon = F.col("Uncommon").cast("long") if has_flags else F.lit(0).cast("long")
    for tag, w in (("c", common), ("u", uncommon)):
        cols += [
            (w * n).alias(f"w_{tag}"),
            F.when(s.isNotNull(), F.when(w == 1, s).otherwise(F.lit(0))).alias(f"xw_{tag}"),
            (w * (n - nv)).alias(f"bad_{tag}"),
        ]
    return df.select(*cols)


def cube_contributions(eligible_rows: DataFrame, lookup: DataFrame, is_broadcast: bool, unmatched: str) -> DataFrame:
    """Rows (or per-name sums) carrying every additive cube measure, before the final sum.

    Works on batch and streaming inputs alike when ``is_broadcast`` (no aggregation happens
    before the final one).
    """
    measures = _row_measures(eligible_rows, pre_aggregate=not is_broadcast)
    enriched = join_weights(measures, lookup, unmatched)
    return _weighted_contributions(enriched, unmatched != UNMATCHED_DROP)


def sum_cube(contributions: DataFrame) -> DataFrame:
    """Final sum of :func:`cube_contributions` per (fiscal_year, agency, title)."""
    return contributions.groupBy(*CUBE_KEYS).agg(*[F.sum(c).alias(c) for c in CUBE_MEASURES])


def measure_cube(
    eligible_rows: DataFrame,
    weights: DataFrame,
    unmatched: str = UNMATCHED_DROP,
    max_broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One aggregate of the eligible payroll at (fiscal_year, agency, title) with additive measures.

    * weights table small enough (row count checked): it is broadcast, every fact row picks up
      its weights in the scan stage, and the cube is one partial -> shuffle -> final aggregate.
    * otherwise: the facts are first summed per (year, agency, title, first name) -- map-side
      partial sums, so a very common name is one row per task, not millions -- and only those
      sums are joined to the weights by a shuffle join, then summed again to the cube.

    Either way the facts are scanned once and shuffled once, after partial aggregation.
    """
    if unmatched not in (UNMATCHED_DROP, UNMATCHED_ZERO):
        raise ValueError(f"the cube needs unmatched='drop' or 'zero', not {unmatched!r}")
    lookup, is_broadcast = weight_lookup(weights, max_broadcast_rows)
    return sum_cube(cube_contributions(eligible_rows, lookup, is_broadcast, unmatched))


def rollup(
    source: DataFrame,
    key: str,
    min_group_size: int | None = None,
    city_scope: str = "all",
    city_label: str | None = None,
) -> DataFrame:
    """Report rows per (fiscal_year, key) plus one citywide row per year.

    ``source`` is the cube, or any frame with the cube's additive measures per row (e.g. the
    contributions before the cube's final sum) -- the sums are the same.

    ``min_group_size``: keep keys with more than that many rows in the year (strict ``>``).
    ``city_scope='all'``: the citywide row counts every row, before the threshold (as the
    published code does) -- per-key and citywide rows are then one GROUPING SETS aggregate,
    one shuffle; ``'kept'``: only rows of the keys that pass it (a second, tiny aggregate).

    Output: ``fiscal_year, key, is_citywide, <summed measures>``; ``key`` holds ``city_label``
    on citywide rows. The citywide row is told apart by ``grouping_id()``, never by the key.
    """
    sums = [F.sum(c).alias(c) for c in CUBE_MEASURES]
    if city_scope == "all":
        grouped = source.groupingSets([["fiscal_year", key], ["fiscal_year"]], "fiscal_year", key).agg(
            *sums, F.grouping_id().alias("__gid")
        )
        is_city = F.col("__gid") != 0
        out = grouped.select(
            "fiscal_year",
            F.when(is_city, F.lit(city_label).cast("string")).otherwise(F.col(key)).alias("key"),
            is_city.alias("is_citywide"),
            *CUBE_MEASURES,
        )
        if min_group_size is not None:
            out = out.where(F.col("is_citywide") | (F.col("n") > min_group_size))
        return out
    if city_scope != "kept":
        raise ValueError(f"unknown city_scope {city_scope!r}")
    per_key = source.groupBy("fiscal_year", F.col(key).alias("key")).agg(*sums)
    kept = per_key if min_group_size is None else per_key.where(F.col("n") > min_group_size)
    city = kept.groupBy("fiscal_year").agg(*sums).select(
        "fiscal_year", F.lit(city_label).cast("string").alias("key"), *CUBE_MEASURES
    )
    return kept.withColumn("is_citywide", F.lit(False)).unionByName(city.withColumn("is_citywide", F.lit(True)))
