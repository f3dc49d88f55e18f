"""Reshaping report rows: years side by side (J3, P3), distinct keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(
    long: DataFrame,
    key: str,
    measures: Sequence[str],
    years: Sequence[int],
    key_name: str,
    extra_keys: Sequence[str] = ("is_citywide",),
) -> DataFrame:
    """One row per key, columns ``<measure>_<year>`` for every year (year-major order).

    This is the whole chain of per-year full outer merges in one aggregate: a key missing in a
    year gets NULL in all of that year's columns. Pivot values are given (no extra job), and
    ``extra_keys`` (the citywide flag) keep a real key from merging with the citywide row. The
    input has one row per (key, year); a second one is an error.
    """
    group = [F.col(key).alias(key_name), *[F.col(k) for k in extra_keys]]
    twice = F.raise_error(F.lit(f"more than one row for a {key} and year"))
    aggs = [F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first(F.col(m))).alias(m) for m in measures]
    wide = long.groupBy(*group).pivot("fiscal_year", list(years)).agg(*aggs)
    if len(measures) == 1:
        # Spark names single-aggregate pivot columns by the value alone.
        renames = {str(y): f"{measures[0]}_{y}" for y in years}
    else:
        renames = {f"{y}_{m}": f"{m}_{y}" for y in years for m in measures}
    wide = wide.withColumnsRenamed(renames)
    ordered = [key_name] + [f"{m}_{y}" for y in years for m in measures]
    return wide.select(*ordered, *extra_keys)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct values of one column (NULL is one value)."""
    return df.select(key).distinct()
