"""Row filters: eligibility (F1) and the group-size threshold in both forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import bounded_broadcast

# The pay basis and leave status of employees the reports count.
ANNUAL_BASIS = "per Annum"
ACTIVE_STATUS = "ACTIVE"


def eligible(
    payroll: DataFrame,
    years: Sequence[int],
    pay_basis: str = ANNUAL_BASIS,
    leave_status: str = ACTIVE_STATUS,
) -> DataFrame:
    """Annual-salaried, active employees of the given fiscal years (NULL in any test drops the row)."""
    return payroll.where(
        F.col("fiscal_year").isin(list(years))
        & (F.col("pay_basis") == pay_basis)
        & (F.col("leave_status") == leave_status)
    )


def group_size_having(df: DataFrame, keys: Sequence[str], min_size: int) -> DataFrame:
    """Groups of ``keys`` with more than ``min_size`` rows, one row per group with its size ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > min_size)


def group_size_keep_rows(df: DataFrame, keys: Sequence[str], min_size: int, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Every row whose group of ``keys`` has more than ``min_size`` rows (rows kept whole).

    The group sizes are aggregated (partial counts map-side, one row per group) and joined back
    on the keys with NULL-safe equality, so a NULL key is a group like any other. The kept keys are
    broadcast where they are at most ``max_broadcast_rows`` (counted): the rows are then not
    shuffled. Beyond that they are, in a join whose hot keys Spark splits at run time.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > min_size)
    sizes = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(sizes[f"__k_{k}"])
        cond = c if cond is None else cond & c
    small = bounded_broadcast(sizes, max_broadcast_rows)
    return df.join(sizes if small is None else small, cond, "left_semi")

