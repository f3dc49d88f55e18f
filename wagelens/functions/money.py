"""Money expressions: exact amounts, restatement in base-year dollars, gap ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(amount: Column) -> Column:
    """Dollar amount as a decimal with ten places; NaN is a missing amount.

    Money is summed as decimals: such sums are exact and associative, so a total does not depend
    on how rows are split into partitions or in which order tasks finish, and fractions of a cent
    count in full.
    """
    return F.nanvl(amount.cast("double"), F.lit(None).cast("double")).cast("decimal(28,10)")


def restate(amount: Column, year_value: Column, base_value: Column) -> Column:
    """Amount of one year in the base year's money: ``(x / index_of_year) * index_of_base``."""
    return (amount / year_value) * base_value


def gap(first: Column, second: Column) -> Column:
    """``(first - second) / (first + second)``; NULL where the denominator is 0.

    Positive means the first group (men, common names) is paid more. The denominator is the
    sum of both, not the first value.
    """
    return F.try_divide(first - second, first + second)
