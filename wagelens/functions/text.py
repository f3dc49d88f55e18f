"""Display texts for reports: percent and dollar strings.

Formatting happens only at the end, on report rows (one row per key and year), never on facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the largest column maximum (in absolute dollars) that is still shown with cents.
LARGEST_WITH_CENTS = 100_000


def percent_text(ratio: Column) -> Column:
    """Ratio -> percent text with one decimal: 0.018 -> '1.8%', -0.045 -> '-4.5%'.

    Rounded (half to even) before the sign is looked at, so a small negative prints as '0.0%'.
    Adding 0.0 turns a negative zero into a positive one. NULL stays NULL.
    """
    rounded = F.bround(ratio * F.lit(100.0), 1) + F.lit(0.0)
    return F.concat(F.format_number(rounded, 1), F.lit("%"))


def dollar_text(amount: Column, with_cents: Column) -> Column:
    """Amount -> '$4,212.81' (cents) or '$20,090,898' (whole dollars); negatives get '-$'.

    The sign comes from the unrounded amount, so -0.0003 prints as '-$0.00'. NULL stays NULL.
    """
    magnitude = F.when(with_cents, F.format_number(F.abs(amount), 2)).otherwise(F.format_number(F.abs(amount), 0))
    sign = F.when(amount < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.when(amount.isNotNull(), F.concat(sign, magnitude))


def needs_cents(max_abs: Column, any_fraction: Column) -> Column:
    """Whole-column rule: cents unless the column's largest magnitude exceeds the limit or every
    value is a whole number (an all-NULL column has no cents either)."""
    return F.coalesce(max_abs.isNotNull() & (max_abs <= F.lit(LARGEST_WITH_CENTS)) & any_fraction, F.lit(False))


def with_dollar_texts(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Replace each column in ``columns`` by its dollar text, choosing cents per column and per
    group of ``by`` (e.g. per fiscal year: every year is its own column in a wide report).

    The per-group statistics are a partial-then-final aggregate with one row per group; they are
    joined back by broadcast, which is safe because there is one row per group of ``by``.
    """
    aggs = []
    for c in columns:
        aggs.append(F.max(F.abs(F.col(c))).alias(f"__max_{c}"))
        aggs.append(F.max(F.col(c) != F.floor(F.col(c))).alias(f"__frac_{c}"))
    stats = df.groupBy(*by).agg(*aggs)
    joined = df.join(F.broadcast(stats), on=list(by), how="left")
    texts = {
        c: dollar_text(F.col(c), needs_cents(F.col(f"__max_{c}"), F.coalesce(F.col(f"__frac_{c}"), F.lit(False))))
        for c in columns
    }
    return joined.select(*[texts.get(c, F.col(c)).alias(c) for c in df.columns])
