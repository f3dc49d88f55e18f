"""Price-index lookup and restatement in base-year money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import restate


def index_values(cpi: DataFrame, years: Sequence[int], month: int, base_year: int) -> DataFrame:
    """``fiscal_year, year_value, base_value``: the index of ``month`` in each year and in the base year.

    Exactly one index row per (year, month) is required; the job fails with a clear message if
    a needed year has no such row or has several (as the published scripts' scalar lookup would).
    The result has one row per requested year, so it is safe to broadcast.
    """
    spark = cpi.sparkSession
    # One row per (fiscal year, role): the year itself and the base year. Built JVM-side from
    # the parameter list, so the join below is an equi-join on a real column.
    pairs = []
    for y in years:
        pairs.append(F.struct(F.lit(int(y)).alias("fiscal_year"), F.lit("year").alias("role"), F.lit(int(y)).alias("year")))
        pairs.append(F.struct(F.lit(int(y)).alias("fiscal_year"), F.lit("base").alias("role"), F.lit(int(base_year)).alias("year")))
    wanted = spark.range(1).select(F.inline(F.array(*pairs)))
    needed = sorted({int(y) for y in years} | {int(base_year)})
    rows = cpi.where((F.col("month") == month) & F.col("year").isin(needed)).select("year", "value")
    # The request table is the broadcast side (two rows per requested year, a proven bound);
    # index rows stream through it. Requests without an index row come back through the
    # union, so one aggregate per fiscal year sees both "no row" and "several rows".
    found = rows.join(F.broadcast(wanted), on="year").select("fiscal_year", "role", "year", "value", F.lit(1).alias("hit"))
    asked = wanted.select("fiscal_year", "role", "year", F.lit(None).cast("double").alias("value"), F.lit(0).alias("hit"))
    by_year = found.unionByName(asked).groupBy("fiscal_year").agg(
        *[
            agg
            for role in ("year", "base")
            for agg in (
                F.max(F.when(F.col("role") == role, F.col("year"))).alias(f"{role}_year"),
                F.sum(F.when(F.col("role") == role, F.col("hit"))).alias(f"{role}_rows"),
                F.max(F.when((F.col("role") == role) & (F.col("hit") == 1), F.col("value"))).alias(f"{role}_value"),
            )
        ]
    )

    def _checked(role: str):
        # All checks sit in this one projection, so a bad index fails with one clear message.
        rows, year = F.col(f"{role}_rows"), F.col(f"{role}_year")
        return (
            F.when(rows == 0, F.raise_error(F.format_string(f"price index has no row for year %d, month {month}", year)))
            .when(rows > 1, F.raise_error(F.format_string(f"price index has %d rows for year %d, month {month}", rows, year)))
            .otherwise(F.col(f"{role}_value"))
        )

    return by_year.select(
        F.col("fiscal_year"),
        _checked("year").cast("double").alias("year_value"),
        _checked("base").cast("double").alias("base_value"),
    )


def restate_columns(df: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Restate money ``columns`` of ``df`` (which has ``fiscal_year``) in the base year's money.

    ``index`` is the output of :func:`index_values` -- one row per year, broadcast.
    """
    joined = df.join(F.broadcast(index), on="fiscal_year", how="left")
    restated = {c: restate(F.col(c), F.col("year_value"), F.col("base_value")) for c in columns}
    return joined.select(*[restated.get(c, F.col(c)).alias(c) for c in df.columns])
