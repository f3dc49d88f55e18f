"""Adapter from the generated star-schema test tables to the canonical inputs.

Mapping (fixed by the test-data description):

* payroll rows  = lineitem joined to part, supplier and the supplier's nation
* fiscal_year   = year(l_shipdate); agency = p_type; title = p_brand; first_name = n_name
* pay_basis     = 'per Annum' where l_returnflag = 'R'; leave_status = 'ACTIVE' where l_linestatus = 'F'
* base_salary   = l_extendedprice; total_ot_paid = l_quantity * l_discount
* name rows     = customers of BUILDING (sex F) and MACHINERY (sex M) outside region ASIA,
                  state = region name, name = nation name, year 0, count 1
* price index   = avg(o_totalprice) per year and month of o_orderdate
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import exact
from .files import MONTH_NAMES


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Declared schemas of the columns the adapter reads (types as written by the generator). With a
# declared schema Spark neither runs a schema-inference job per read nor reads other columns.
STAR_SCHEMAS = {
    "lineitem": _schema(
        ("l_partkey", T.LongType()), ("l_suppkey", T.LongType()), ("l_quantity", T.DoubleType()),
        ("l_extendedprice", T.DoubleType()), ("l_discount", T.DoubleType()), ("l_returnflag", T.StringType()),
        ("l_linestatus", T.StringType()), ("l_shipdate", T.TimestampNTZType()),
    ),
    "part": _schema(("p_partkey", T.LongType()), ("p_brand", T.StringType()), ("p_type", T.StringType())),
    "supplier": _schema(("s_suppkey", T.LongType()), ("s_nationkey", T.IntegerType())),
    "nation": _schema(("n_nationkey", T.IntegerType()), ("n_name", T.StringType()), ("n_regionkey", T.IntegerType())),
    "region": _schema(("r_regionkey", T.IntegerType()), ("r_name", T.StringType())),
    "customer": _schema(("c_nationkey", T.IntegerType()), ("c_mktsegment", T.StringType())),
    "orders": _schema(("o_totalprice", T.DoubleType()), ("o_orderdate", T.TimestampNTZType())),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(year: int):
    return F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def payroll(
    spark: SparkSession,
    sf_dir: str,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Canonical payroll rows built from lineitem, part, supplier and nation.

    With ``years`` the ship-date range of those years is filtered in the lineitem scan (a range
    on the timestamp reaches the Parquet reader; ``year(ts) IN (...)`` would not). The flag
    columns are mapped to the canonical texts; the eligibility filter on them runs right above
    the scan, before any join.
    """
    li = _table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    if years:
        li = li.where((F.col("l_shipdate") >= _ts(min(years))) & (F.col("l_shipdate") < _ts(max(years) + 1)))
    # Each dimension joins the fact side directly, so the planner's size check (file sizes
    # against spark.sql.autoBroadcastJoinThreshold, re-checked at run time by AQE) decides
    # broadcast vs shuffle per table; at full scale part and supplier are shuffle-joined.
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    supp = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
        .join(nation, supp.s_nationkey == nation.n_nationkey)
    )
    return rows.select(
        F.year("l_shipdate").cast("int").alias("fiscal_year"),
        F.col("p_type").alias("agency"),
        F.col("p_brand").alias("title"),
        F.col("n_name").alias("first_name"),
        F.when(F.col("l_returnflag") == "R", F.lit("per Annum")).otherwise(F.col("l_returnflag")).alias("pay_basis"),
        F.when(F.col("l_linestatus") == "F", F.lit("ACTIVE")).otherwise(F.col("l_linestatus")).alias("leave_status"),
        F.col("l_extendedprice").alias("base_salary"),
        (F.col("l_quantity") * F.col("l_discount")).alias("total_ot_paid"),
    )


def names(spark: SparkSession, sf_dir: str, by_segment: bool = False) -> DataFrame:
    """Name-registration rows (``state, sex, year, name, count``) from customer, nation, region.

    ``by_segment`` adds the market segment to the name, so that each is registered for one sex only.
    """
    cust = _table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = (
        cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    # Registrations are written in lower case; those of one region under another spelling, so
    # that payroll names without a registration come from the data.
    name = F.when(F.col("r_name") == "ASIA", F.concat(F.lit("de "), F.lower("n_name"))).otherwise(F.lower("n_name"))
    if by_segment:
        name = F.concat(name, F.lit(" "), F.lower("c_mktsegment"))
    return rows.select(
        F.col("r_name").alias("state"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), F.lit("F")).otherwise(F.lit("M")).alias("sex"),
        F.lit(0).alias("year"),
        name.alias("name"),
        F.lit(1).cast("long").alias("count"),
    )


def cpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical price index ``year, month, value``: average order price per month.

    A filter on ``month`` or ``year`` reaches the orders scan as ``month(o_orderdate) = m``.
    """
    return _monthly_index(spark, sf_dir)


def _monthly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    # Average price per month, summed exactly so the index does not depend on how
    # the orders are partitioned.
    return (
        orders.groupBy(
            F.year("o_orderdate").cast("int").alias("year"),
            F.month("o_orderdate").cast("int").alias("month"),
        )
        .agg(F.sum(exact(F.col("o_totalprice"))).alias("total"), F.count("*").alias("n"))
        .select("year", "month", (F.col("total").cast("double") / F.col("n")).alias("value"))
    )


def cpi_month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price index in the first published style: ``year, periodName (month name), value``."""
    names_map = F.create_map(*[x for i, m in enumerate(MONTH_NAMES) for x in (F.lit(i + 1), F.lit(m))])
    return _monthly_index(spark, sf_dir).select("year", names_map[F.col("month")].alias("periodName"), "value")


def cpi_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price index in the second published style: ``period ('YYYY-MM'), value``."""
    return _monthly_index(spark, sf_dir).select(
        F.format_string("%04d-%02d", F.col("year"), F.col("month")).alias("period"), "value"
    )
