"""Declared schemas of the inputs and of the long report format.

Sources are read with these schemas (no inference: inference costs an extra pass and a column
holding only ``F`` would come out boolean).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical payroll: the eight columns the reports read. Source files have more columns; they
# are never read (column pruning keeps them out of the scan).
PAYROLL = T.StructType(
    [
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("agency", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("pay_basis", T.StringType()),
        T.StructField("leave_status", T.StringType()),
        T.StructField("base_salary", T.DoubleType()),
        T.StructField("total_ot_paid", T.DoubleType()),
    ]
)
PAYROLL_COLUMNS = [f.name for f in PAYROLL.fields]

# Name registrations, one file per state, no header: state, sex, year, name, count.
NAMES = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

# Price index, style 1: year, month name, value.
CPI_MONTH_NAME = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("periodName", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Price index, style 2: "YYYY-MM" period text and the value, taken by position (the value's
# header in the published file is long and badly encoded, so it is never used).
CPI_PERIOD = T.StructType(
    [
        T.StructField("period", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

# Canonical price index after parsing either style.
CPI = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
