"""File sources: payroll, name registrations and the price index, as CSV or Parquet.

No read infers a schema (no extra pass over the data): headerless files get a declared schema,
files with a header are read as text and only the used columns are cast. Malformed rows fail
the job (``FAILFAST``); ``NA`` is the missing-value text.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.joins import bounded_broadcast

# Header names of the published payroll file and the canonical names they map to.
PAYROLL_SOURCE_NAMES = {
    "Fiscal Year": "fiscal_year",
    "Agency Name": "agency",
    "Title Description": "title",
    "First Name": "first_name",
    "Pay Basis": "pay_basis",
    "Leave Status as of June 30": "leave_status",
    "Base Salary": "base_salary",
    "Total OT Paid": "total_ot_paid",
}

# English month names, January first, for price-index files that name the month.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def read_payroll(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv") -> DataFrame:
    """Payroll rows with the canonical column names.

    CSV files carry the published header; only the eight used columns are kept, cast to the
    canonical types. Parquet input is expected to use the canonical names already.
    """
    if fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
        return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PAYROLL.fields])
    # Text as it stands (an empty field is an empty text, not a missing one); a file whose header
    # differs from the first file's fails instead of landing in wrong columns.
    raw = spark.read.csv(
        path, header=True, nullValue=NO_TEXT, mode="FAILFAST", inferSchema=False, enforceSchema=False, escape='"'
    )
    cols = []
    for field in schemas.PAYROLL.fields:
        name = next((c for c in header_candidates(field.name) if c in raw.columns), None)
        if name is None:
            raise ValueError(f"payroll file has no column for {field.name!r} (tried {header_candidates(field.name)})")
        cols.append(_field(F.col(f"`{name}`"), field.dataType).alias(field.name))
    return raw.select(cols)


# Never a field's text, so that Spark turns no text into NULL by itself.
NO_TEXT = "\x00"


def _field(text: Column, kind) -> Column:
    """A CSV field: ``NA`` is missing; an empty field is a text of its own, but no number."""
    if kind.simpleString() == "string":
        return F.when(text == "NA", F.lit(None)).otherwise(F.coalesce(text, F.lit("")))
    return F.when((text != "NA") & (text != ""), text).cast(kind)


# Short names the published script gives two columns after reading.
R_RENAMES = {"agency": "Agency", "title": "Title"}


def header_candidates(canonical: str) -> list[str]:
    """Header spellings accepted for a canonical payroll column: the published header, the same
    with dots for spaces (as R writes it back), the script's short rename, and the canonical name."""
    published = {v: k for k, v in PAYROLL_SOURCE_NAMES.items()}[canonical]
    out = [published, published.replace(" ", "."), canonical]
    if canonical in R_RENAMES:
        out.insert(2, R_RENAMES[canonical])
    return out


# Lines of CSV files and the place they come from.
LINE_COLUMNS = ["line", "file", "block"]
MAX_LAYOUTS = 100  # different headers among the files of one read
MAX_FILES = 1_000_000  # files whose header is looked up, where headers differ


def with_places(lines: DataFrame) -> DataFrame:
    """Lines of a text source (batch or stream) with their file and the start of the block they were read in."""
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def are_lines(df: DataFrame) -> bool:
    return df.columns == LINE_COLUMNS


def _picked(row: Column, place: dict[str, int]) -> Column:
    """The wanted fields of a parsed line, which is computed once."""
    return F.get(F.transform(F.array(row), lambda r: F.struct(*[r[f"c{i}"].alias(c) for c, i in place.items()])), F.lit(0))


def fields_by_header(lines: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Text columns named as the keys of ``wanted`` from CSV lines (``with_places``), each file read by its own header.

    The header is a file's first line; a field goes to the column whose accepted names (``wanted``)
    hold its header, wherever it stands. A file that lacks a wanted column, or has it twice, is an error,
    as is a line with more or fewer fields than its header. Empty lines and repeated headers are
    passed over, an empty field is NULL. Fields may be quoted but not hold line breaks, as lines are
    read apart. Files with one common header are read without any join; otherwise the layout of
    each file is broadcast, one row a file.
    """
    first = lines.where(F.col("block") == 0).select("file", "line", F.monotonically_increasing_id().alias("at"))
    first = first.groupBy("file").agg(F.min_by("line", "at").alias("header"))
    headers = [r.header for r in first.select("header").distinct().limit(MAX_LAYOUTS + 1).collect()]
    if len(headers) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers in the files of one read")
    if not headers:
        return lines.select(*[F.lit(None).cast("string").alias(c) for c in wanted]).where(F.lit(False))
    parsed, headers = None, sorted(headers)
    for k, header in enumerate(headers):
        names = next(csv.reader([header.lstrip("\ufeff")]), [])
        place = {}
        for field, accepted in wanted.items():
            found = [i for i, name in enumerate(names) if name in accepted]
            if len(found) != 1:
                raise ValueError(f"{'no column' if not found else 'more than one column'} for {field!r} (of {list(accepted)}) in the header {header!r}")
            place[field] = found[0]
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        row = F.from_csv("line", schema, {"mode": "FAILFAST", "nullValue": NO_TEXT, "escape": '"'})
        row = _picked(row, place)
        parsed = F.when(F.col("layout") == k, row) if parsed is None else parsed.when(F.col("layout") == k, row)
    if len(headers) == 1:
        rows = lines.withColumn("layout", F.lit(0))
    else:
        layouts = lines.sparkSession.createDataFrame(list(enumerate(headers)), "layout int, header string")
        of_file = bounded_broadcast(first.join(F.broadcast(layouts), "header").select(F.col("file").alias("__file"), "layout"), MAX_FILES)
        if of_file is None:
            raise ValueError(f"more than {MAX_FILES} files with different headers in one read")
        rows = lines.join(of_file, F.col("file") == F.col("__file"))
    head = F.element_at(F.lit(headers), F.col("layout") + 1)
    rows = rows.where(~((F.col("block") == 0) & (F.col("line") == head)) & (F.trim("line") != ""))
    return rows.select(parsed.alias("p")).select("p.*")


def payroll_from_lines(lines: DataFrame) -> DataFrame:
    """Canonical payroll rows from lines of CSV files, each read by its own header."""
    text = fields_by_header(lines, {f.name: header_candidates(f.name) for f in schemas.PAYROLL.fields})
    return text.select([_field(F.col(f.name), f.dataType).alias(f.name) for f in schemas.PAYROLL.fields])


def read_names(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Headerless name-registration files ``state,sex,year,name,count``.

    A whole folder of per-state files is one glob path; each file becomes splits of its own.
    """
    return spark.read.schema(schemas.NAMES).csv(path, header=False, mode="FAILFAST")


def month_number(month_name: Column) -> Column:
    """Month name (``June``) to its number, NULL for anything else."""
    mapping = F.create_map(*[x for i, m in enumerate(MONTH_NAMES) for x in (F.lit(m), F.lit(i + 1))])
    return mapping[month_name]


def cpi_from_month_names(df: DataFrame) -> DataFrame:
    """``year, periodName, value`` -> canonical ``year, month, value`` (S3)."""
    return df.select(
        F.col("year").cast("int").alias("year"),
        month_number(F.col("periodName")).cast("int").alias("month"),
        F.col("value").cast("double").alias("value"),
    )


def cpi_from_periods(df: DataFrame) -> DataFrame:
    """``period ('YYYY-MM'), value`` -> canonical ``year, month, value``.

    The text is split on ``-``; both parts become numbers, and a part that is not a number
    becomes NULL (as R's ``as.numeric`` does) instead of failing the job.
    """
    return df.select(
        F.split_part(F.col("period"), F.lit("-"), F.lit(1)).try_cast("int").alias("year"),
        F.split_part(F.col("period"), F.lit("-"), F.lit(2)).try_cast("int").alias("month"),
        F.col("value").cast("double").alias("value"),
    )


def read_cpi(spark: SparkSession, path: str, style: str = "period") -> DataFrame:
    """Read a price-index CSV in either published style and return ``year, month, value``."""
    if style == "month_name":
        # Columns by each file's own header (such files carry more columns: period code, footnotes,
        # ..., and not always in one order); no inference, and the three that are used are cast.
        raw = fields_by_header(with_places(spark.read.text(path)), {c: [c] for c in ("year", "periodName", "value")})
        number = lambda c: F.when(~F.col(c).isin("", "NA"), F.col(c)).alias(c)
        return cpi_from_month_names(raw.select(number("year"), "periodName", number("value")))
    if style == "period":
        # Columns by position: the header of the value column is never looked at.
        raw = spark.read.schema(schemas.CPI_PERIOD).csv(
            path, header=True, mode="FAILFAST", enforceSchema=True
        )
        return cpi_from_periods(raw)
    raise ValueError(f"unknown price-index style {style!r}")


def store_payroll(payroll: DataFrame, path: str) -> None:
    """Write canonical payroll rows as Parquet partitioned by ``fiscal_year``.

    Later reads filtered on fiscal years (the eligibility filter) skip whole year folders
    (partition pruning) instead of reading every file; the other filters reach the Parquet
    reader as pushed filters. Rows are dealt by ranges of (year, agency, title, a hash of the row) and sorted, so a file
    covers a narrow range of cube keys and a scan task's partial aggregate emits few rows; the
    hash splits a key that has a large share of the rows over several ranges.
    """
    spread = F.xxhash64(*[F.col(c) for c in payroll.columns])
    order = ["fiscal_year", "agency", "title", "__spread"]
    (
        payroll.withColumn("__spread", spread)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("__spread")
        .write.mode("overwrite")
        .partitionBy("fiscal_year")
        .parquet(path)
    )


def read_stored_payroll(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`store_payroll` (declared schema, no inference pass)."""
    return spark.read.schema(schemas.PAYROLL).parquet(path).select(*schemas.PAYROLL_COLUMNS)
