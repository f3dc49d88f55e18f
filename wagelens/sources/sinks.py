"""Writers: CSV reports and Parquet tables (K1, K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

ROWS_PER_PART = 1_000_000  # of a sorted CSV export


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, ``NA`` for missing values, ``"`` as quote and escape.

    ``single_file`` coalesces to one partition: only for the small final reports (one row per
    agency or title), never for tables that grow with the payroll.
    """
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "NA")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, optionally partitioned (e.g. by ``fiscal_year`` so later reads prune years)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_sorted_parts(df: DataFrame, path: str, key: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """A table that may be large as CSV parts in the order of ``key``, and a manifest of their key ranges.

    Rows are dealt by ranges of the key (NULL first) and sorted inside, one task a part, so the parts
    in order of their names are the sorted table. ``<path>/_manifest`` has one row a part: its file,
    rows, first and last key (readers of the CSV folder pass over it).
    """
    parts = max(1, -(-df.count() // rows_per_part))
    order = F.col(key).asc_nulls_first()
    write_csv(df.repartitionByRange(parts, order).sortWithinPartitions(order), path)
    spark = df.sparkSession
    kind = next(f.dataType for f in df.schema.fields if f.name == key)
    written = spark.read.schema(df.schema).csv(path, header=True, nullValue="NA", escape='"', enforceSchema=False, mode="FAILFAST")
    ranges = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("rows"), F.min(key).cast(kind).alias("first_key"), F.max(key).cast(kind).alias("last_key")
    )
    ranges.coalesce(1).write.parquet(f"{path.rstrip('/')}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, first_key, last_key of each part of a sorted export."""
    return spark.read.parquet(f"{path.rstrip('/')}/_manifest")


def unsorted_parts(spark: SparkSession, path: str) -> list[str]:
    """Files of a sorted export whose keys do not all stand after those of the file before (none, if it is whole)."""
    parts = sorted(read_manifest(spark, path).collect(), key=lambda r: r.file)  # one row a part
    known = [r for r in parts if r.first_key is not None]
    return [b.file for a, b in zip(known[:-1], known[1:], strict=True) if not a.last_key < b.first_key]


def published_reports(spark: SparkSession, out_dir: str) -> str:
    """The folder of the current reports of a folder written with ``publish=True``."""
    return versions.current_path(spark, out_dir)


def write_reports(
    reports: dict, out_dir: str, city_label: str, parallelism: int = 8, fmt: str = "csv", publish: bool = False, rows_per_part: int = ROWS_PER_PART
) -> list[str]:
    """Write every report as one CSV file per report folder ``<out_dir>/<name>.csv/``.

    Reports have one row per agency or title, so each is written as a single file; rows are
    ordered by key with the citywide row last. The name weights, which grow with the names, are
    written as sorted parts with a manifest, and kept as Parquet too.
    With ``fmt='parquet'`` each report is one Parquet file per folder instead (typed columns).
    Reports are DataFrames or builders of them (see ``ReportSuite.report_builders``); up to
    ``parallelism`` reports are built and written at once.

    ``publish``: all reports are written to a new version of ``out_dir`` which becomes current when
    the last one is written; readers take ``published_reports(spark, out_dir)`` and see the reports
    before or after a rewrite, never some of each or a half-written one.
    """
    from ..plans.reports import run_reports

    def write_one(name: str, df: DataFrame, folder: str) -> str:
        path = f"{folder.rstrip('/')}/{name}.{fmt}"
        if name == "baby_names":
            # Header as in the published export: Name, F, M, M_weight, F_weight.
            df = df.withColumnRenamed("name", "Name")
            if fmt == "csv":
                write_sorted_parts(df, path, "Name", rows_per_part)
                write_parquet(df, f"{folder.rstrip('/')}/{name}.parquet")
            else:
                df.repartitionByRange(F.col("Name").asc_nulls_first()).sortWithinPartitions("Name").write.mode("overwrite").parquet(path)
            return path
        key = df.columns[0]
        ordered = df.orderBy((F.col(key) == F.lit(city_label)).asc_nulls_first(), F.col(key).asc_nulls_first())
        if fmt == "parquet":
            ordered.coalesce(1).write.mode("overwrite").parquet(path)
            return path
        write_csv(ordered, path, single_file=True)
        return path

    def write_all(folder: str) -> list[str]:
        return list(run_reports(reports, lambda name, df: write_one(name, df, folder), parallelism).values())

    if not publish:
        return write_all(out_dir)
    spark, paths = SparkSession.getActiveSession(), []
    version = versions.current(spark, out_dir)
    versions.publish(spark, out_dir, 0 if version is None else version + 1, lambda folder: paths.extend(write_all(folder)))
    return paths
