"""Keeping the measure cube up to date while payroll files keep arriving.

New payroll files (e.g. a new fiscal year, or a late correction batch) land in a folder. A
streaming query reads only the new files. Each micro-batch is filtered, enriched and summed exactly as
the batch cube is (:func:`measure_cube`): with weights small enough they are broadcast, otherwise the
batch is summed per (cube key, first name) before it meets them, so only sums are shuffled. The batch's
cube is then added to the cube so far, one row per (fiscal_year, agency, title).

The cube is the state. It is kept as numbered versions, one per epoch, and an epoch becomes current by
a marker written last (:mod:`wagelens.sources.versions`): a crash at any point leaves the cube of the
epoch before it whole, and the repeated epoch starts from that one. An epoch whose marker stands is not
added again. Reports are built from the current version with
``ReportSuite(..., cube=read_cube(spark, cube_path))``.

The landing folder is append-only: every file holds new payroll rows. Nothing has event time, so no
watermark is needed; the state is bounded by the number of cube keys, which grows by one fiscal year
at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.aggregates import CUBE_KEYS, CUBE_MEASURES, measure_cube, sum_cube
from ..operators.filters import eligible
from ..plans.profiles import Profile
from ..sources import files, versions


def read_payroll_stream(spark: SparkSession, folder: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Payroll rows from files as they arrive in ``folder``.

    Parquet files have the canonical columns (declared schema). CSV files may each have their own
    header: the stream then carries their lines, which ``start_cube_upkeep`` reads by header
    (:func:`wagelens.sources.files.payroll_from_lines`).
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        return files.with_places(reader.text(folder))
    return reader.schema(schemas.PAYROLL).format(fmt).load(folder)


def batch_cube(batch: DataFrame, weights: DataFrame, profile: Profile) -> DataFrame:
    """The measure cube of one micro-batch (payroll rows, or lines of CSV files)."""
    rows = files.payroll_from_lines(batch) if files.are_lines(batch) else batch
    return measure_cube(eligible(rows, profile.years), weights, profile.unmatched, profile.max_broadcast_rows)


def added(cube: DataFrame | None, more: DataFrame) -> DataFrame:
    """Two cubes summed per key, with the types of the first."""
    if cube is None:
        return more
    out = sum_cube(cube.select(*CUBE_KEYS, *CUBE_MEASURES).unionByName(more.select(*CUBE_KEYS, *CUBE_MEASURES)))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in cube.schema.fields])


def read_cube(spark: SparkSession, cube_path: str) -> DataFrame:
    """The current cube."""
    return spark.read.parquet(versions.current_path(spark, cube_path))


def add_epoch(batch: DataFrame, epoch: int, weights: DataFrame, profile: Profile, cube_path: str) -> None:
    """Publishes the cube of ``epoch``: the one before it and the batch. Repeating an epoch changes nothing."""
    spark = batch.sparkSession
    at = versions.current(spark, cube_path)
    if at is not None and at >= epoch:
        return
    if (-1 if at is None else at) != epoch - 1:
        raise RuntimeError(f"the cube in {cube_path} stands at epoch {at}, the stream at {epoch}: they don't belong together")
    before = None if at is None else read_cube(spark, cube_path)
    cube = added(before, batch_cube(batch, weights, profile))
    versions.publish(spark, cube_path, epoch, lambda folder: cube.write.parquet(folder))


def start_cube_upkeep(
    payroll_stream: DataFrame,
    weights: DataFrame,
    profile: Profile,
    cube_path: str,
    checkpoint_location: str,
    available_now: bool = True,
    processing_time: str | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Start the upkeep query. ``available_now`` processes what is there and stops (scheduled
    runs); otherwise it runs continuously with the given ``processing_time`` trigger. ``on_batch``
    is called after an epoch is published and before the stream takes note of it."""

    def one(batch: DataFrame, epoch: int) -> None:
        add_epoch(batch, epoch, weights, profile, cube_path)
        if on_batch is not None:
            on_batch(batch, epoch)

    writer = payroll_stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint_location).queryName(f"cube_upkeep_{profile.name}")
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
