"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path

#: Of texts that go to Python at once; Spark's 10,000 are tens of MB, held in the executor and in its worker.
BATCH_ROWS = 1000
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table, whole."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of every row; a null text counts as empty. Other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs))


def text_or_empty(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what stands before, and a table
    used several times is computed once.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_path(spark, name)
    # The written table takes the place of the shuffles behind it; their files go with the write.
    old = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets at most ``BATCH_ROWS`` rows go to Python at once in this session; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCHES)) <= BATCH_ROWS:
        spark.conf.set(BATCHES, BATCH_ROWS)


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition that also lets null keys meet."""
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on


def parts(rows: int, per_part: int, least: int = 1) -> int:
    """How many partitions hold ``rows`` at ``per_part`` each."""
    return max(least, -(-max(0, rows) // per_part))
