"""Exact dedup by stateful streaming: keyed state on disk, full bytes compared on hits.

Method. Every row becomes a key row ``(digest, doc_id, row, file)``. A streaming aggregation over
the key rows holds, per digest and without expiry, the largest ``(doc_id, row, file)`` -- the
stable identifier and the content locator of the row that stays -- and the group's size, in
RocksDB state stores. Digests seen more than once are hits: the whole texts of their rows are
fetched and compared, and a digest that stands for different texts is regrouped by the text itself.

Scale. The text is read for the digest and once more for the rows of hits; the shuffles carry key
rows, but for one that brings the texts to the hits' ids (balanced: ids are distinct). A group of
copies that holds a third of all rows is summed before each shuffle; the join that hands the
group's answer back to its rows is one that Spark can split. The stream resumes from its
checkpoint in the shared folder.

Defined cases: null text counts as empty, empty texts are equal to each other; null doc_id is
smaller than any other; of rows repeated with one doc_id and text exactly one stays; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored, texts

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else every store sets 4 MB of disk aside for its log, however few keys it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_state(spark: SparkSession, keys: DataFrame, source: str, files_per_batch: int = 10_000) -> DataFrame:
    """Runs the stream over the written key rows and returns its state: digest, keeper, group_size."""
    old = {k: spark.conf.get(k, None) for k in STATE_CONF}
    out = scratch_path(spark, "exact-state")

    def put(batch: DataFrame, epoch: int) -> None:
        # A retried epoch writes over its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        state = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row", "file")).alias("keeper"),
            F.count(F.lit(1)).alias("group_size"),
        )
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", scratch_path(spark, "exact-stream"))
            .trigger(availableNow=True)
            .foreachBatch(put)
            .start()
        )
        query.awaitTermination()  # raises what the stream failed with
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = state.schema
    if keys.isEmpty():  # no epoch wrote anything
        return spark.createDataFrame([], shape)
    # Each epoch wrote the keys that it changed; sizes only grow, so the largest is the last.
    return (
        spark.read.schema(shape).parquet(f"{out}/epoch=*")
        .groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
    )


def exact_groups(
    spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 10_000
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row (a number of the row)."""
    text = texts(docs)
    keys_df = text.select(
        digest(F.col("text")).alias("digest"), "doc_id", F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("file"), sha256(F.col("text")).alias("text_sha256"),
    )
    keys = stored(keys_df, "exact-keys")
    state = stored(keyed_state(spark, keys, keys.inputFiles()[0].rpartition("/")[0] if keys.inputFiles() else "", files_per_batch), "exact-kept")

    # Full bytes of the hits: of equal texts the smallest and the largest are the same.
    hits = state.where("group_size > 1").select("digest")
    members = keys.join(hits, "digest").select("doc_id", F.col("digest").alias("key")).distinct()
    bytes_of = stored(
        text.withColumn("digest", digest(F.col("text"))).alias("t")
        .join(members.alias("m"), F.expr("t.doc_id <=> m.doc_id and t.digest = m.key"))
        .select(F.col("t.doc_id").alias("doc_id"), "digest", "text"),
        "exact-hits",
    )
    mixed = stored(
        bytes_of.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"),
        "exact-mixed",
    )
    out = keys.join(state, "digest").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keeper.row")).alias("kept"), "text_sha256", "row", "digest",
    )
    if mixed.isEmpty():
        return out.drop("digest")
    # Digests that stand for several texts: regrouped by the text's own bytes.
    whole = bytes_of.join(mixed, "digest").distinct()
    on = F.expr("k.doc_id <=> w.doc_id and k.digest = w.digest") & (F.col("k.text_sha256") == F.sha2(F.col("w.text"), 256))
    rows = keys.alias("k").join(whole.alias("w"), on).select("k.doc_id", "k.row", "k.text_sha256", "w.text")
    groups = rows.groupBy("text").agg(F.max(F.struct("doc_id", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    again = rows.join(groups, "text").select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keeper.row")).alias("kept"), "text_sha256", "row",
    )
    return out.join(mixed, "digest", "left_anti").drop("digest").unionByName(again)


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the copies, all columns as they are.

    A repeated row (same doc_id, same text) is returned once.
    """
    kept = exact_groups(spark, docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key"))
    rows = docs.withColumn("__sha", sha256(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    both = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (rows["__sha"] == kept["__key"]), "left_semi")
    return both.dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_groups(spark, documents(spark, sf_dir)).drop("row")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
