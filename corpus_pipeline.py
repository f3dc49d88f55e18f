"""Training-data pipeline: five stages, each over all that its predecessor kept.

``run`` applies them to ``documents``; every stage's rows are written as Parquet in the shared
checkpoint folder and reread, so a lost executor costs at most the stage that is running. All stages
but the last return the columns of ``documents``; the last returns doc_id, n_tokens, ids and the text
decoded from the ids.

Defined cases: a null text counts as empty; empty texts are equal to each other, so one of them stays,
which near_dedup then keeps alone and the last stage gives no ids. A null doc_id is smaller than any
other in exact_dedup, larger in near_dedup, and stays null. Of rows repeated with one doc_id and text
one stays; rows of one doc_id with different texts are judged apart. Texts that tie stay by doc_id:
the largest of equal ones, the smallest of near ones. Very long texts are taken whole, each by one task.
Without labels the classifier accepts all, without benchmark items nothing is contaminated, and empty
tables give no rows. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagelens.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from wagelens.llm.common import documents, small_batches, stored

#: Of texts in a block of the last stage; the executors still hold what the stages before made them load.
BLOCK_BYTES = 3 << 20

#: The stages hold decisions that SQL can't express (a trained classifier, a tokenizer).
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.keep_one(spark, docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (runs of five words, similarity 0.8) the document with the smallest doc_id."""
    small_batches(spark)
    return near_dedup.keep_one(docs, 5)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them."""
    import public_tokenizers

    small_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = bpe.encode(docs, ranks, BLOCK_BYTES)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.decode(F.col("ids"), ranks).cast("string").alias("text"))


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
