"""Secret scan with an incremental ledger of content-addressed blobs.

Method. A *version* is one text under one path (a document row, a historical version of a file).
Its content address is the SHA-256 of the text. The ledger is a Parquet table of
``(blob, rules, spans)``: which rule versions were run over the blob and what they found. A scan
takes the distinct blobs of all versions, takes away the rule versions that the ledger holds for
them, runs only what is left over one copy of each such blob, appends that to the ledger, and
joins the findings back to every path. A new version of a rule is run over every blob once; old
blobs under new paths cost nothing.

Scale. Distinct blobs are found on digests alone (map-side partial sums). The text moves once, by
doc_id, to meet the ids chosen to stand for their blobs, so a blob that a third of all paths share
neither moves nor is scanned more than once. Findings go back to paths by a join whose hot key
Spark can split. Everything is DataFrame expressions.

Defined cases: null text is the empty blob, without findings; a repeated row gets the findings
again; a null doc_id is a path like any other; an empty table gives no rows; other columns are
ignored. Matches are leftmost and non-overlapping per kind; a match that fails its check is
consumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as sp
from .common import documents, scratch_path, texts


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``version`` goes up whenever the rule changes: all blobs are then scanned anew."""

    kind: str
    version: int
    pattern: str
    hint: str | None = None  # a literal that every match contains
    part: int | None = None  # the group whose length counts
    least: int = 0  # its least length

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds. Possessive quantifiers only spare the matcher from going
# back where that cannot find anything; a run of hex digits or capitals shorter than asked for
# holds no match, so its length can stand in the pattern.
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", part=1, least=8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+", hint="AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
# Published token formats, added by the method's own rule set.
ADDED = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,255}+", hint="gh"),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,250}+", hint="xox"),
    Rule("google", 1, r"\bAIza[A-Za-z0-9_-]{35}", hint="AIza"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hint="eyJ"),
)
RULES = BASE + ADDED

LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rules", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()),
            T.StructField("kind", T.StringType()), T.StructField("end", T.LongType()), T.StructField("rule", T.StringType()),
        ]))),
    ]
)


def _run(rule: Rule, rank: int, text: Column, pending: Column) -> Column:
    hint = None if rule.hint is None else F.contains(text, F.lit(rule.hint))
    long_enough: Callable[[Column], Column] | None = None
    if rule.part is not None:
        long_enough = lambda x: F.length(x["part"]) >= rule.least
    spans = sp.labelled(sp.found(text, rule.pattern, hint, rule.part), rule.kind, rank, long_enough)
    spans = F.transform(spans, lambda s: s.withField("rule", F.lit(rule.key)))
    return F.when(F.array_contains(pending, rule.key), spans).otherwise(F.array().cast(LEDGER["spans"].dataType))


def read_ledger(spark: SparkSession, ledger: str | None) -> DataFrame:
    if ledger is None:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def pending_blobs(versions: DataFrame, seen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, pending (the rules not yet run over it), doc_id (a path that has it): only blobs with work left."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    done = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("pending") > 0).select("blob", "pending", "doc_id")


def scan(
    spark: SparkSession, docs: DataFrame, ledger: str, known: bool = False, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Brings the ledger at the path ``ledger`` up to date with ``docs`` and returns (doc_id, spans) of every row.

    ``known``: the ledger exists already. ``spans`` holds start, rank, kind, end in order.
    """
    text = texts(docs).withColumn("blob", F.sha2("text", 256))
    versions = text.select("doc_id", "blob")
    todo = pending_blobs(versions, read_ledger(spark, ledger if known else None), rules)
    work = text.alias("t").join(todo.alias("w"), F.expr("t.doc_id <=> w.doc_id and t.blob = w.blob")).select("t.blob", "t.text", "w.pending")
    found = F.concat(*[_run(r, i, F.col("text"), F.col("pending")) for i, r in enumerate(rules)])
    work.select("blob", F.col("pending").alias("rules"), found.alias("spans")).write.mode("append").parquet(ledger)

    # Findings of the wanted rule versions, once per blob; a table of its own so that the join below
    # can be split where one blob has a large share of the paths.
    keys = [r.key for r in rules]
    now = (
        read_ledger(spark, ledger)
        .select("blob", F.filter("spans", lambda s: s["rule"].isin(keys)).alias("spans")).where(F.size("spans") > 0)
        .groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
        .select("blob", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s.dropFields("rule")))).alias("spans"))
    )
    path = scratch_path(spark, "secret-findings")
    now.write.parquet(path)
    findings = spark.read.schema(now.schema).parquet(path)
    return versions.join(findings, "blob", "left").select("doc_id", F.coalesce("spans", sp.no_spans()).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a path with one version; the ledger starts empty."""
    rows = scan(spark, documents(spark, sf_dir), scratch_path(spark, "secret-ledger"))
    base = sp.of_kinds(F.col("spans"), [r.kind for r in BASE])
    return rows.select(
        "doc_id",
        *[sp.count_of(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(sp.as_text(base), 256).alias("base_sha256"),
        sp.as_text(F.col("spans")).alias("spans"),
    )
