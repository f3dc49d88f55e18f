"""Personal data: weak labelers vote, expectation-maximisation weighs them, a span classifier decides.

Method. Candidates are the base spans (email, ip, card, phone) and spans of wider patterns (local
phone numbers, social-security-like numbers, names after a form of address or a known first name).
Four labelers vote +1, -1 or 0 on each candidate: a strict *pattern*, a *gazetteer* (top-level
domains, card issuers, country codes, reserved address ranges, first names), the *context* (a cue
word shortly before) and the *edges* (is the span part of a longer token?). The corpus is summed to
one row per kind and vote pattern; EM over those sums estimates each labeler's reliability and the
share of true spans per kind, without any hand label. The posteriors are soft labels for the final
classifier, a naive Bayes over span features (kind, length, digits, neighbouring characters, cue),
whose tables are again corpus-wide sums. A candidate outside the base is returned where the
classifier gives it 0.5 or more; base spans always stay.

Scale. Texts are read once and never shuffled; what is stored is one row per document with a few
numbers per candidate. Votes and features take few values, so the sums have at most
kinds * 3^4 and (kinds * feature values) rows, whatever the corpus: they alone reach the driver.

Defined cases: null text is empty; repeated rows are returned again; null doc_id is kept; an empty
table gives no rows; other columns are ignored; matches are leftmost and non-overlapping per kind
and a match that fails its check is consumed. Without any candidate the classifier accepts nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as sp
from .common import documents, stored, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("local", "ssn", "name")
KINDS = BASE + ADDED
LABELERS = ("pattern", "gazetteer", "context", "edges")

# The base patterns, with possessive quantifiers where going back finds nothing.
# A run of address characters is entered at its start or right after a match (\G), never in its middle.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL = r"(?<![0-9+(-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
FIRST_NAMES = (
    "Alice", "Anna", "Carlos", "Claire", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Jose", "Juan", "Julia",
    "Karl", "Klaus", "Laura", "Linda", "Louis", "Lucia", "Maria", "Marie", "Mary", "Michael", "Paul", "Peter", "Pierre",
    "Robert", "Sarah", "Sophie", "Susan", "Thomas",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Madame", "Monsieur", "Senor", "Senora")
NAME = (
    r"\b(?:(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?|(?:"
    + "|".join(FIRST_NAMES) + r")\x20\p{Lu}\p{Ll}{1,30})\b"
)
TLDS = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|ca|ch|at|example|invalid|test)$"
CUES = {
    "email": r"(?i)mail|contact|write|reach|@", "ip": r"(?i)\bip\b|address|host|server|login|from", "card": r"(?i)card|visa|pay|account|credit|iban",
    "phone": r"(?i)phone|call|tel|mobile|fax|contact|ring", "local": r"(?i)phone|call|tel|mobile|fax|contact|ring",
    "ssn": r"(?i)ssn|social|security|tax", "name": r"(?i)name|contact|dear|signed|by|from|regards",
}
CUE_SPAN = 40  # code points before a span in which a cue counts
ROUNDS = 15
ACCEPT = 0.5

CANDIDATE = (
    "struct<start:long,rank:int,kind:string,end:long,v1:int,v2:int,v3:int,v4:int,f1:string,f2:string,f3:string,f4:string>"
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """Luhn's check over the digits of a short value (its length is bounded before)."""
    d = F.reverse(digits(value))
    places = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.struct(i.alias("i"), F.substring(d, i, F.lit(1)).cast("int").alias("v")))
    double = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x["i"] % 2 == 0, double(x["v"])).otherwise(x["v"]))
    return total % 10 == 0


def small_parts(value: Column) -> Column:
    """All numbers of a dotted quad are at most 255 (of any length)."""
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\.", -1), lambda p: (F.length(number(p)) <= 3) & (F.substring(number(p), 1, 3).cast("int") <= 255))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _gazetteer(kind: str, value: Column) -> Column:
    never = F.lit(False)
    if kind == "email":
        return _vote(F.rlike(value, F.lit(TLDS)), F.rlike(value, F.lit(r"\.[0-9-]+$")))
    if kind == "ip":
        return _vote(never, F.rlike(value, F.lit(r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\.")))
    if kind == "card":
        return _vote(F.rlike(value, F.lit(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")), F.rlike(value, F.lit("^0")))
    if kind == "phone":
        return _vote(F.rlike(value, F.lit(r"^\+(?:1|33|34|41|43|44|49|55|7|81|86|91)")), F.rlike(value, F.lit(r"^\+0")))
    if kind == "local":
        return _vote(F.rlike(value, F.lit(r"^\(?[2-9]")), F.rlike(value, F.lit(r"^\(?[01]")))
    if kind == "ssn":
        return _vote(never, F.rlike(value, F.lit(r"^(?:000|666|9)|-00-|-0000$")))
    return _vote(F.rlike(value, F.lit(r"\b(?:" + "|".join(FIRST_NAMES) + r")\b")), never)


def _strict(kind: str, value: Column) -> Column:
    shape = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}[A-Za-z0-9]?@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,5}[A-Za-z]{2,24}$",
        "ip": r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$", "card": r"^(?:[0-9]{4}[\x20-]){3}[0-9]{2,7}$|^[0-9]{14,19}$",
        "phone": r"^\+[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{1,5}\)?){2,5}$", "local": r"^(?:\([0-9]{3}\)\x20?[0-9]{3}-|([0-9]{3})([.-])[0-9]{3}\2)[0-9]{4}$",
        "ssn": r"^(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "name": r"^\p{Lu}\p{Ll}+\.?(?:\x20\p{Lu}\p{Ll}{2,}){1,2}$",
    }[kind]
    return _vote(F.rlike(value, F.lit(shape)), ~F.rlike(value, F.lit(shape)))


def _bucket(n: Column, *edges: int) -> Column:
    out = F.lit(f"{edges[-1]}+")
    for e in reversed(edges):
        out = F.when(n <= e, F.lit(str(e))).otherwise(out)
    return out


def _side(c: Column) -> Column:
    """Class of a neighbouring character."""
    return (
        F.when(c == "", "none").when(F.rlike(c, F.lit("[0-9]")), "digit").when(F.rlike(c, F.lit(r"\p{L}")), "letter")
        .when(F.rlike(c, F.lit(r"\s")), "space").otherwise("mark")
    )


def _candidates(text: Column, kind: str, rank: int, rows: Column) -> Column:
    def one(x: Column) -> Column:
        value = x["value"]
        before = F.substring(text, F.greatest(x["start"] - CUE_SPAN + 1, F.lit(1)).cast("int"), F.least(x["start"], F.lit(CUE_SPAN)).cast("int"))
        left = F.when(x["start"] > 0, F.substring(text, x["start"].cast("int"), F.lit(1))).otherwise("")
        right = F.substring(text, (x["end"] + 1).cast("int"), F.lit(1))
        cue = F.rlike(before, F.lit(CUES[kind]))
        glued = F.rlike(left, F.lit(r"[\p{L}0-9_]")) | F.rlike(right, F.lit(r"[\p{L}0-9_]"))
        return F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"),
            _strict(kind, value).alias("v1"), _gazetteer(kind, value).alias("v2"), _vote(cue, F.lit(False)).alias("v3"), _vote(~glued, glued).alias("v4"),
            _bucket(F.length(value), 8, 12, 16, 24, 40).alias("f1"), _bucket(F.length(digits(value)), 0, 4, 9, 11, 16).alias("f2"),
            F.concat_ws("|", _side(left), _side(right)).alias("f3"), F.when(cue, "cue").otherwise("none").alias("f4"),
        )

    return F.transform(rows, one).cast(f"array<{CANDIDATE}>")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, cands: the candidates of every document, with votes and features, in order."""
    t = F.col("text")
    n_digits = lambda x: F.length(digits(x["value"]))
    quad = F.contains(t, F.lit("."))
    rows = {
        "email": sp.found(t, EMAIL, F.contains(t, F.lit("@"))),
        "ip": F.filter(sp.found(t, IP, quad), lambda x: small_parts(x["value"])),
        "card": F.filter(F.filter(sp.found(t, CARD), lambda x: n_digits(x).between(14, 19)), lambda x: luhn_ok(x["value"])),
        "phone": F.filter(sp.found(t, PHONE, F.contains(t, F.lit("+"))), lambda x: n_digits(x).between(10, 15)),
        "local": sp.found(t, LOCAL),
        "ssn": sp.found(t, SSN, F.contains(t, F.lit("-"))),
        "name": sp.found(t, NAME),
    }
    found = [_candidates(t, k, i, rows[k]) for i, k in enumerate(KINDS)]
    return texts(docs).select("doc_id", sp.in_order(*found).alias("cands"))


def estimate(votes: list[tuple], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """EM over the vote patterns (kind, v1, v2, v3, v4, n): the share of true spans per kind and, per
    labeler, P(vote is +1 | true and voted) and P(vote is +1 | false and voted). Smoothed by pseudo-votes.

    There are at most kinds * 3^4 patterns, so they fit the driver whatever the corpus.
    """
    share = {k: 0.7 for k in KINDS}
    rate = {v: (0.8, 0.3) for v in LABELERS}
    for _ in range(rounds):
        true, seen = dict.fromkeys(KINDS, 1.0), dict.fromkeys(KINDS, 2.0)
        plus = {v: [2.0, 1.0] for v in LABELERS}  # weight of +1 votes on true and on false spans
        cast = {v: [3.0, 3.0] for v in LABELERS}  # of all votes
        for kind, *vs, n in votes:
            odds = math.log(share[kind] / (1 - share[kind]))
            for v, x in zip(LABELERS, vs, strict=True):
                t, f = rate[v]
                odds += math.log(t / f) if x > 0 else math.log((1 - t) / (1 - f)) if x < 0 else 0.0
            p = 1 / (1 + math.exp(-odds))
            true[kind] += n * p
            seen[kind] += n
            for v, x in zip(LABELERS, vs, strict=True):
                for side, w in enumerate((p, 1 - p)):
                    cast[v][side] += n * w * (x != 0)
                    plus[v][side] += n * w * (x > 0)
        share = {k: true[k] / seen[k] for k in KINDS}
        rate = {v: (plus[v][0] / cast[v][0], plus[v][1] / cast[v][1]) for v in LABELERS}
    return share, rate


def posterior(share: dict[str, float], rate: dict[str, tuple[float, float]], row: Column | None = None) -> Column:
    """P(true span | votes), of columns kind, v1..v4 or of a struct that has them."""
    at = F.col if row is None else (lambda n: row[n])
    odds = F.lit(0.0)
    for k in KINDS:
        odds = F.when(at("kind") == k, math.log(share[k] / (1 - share[k]))).otherwise(odds)
    for i, v in enumerate(LABELERS, 1):
        t, f = rate[v]
        odds = odds + F.when(at(f"v{i}") == 1, math.log(t / f)).when(at(f"v{i}") == -1, math.log((1 - t) / (1 - f))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def train(rows: DataFrame, share: dict[str, float], rate: dict[str, tuple[float, float]]) -> tuple[float, dict[str, float]]:
    """Naive Bayes on the span features with the posteriors as soft labels: the prior log odds, and log odds per feature value."""
    p = posterior(share, rate, F.col("c"))
    features = F.array(*[F.concat_ws("=", F.lit(f"f{i}"), F.col("c.kind"), F.col(f"c.f{i}")) for i in range(1, 5)], F.lit("all"))
    sums = (
        rows.select(p.alias("p"), features.alias("fs")).select("p", F.explode("fs").alias("f"))
        .groupBy("f").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("u"))
    ).collect()
    total = next(((r["t"], r["u"]) for r in sums if r["f"] == "all"), (0.0, 0.0))
    prior = math.log((total[0] + 1) / (total[1] + 1))
    return prior, {r["f"]: math.log((r["t"] + 1) / (r["u"] + 1)) - prior for r in sums if r["f"] != "all"}


def score(c: Column, prior: float, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
    odds = F.lit(prior)
    for i in range(1, 5):
        odds = odds + F.coalesce(F.element_at(table, F.concat_ws("=", F.lit(f"f{i}"), c["kind"], c[f"f{i}"])), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans (start, rank, kind, end in order): the base spans and those that the classifier accepts."""
    rows = stored(candidates(docs), "pii-candidates")
    each = rows.select(F.explode("cands").alias("c"))
    votes = [tuple(r) for r in each.groupBy("c.kind", "c.v1", "c.v2", "c.v3", "c.v4").agg(F.count(F.lit(1)).alias("n")).collect()]
    share, rate = estimate(votes)
    prior, weights = train(each, share, rate)
    good = F.filter("cands", lambda c: c["kind"].isin(list(BASE)) | (score(c, prior, weights) >= ACCEPT))
    return rows.select("doc_id", F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        *[sp.count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(sp.as_text(sp.of_kinds(F.col("spans"), list(BASE))), 256).alias("base_sha256"),
        sp.as_text(F.col("spans")).alias("spans"),
    )
