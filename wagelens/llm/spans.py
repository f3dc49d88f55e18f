"""Regular-expression spans with code-point offsets, in DataFrame expressions only.

Spark's regular-expression functions return matched texts, not places. The place of the i-th
match follows from the texts between the matches: ``split`` gives the gaps, ``regexp_extract_all``
the matches, and their lengths (code points) add up to the offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:long,rank:int,kind:string,end:long>"
NO_SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def found(text: Column, pattern: str, hint: Column | None = None, extra: int | None = None) -> Column:
    """array<struct<start:long,end:long,value:string,part:string>> of the leftmost non-overlapping matches.

    ``hint``: a cheap condition that every text with a match meets. ``extra``: the group returned
    as ``part`` (else the whole match again).
    """
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    values = F.regexp_extract_all(text, p, F.lit(0))
    part = values if extra is None else F.regexp_extract_all(text, p, F.lit(extra))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value"), part.alias("part"))
    shape = "array<struct<start:long,end:long,value:string,part:string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(shape).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["value"])
        one = F.struct(s.alias("start"), e.alias("end"), x["value"].alias("value"), x["part"].alias("part"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    some = F.rlike(text, p) if hint is None else hint & F.rlike(text, p)
    return F.when(some, F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(shape))


def labelled(rows: Column, kind: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """The matches that pass ``keep``, as spans of one kind."""
    if keep is not None:
        rows = F.filter(rows, keep)
    return F.transform(
        rows,
        lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")),
    ).cast(NO_SPANS)


def in_order(*kinds: Column) -> Column:
    """All spans by start, then by the rank of the kind, then by end."""
    return F.array_sort(F.concat(*kinds))


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))
