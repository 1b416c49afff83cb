"""Places of pattern matches in texts, in DataFrame functions only.

Splitting a text at a pattern gives what lies between its matches, and extracting gives the matches; running sums of
their lengths give the places in code points, end exclusive. Both follow the same leftmost non-overlapping matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, holds: Column | None = None) -> Column:
    """start, end and hit of each match. holds: a cheap test without which no match can be; the pattern then isn't run."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + F.length(pair["hit"])
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"))).alias("spans")))

    found = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    test = text.rlike(pattern) if holds is None else holds
    return F.when(F.coalesce(test, F.lit(False)), found).otherwise(no_spans())


def listed(kind: str, spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def keyed(order: int, kind: str, spans: Column) -> Column:
    """Spans with what they sort by: start, then the kind's place."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("said")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, put), in order of start, replaced by put; overlapping spans become one, with the first one's put."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), s["put"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(F.struct(s["end"].alias("at"), F.array_append(acc["parts"], piece).alias("parts")))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
