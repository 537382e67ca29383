"""Spans of regular expressions as column expressions: find, resolve, splice. All run in the JVM.

Offsets count code points. Java's ``\\d \\w \\s \\b`` are ASCII unless a pattern starts with ``(?U)``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRIORITY, SPAN

FOUND = "array<struct<start:int,end:int,value:string>>"
WORD = r"\p{L}\p{N}_"


def words(pattern: str) -> str:
    """A pattern whose ``\\w`` and ``\\b`` know letters, numbers and the underscore, as Python's do.

    Java's take marks and joiners for parts of words too, but not numbers like ². ``\\w`` has to stand in brackets.
    """
    edge = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
    return pattern.replace(r"\w", WORD).replace(r"\b", edge)


def find(text: Column, pattern: str | Column, guard: str | None = None) -> Column:
    """All non-overlapping matches of a pattern that cannot match nothing: array of (start, end, value).

    The text between matches and the matches themselves are walked side by side, so each offset is a running sum.
    ``guard``: a cheaper pattern that every text with a match has.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))
    none = F.array().cast(FOUND)

    def step(acc: Column, pair: Column) -> Column:
        start = (acc["at"] + F.length(pair["gap"])).cast("int")
        end = (start + F.length(pair["hit"])).cast("int")
        one = F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value")))
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out")))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    there = F.regexp(text, p)
    if guard:
        there = text.rlike(guard) & there
    return F.when(there, walked).otherwise(none)


def as_spans(found: Column, kind: str, detector: str, score: float = 1.0, shift: Column | None = None) -> Column:
    """(start, end, value) to entity spans; ``shift`` is taken off the offsets."""
    off = F.lit(0) if shift is None else shift

    def one(x: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            (x["start"] - off).cast("int").alias("start"),
            (x["end"] - off).cast("int").alias("end"),
            x["value"].alias("text"),
            F.lit(score).alias("score"),
            F.lit(detector).alias("detector"),
            F.lit(None).cast("string").alias("identity"),
        )

    return F.transform(found, one)


def priority(kind: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(PRIORITY.items()))), kind)


def resolve(spans: Column) -> Column:
    """Spans without overlaps, by start.

    Candidates come by start, longest first. One that meets the last accepted span takes its place if its
    (priority, length, score) is larger; what that one had displaced before does not come back. Accepted spans are disjoint and
    sorted, so only the last can meet a candidate.
    """

    def keyed(x: Column, i: Column) -> Column:
        size = x["end"] - x["start"]
        rank = priority(x["type"])
        return F.struct(x["start"].alias("a"), (-size).alias("b"), (-rank).alias("c"), (-x["score"]).alias("d"), i.alias("e"), x.alias("span"))

    def weight(k: Column) -> Column:
        return F.struct(-k["c"], -k["b"], -k["d"])

    def step(kept: Column, k: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        meets = F.coalesce(k["span"]["start"] < last["span"]["end"], F.lit(False))
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(k))
        return F.when(~meets, F.concat(kept, F.array(k))).when(weight(k) > weight(last), swapped).otherwise(kept)

    ordered = F.array_sort(F.transform(spans, keyed))
    return F.when(F.size(spans) <= 1, spans).otherwise(F.transform(F.aggregate(ordered, F.slice(ordered, 1, 0), step), lambda k: k["span"]))


def splice(text: Column, parts: Column) -> Column:
    """``text`` with each (start, end, replacement) of a sorted, disjoint array put in."""
    piece = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], piece(acc["at"], x["start"]), x["replacement"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], piece(acc["at"], F.length(text)))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, finish)


def snippet(text: Column, start: Column, end: Column, radius: int = 90) -> Column:
    """What stands around a span, white space collapsed."""
    left = F.greatest(start - radius, F.lit(0))
    around = F.substring(text, left + 1, F.least(end + radius, F.length(text)) - left)
    return F.trim(F.regexp_replace(around, r"(?U)\s+", " "))


def typed(spans: Column) -> Column:
    return spans.cast(f"array<{SPAN}>")
