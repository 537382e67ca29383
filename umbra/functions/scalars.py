"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"
TRIMMED = ".,;:()[]'’\""


def collapse(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, SPACE, " "))


def fold_case(v: Column) -> Column:
    """Lower case, with the sharp s as two letters."""
    return F.replace(F.lower(v), F.lit("ß"), F.lit("ss"))


def key(v: Column) -> Column:
    return fold_case(collapse(v))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\D", "")


@F.pandas_udf(T.StringType())
def normal_text(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, collapsed, case-folded; null is empty. Compatibility forms have no built-in function."""
    import unicodedata

    for v in values:
        yield v.fillna("").map(lambda s: " ".join(unicodedata.normalize("NFKC", s).split()).casefold())


def slug(v: Column) -> Column:
    dotted = F.lower(F.btrim(F.regexp_replace(v, "[^A-Za-z0-9]+", "."), F.lit(".")))
    return F.when(dotted == "", "user").otherwise(dotted)


def is_date_like(v: Column) -> Column:
    return F.trim(v).rlike(r"(?U)^\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\z")


def valid_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd").isNotNull()


def luhn(d: Column) -> Column:
    """Of a string of digits: 13 to 19 of them, and the check digit fits."""
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _count(v: Column, others: str) -> Column:
    return F.length(F.regexp_replace(v, others, "")).cast("string")


def _sizes(v: Column) -> list[Column]:
    return [F.lit(", "), _count(v, r"\P{L}"), F.lit(" letters, "), _count(v, r"\P{Nd}"), F.lit(" digits, "), F.length(v).cast("string"), F.lit(" chars")]


def _words(v: Column, edge: str) -> Column:
    stripped = F.transform(F.split(F.trim(v), SPACE), lambda t: F.btrim(t, F.lit(edge)))
    return F.filter(stripped, lambda t: t != "")


def value_shape(v: Column) -> Column:
    """What a value looks like, without any of its characters: classes of its words, and counts."""

    def word(t: Column) -> Column:
        caps = (F.length(t) > 1) & t.rlike(r"\p{L}") & (F.upper(t) == t)
        return F.when(caps, "CAPS").when(t.rlike(r"^[A-Za-z]\.\z"), "initial").when(t.rlike(r"^\p{Lu}"), "Capitalized").otherwise("lower")

    words = _words(v, TRIMMED)
    listed = F.when(F.size(words) == 0, "none").otherwise(F.array_join(F.transform(words, word), "/"))
    kind = F.when(v.contains("@"), "email-shaped value").when(~v.rlike(r"\p{L}"), "numeric value").otherwise(F.concat(F.size(words).cast("string"), F.lit(" token(s) ["), listed, F.lit("]")))
    return F.concat(kind, *_sizes(v))


def residual_shape(v: Column) -> Column:
    """As ``value_shape`` with the number of words only."""
    words = F.size(_words(v, ".,;:()[]")).cast("string")
    kind = F.when(v.contains("@"), "email-shaped value").when(~v.rlike(r"\p{L}"), "numeric value").otherwise(F.concat(words, F.lit(" token(s)")))
    return F.concat(kind, *_sizes(v))


def audit_shape(v: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(v), SPACE), lambda t: t != "")).cast("string")
    kind = F.when(v.contains("@"), "email-shaped").when(~v.rlike(r"\p{L}"), "numeric").otherwise(F.concat(words, F.lit(" token(s)")))
    return F.concat(kind, *_sizes(v))


def endpoint(target: Column) -> Column:
    """Scheme and host of a link target; user part, path and query stay out."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*):(?:/{0,3}([^/?#]*))?"
    host = F.substring_index(F.regexp_extract(target, parts, 2), "@", -1)
    return F.when(target.rlike(parts), F.concat(F.lower(F.regexp_extract(target, parts, 1)), F.lit("://"), host)).otherwise("(unparseable)")


def occurrences(text: Column, needle: Column) -> Column:
    """All starts of ``needle``, overlapping ones too."""
    last = F.length(text) - F.length(needle)
    none = F.array().cast("array<int>")
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.length(needle)) == needle)
    return F.when((last < 0) | (F.length(needle) == 0) | ~F.contains(text, needle), none).otherwise(places)


def metric_text(v: Column) -> Column:
    return F.coalesce(F.format_string("%.3f", v), F.lit("N/A"))


def percent(v: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", v * 100), F.lit("N/A"))


def location(unit_id: Column, place: Column, part: Column) -> Column:
    """The first that is not empty."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(unit_id), filled(place), filled(part), F.lit(""))


def split_location(v: Column) -> tuple[Column, Column]:
    """Base name of the part, and the unit after the first colon."""
    bare = F.regexp_replace(v, "^/+", "")
    part = F.substring_index(bare, ":", 1)
    unit = F.when(bare.contains(":"), F.regexp_replace(bare, "^[^:]*:", "")).otherwise("")
    return F.substring_index(F.replace(part, F.lit("\\"), F.lit("/")), "/", -1), unit
