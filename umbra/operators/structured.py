"""Detectors of structured values as column expressions: text to arrays of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scalars import digits, is_date_like, luhn, valid_date
from ..functions.spans import as_spans, find, words

AROUND = 45


def before(text: Column, x: Column, n: int = AROUND) -> Column:
    left = F.greatest(x["start"] - n, F.lit(0))
    return F.substring(text, left + 1, x["start"] - left)


def around(text: Column, x: Column, n: int = AROUND) -> Column:
    left = F.greatest(x["start"] - n, F.lit(0))
    return F.substring(text, left + 1, x["end"] + n - left)


def emails(text: Column, strict: bool = True) -> Column:
    """``strict``: an address that a full stop follows is not taken."""
    pattern = P.EMAIL if strict else P.EMAIL.replace(r"(?![\w.-])", r"(?![\w-])")
    return as_spans(find(text, words(pattern), "@"), "EMAIL", "regex-email")


def ipv4(text: Column) -> Column:
    octet = lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]")
    found = find(text, words(P.IPV4), r"[0-9]\.[0-9]")
    return as_spans(F.filter(found, lambda x: F.forall(F.split(x["value"], r"\."), octet)), "IP", "ipv4-validation")


def ipv6(text: Column) -> Column:
    def valid(x: Column) -> Column:
        v = x["value"]
        groups = F.size(F.filter(F.split(v, ":"), lambda g: g != ""))
        short = v.contains("::") & ~v.rlike("::.*::|:::") & (groups <= 7)
        edges = ~v.rlike("^:[^:]|[^:]:$")
        return edges & F.when(v.contains("::"), short).otherwise(groups == 8)

    return as_spans(F.filter(find(text, P.IPV6, ":[0-9A-Fa-f]*:"), valid), "IP", "ipv6-validation")


def ssns(text: Column) -> Column:
    def issued(x: Column) -> Column:
        d = digits(x["value"])
        told = x["value"].rlike("[- ]") | around(text, x).rlike(words(P.SSN_WORDS))
        return told & ~d.rlike("^(?:000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$")

    return as_spans(F.filter(find(text, P.SSN, r"(?U)\d{4}"), issued), "SSN", "regex-ssn")


def card_candidates(text: Column) -> Column:
    return find(text, P.CARD, r"(?U)(?:\d[ -]?){12}\d")


def cards(text: Column) -> Column:
    def real(x: Column) -> Column:
        other = before(text, x).rlike(words(P.CARD_LABELS)) & ~around(text, x).rlike(words(P.CARD_WORDS))
        return luhn(digits(x["value"])) & ~other

    return as_spans(F.filter(card_candidates(text), real), "CREDIT_CARD", "luhn")


def phones(text: Column) -> Column:
    def real(x: Column) -> Column:
        v, lead = F.trim(x["value"]), before(text, x)
        d = digits(v)
        country, told = v.startswith("+"), lead.rlike(words(P.PHONE_WORDS))
        mobile = d.rlike("^[6-9][0-9]{9}\\z") | d.rlike("^0[6-9][0-9]{9}\\z")
        return F.length(d).between(7, 15) & ~is_date_like(v) & (country | told | (mobile & ~lead.rlike(words(P.PHONE_LABELS))))

    return as_spans(F.filter(find(text, words(P.PHONE), r"(?U)\d(?:[\s.\-()]*\d){6}"), real), "PHONE", "context-phone")


def born(text: Column, x: Column) -> Column:
    """A birth label stands close before the date, or right after it.

    Before: between the last label within 60 characters and the date there is no full stop, no word of another
    kind of date, no other date, and no semicolon. (A label after a semicolon would itself be the last one.)
    """
    lead = before(text, x, 60)
    # what follows the last label; the text with its labels marked is cut at the last mark
    between = F.element_at(F.split(lead, P.BIRTH, -1), -1)
    clear = ~between.rlike(r"[.;]") & ~between.rlike(P.OTHER_DATE_WORDS) & ~between.rlike(r"(?U)\d{1,4}[/\-.]\d{1,4}[/\-.]\d{1,4}")
    return (lead.rlike(P.BIRTH) & clear) | F.substring(text, x["end"] + 1, F.lit(24)).rlike(P.BIRTH_AFTER)


def births(text: Column) -> Column:
    def numeric(year_first: bool):
        def check(x: Column) -> Column:
            parts = F.split(x["value"], r"[/\-.]")
            y, d = (parts[0], parts[2]) if year_first else (parts[2], parts[0])
            return valid_date(y, parts[1], d) & born(text, x)

        return check

    def in_words(x: Column) -> Column:
        v = F.lower(x["value"])
        months = F.split(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), " ")
        m = F.array_position(months, F.substring(F.regexp_extract(v, f"(?i)({P.MONTH})", 1), 1, 3)).cast("string")
        d = F.regexp_extract(F.regexp_replace(v, r"(?U)\d{4}", ""), r"(?U)(\d{1,2})", 1)
        return valid_date(F.regexp_extract(v, r"(?U)(\d{4})", 1), m, d) & born(text, x)

    guard = r"(?iU)\bd\.?\s*o\.?\s*b|birth|born"
    spans = [
        F.filter(find(text, P.DAY_FIRST, guard), numeric(False)),
        F.filter(find(text, P.YEAR_FIRST, guard), numeric(True)),
        F.filter(find(text, P.IN_WORDS, guard), in_words),
    ]
    return as_spans(F.concat(*spans), "DOB", "context-dob")


def lead_line(context: Column) -> Column:
    """The last line of a context, as a line before the text; empty without one. Trailing white space is no line."""
    line = F.element_at(F.split(F.regexp_replace(context, r"(?U)\s+\z", ""), "\r\n|[\r\n]", -1), -1)
    return F.when(context.rlike(r"(?U)\S"), F.concat(line, F.lit("\n"))).otherwise("")


def births_after(whole: Column, lead: Column) -> Column:
    """Dates of ``whole`` that lie behind its first ``lead`` characters, with offsets from there."""
    moved = lambda s, f: (s[f] - lead).cast("int")
    return F.transform(F.filter(births(whole), lambda s: s["start"] >= lead), lambda s: s.withField("start", moved(s, "start")).withField("end", moved(s, "end")))


def structured(text: Column, dates: Column) -> Column:
    """All spans of structured types, in the order of the detectors; ``dates`` from ``births`` or ``births_after``."""
    return F.concat(emails(text), ipv4(text), ipv6(text), ssns(text), cards(text), phones(text), dates)
