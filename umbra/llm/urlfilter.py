"""URL filtering with pattern rules indexed by their rarest literal token; DataFrame functions only.

A rule is a pattern and a verdict. Pattern syntax: ``||`` in front of a host and the beginning of a path (the host and all its
subdomains; read from host and path), ``|`` at the start or the end of the URL, ``*`` any characters, ``^`` an edge (a character
that is no letter or digit, or the start or end of the URL); all else is literal, and all but a path after ``||`` is compared in lower case.

*Site* rules (those with ``||``): of all that fit the longest decides, and is named. Where none fits, *pattern* rules do: a
blocking one that fits blocks, unless an allowing one fits too. What no rule fits is allowed.

Every rule has literal tokens that a matching URL must hold whole; the one that the fewest URLs of the corpus hold indexes it.
URL tokens fetch candidate rules through a hash join, and only candidates run their regular expression. A rule without such a
token is a candidate of every URL. Equal URLs are judged once.

Null URLs and those without ``://`` have an empty host and path and no site rule; null ones no rule at all. Rows are kept as they
are, repeated ones too; URLs of any length are read whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"
#: Stands for a token that every URL has: rules without one of their own lie under it.
ANY = "*"
#: The rule index is broadcast only while its text is smaller than this; beyond it the join shuffles.
BROADCAST_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str = "block"

    @property
    def is_site(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    @property
    def regex(self) -> str:
        """For a site over host and path joined, else over the whole lower-cased URL."""
        body = self.name if self.is_site else self.pattern.lower().removeprefix("|")
        ends = not self.is_site and body.endswith("|")
        body = body.removesuffix("|") if ends else body
        if self.is_site:
            front = r"^(?:[^/]*\.)?"
        else:
            front = "^" if self.pattern.startswith("|") else ""
        parts = []
        for i, c in enumerate(body):
            if c == "*":
                parts.append(".*")
            elif c == "^":
                parts.append("(?:^|[^a-z0-9])" if i == 0 else "(?:[^a-z0-9]|$)")
            else:
                parts.append(c if re.fullmatch("[A-Za-z0-9/]", c) else "\\" + c)
        return front + "".join(parts) + ("$" if ends else "")

    @property
    def tokens(self) -> list[str]:
        """Tokens that any URL with this rule holds whole: nothing that ``*`` or an open end may make longer."""
        whole = self.pattern.lower()
        front = whole.startswith("|") or whole[:1] == "^"
        text = ("/" if front else "*") + whole.strip("|") + ("/" if not self.is_site and whole.endswith("|") else "*")
        return re.findall(f"(?<![a-z0-9*]){TOKEN}(?![a-z0-9*])", text)


SITE_RULES = (
    Rule("||org/", "allow"),
    Rule("||example.org/es/"),
    Rule("||example.org/en/1"),
    Rule("||com/fr/", "allow"),
    Rule("||com/de/"),
)
#: What spam puts into hosts and paths.
PATTERN_RULES = tuple(map(Rule, ("^casino^", "^cheap-*pills^", "^free-*bets^", "^online-*poker^", "^payday-*loan^", "^adult-*cam^", "^xxx^", "^warez^", "^torrent/*download^")))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substring(coalesce({url}, ''), locate('://', coalesce({url}, '')) + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return df.withColumn("host", lower_ascii(raw)).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def url_tokens(url: str = "url") -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(url)), F.lit(f"({TOKEN})"), F.lit(1)))


def rule_index(spark: SparkSession, urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (token, rule, verdict, site, regex, size): each rule under its rarest token.

    Counting touches only tokens of the rules, so what reaches the driver is bounded by the rule list.
    """
    tokens = {r: r.tokens for r in rules}
    wanted = sorted({t for x in tokens.values() for t in x})
    seen = urls.select(F.explode(url_tokens()).alias("token")).where(F.col("token").isin(wanted))
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    rows = [(min(x, key=lambda t: (counts.get(t, 0), t), default=ANY), r.name, r.verdict, r.is_site, r.regex, len(r.name)) for r, x in tokens.items()]
    return spark.createDataFrame(rows, "token string, rule string, verdict string, site boolean, regex string, size int")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """``pages`` (page_id, url) to (page_id, host, path, rule, verdict)."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url")
    named = pages.where("url IS NOT NULL")
    urls = named.select("url").distinct()
    index = rule_index(spark, urls, rules)
    small = sum(len(r.regex) + len(r.name) + 64 for r in rules) < BROADCAST_BYTES
    tokens = F.array_append(url_tokens(), F.lit(ANY)) if not all(r.tokens for r in rules) else url_tokens()
    fetched = with_parts(urls).withColumn("token", F.explode(tokens)).join(F.broadcast(index) if small else index, "token")
    subject = F.when(F.col("site"), F.concat("host", "path")).otherwise(lower_ascii(F.col("url")))
    hits = fetched.where(F.regexp(subject, F.col("regex")))
    best = hits.groupBy("url").agg(
        F.max(F.when(F.col("site"), F.struct("size", "rule", "verdict"))).alias("site"),
        F.min(F.when(~F.col("site"), F.col("verdict"))).alias("other"),  # allow comes before block
    )
    # null URLs fit no rule, and would all meet in one task of a join
    judged = with_parts(named).join(best, "url", "left").select("page_id", "host", "path", F.col("site.rule").alias("rule"), F.coalesce("site.verdict", "other", F.lit("allow")).alias("verdict"))
    nothing = F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")
    return judged.union(pages.where("url IS NULL").select("page_id", *nothing))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM q)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(low, '(^|[^a-z0-9])(casino|cheap-.*pills|free-.*bets|online-.*poker|payday-.*loan|adult-.*cam|xxx|warez|torrent/.*download)([^a-z0-9]|$)')
       THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
