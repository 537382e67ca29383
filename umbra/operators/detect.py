"""The façade over all detectors: units to units with resolved spans, and to one row for each entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import resolve, snippet
from ..schema import SPANS
from .contextual import contextual_udf, worth
from .structured import births, births_after, lead_line, structured


def with_context(units: DataFrame, window: int = 2, size: int = 800) -> DataFrame:
    """Adds ``context``: the texts of the ``window`` units before, joined by lines, its last ``size`` characters."""
    w = W.partitionBy("doc_id").orderBy("seq")
    before = [F.nullif(F.lag("text", k).over(w), F.lit("")) for k in range(window, 0, -1)]
    return units.withColumn("context", F.right(F.concat_ws("\n", *before), F.lit(size)))


def detect(units: DataFrame, contextual: bool = True, load_model: Callable | None = None) -> DataFrame:
    """Adds ``spans``, resolved. Uses the column ``context`` where the units have one.

    What several expressions use is a column of its own, in a projection below theirs: written in place it would be
    copied, and evaluated, once for each use.
    """
    own = units.columns
    staged = units.withColumn("_text", F.coalesce("text", F.lit("")))
    if "context" in own:
        staged = staged.withColumn("_lead", lead_line(F.coalesce("context", F.lit(""))))
        staged = staged.withColumn("_whole", F.concat("_lead", "_text")).withColumn("_cut", F.length("_lead"))
        dates = births_after(F.col("_whole"), F.col("_cut"))
    else:
        dates = births(F.col("_text"))
    staged = staged.withColumn("_found", structured(F.col("_text"), dates))
    if contextual:
        context = F.coalesce("context", F.lit("")) if "context" in own else F.lit("")
        staged = staged.withColumn("_kinds", worth(F.col("_text"), context))
        # the UDF sees only texts that can hold a contextual value; the others, and their context, are null to it
        seen = F.lit(True) if load_model else F.col("_kinds") > 0
        staged = staged.withColumn("_more", contextual_udf(load_model)(F.when(seen, F.col("_text")), F.when(seen, context), F.col("_kinds")))
        staged = staged.withColumn("_found", F.concat("_found", F.coalesce("_more", F.array().cast(SPANS))))
    return staged.withColumn("spans", resolve(F.col("_found"))).select(*[c for c in own if c != "spans"], "spans")


def entities(units: DataFrame) -> DataFrame:
    """One row for each span of units with ``spans``."""
    rows = units.select("doc_id", "unit_id", "seq", F.col("text").alias("unit_text"), F.explode("spans").alias("s"))
    around = snippet(F.col("unit_text"), F.col("s.start"), F.col("s.end"))
    return rows.select("doc_id", "unit_id", "seq", "s.type", "s.start", "s.end", "s.text", around.alias("context"), "s.score", "s.detector", "s.identity")
