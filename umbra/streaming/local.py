"""Detection on streams, and as functions of SQL.

Local detection has no state, so it runs on a stream of units as it stands. What needs a whole document (context,
propagation, serials) runs on each micro-batch, where a source delivers a document's units together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..plans.redaction import redact_units


def detect_stream(units: DataFrame, contextual: bool = True) -> DataFrame:
    """A streaming DataFrame of units to one with ``spans``."""
    return detect(units, contextual)


def redact_stream(units: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, contextual: bool = True):
    """Starts a query that redacts each micro-batch and hands it to ``sink`` with its number."""

    def each(batch: DataFrame, number: int) -> None:
        done = redact_units(batch, contextual=contextual)
        sink(done.units, number)
        done.release()

    return units.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def register(spark: SparkSession) -> None:
    """``detect_pii(text)`` for LATERAL joins: (type, start, end, text, score, detector) of contextual values, and
    ``redact(text)``: the text with its contextual values as their types in brackets. Structured values are column
    expressions, which SQL has as views over ``detect``; of overlapping values the more important stays."""
    from ..operators.contextual import addresses, organisations, persons
    from ..operators.propagate import Found, resolved

    def spans(text: str | None) -> list[Found]:
        found = [s for find in (addresses, organisations, persons) for s in find(text or "")]
        return resolved(Found(s.type, s.start, s.end, text[s.start : s.end], s.score, s.detector, None) for s in found)

    class DetectPii:
        def eval(self, text: str):
            for s in spans(text):
                yield s.type, s.start, s.end, s.text, s.score, s.detector

    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(cleaned)

    def cleaned(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s in spans(text):
            out += [text[at : s.start], f"[{s.type}]"]
            at = s.end
        return "".join([*out, text[at:]])

    redact.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udtf = F.udtf(DetectPii, returnType="type string, start int, end int, text string, score double, detector string")
    spark.udtf.register("detect_pii", udtf)
    spark.udf.register("redact", F.pandas_udf(redact, "string"))


def structured_view(spark: SparkSession, units: DataFrame, name: str) -> None:
    """A view of units with ``spans`` of all nine types, for SQL."""
    detect(units).createOrReplaceTempView(name)
