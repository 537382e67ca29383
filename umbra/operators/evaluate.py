"""Entity-level scores, and checks of annotations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import SWEEP_EMAIL, SWEEP_PHONE
from ..functions.scalars import audit_shape, location, normal_text, occurrences, split_location
from ..functions.spans import as_spans, find, words
from ..schema import TYPES
from ..sources.tables import shuffled


#: Stand for a document where the items tell none, and where one item's is null.
ANY, NONE = -(1 << 63), -(1 << 63) + 1


def document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))


def place_keys(*frames: DataFrame) -> list[str]:
    """What names a unit: its document too, where all of the frames tell it."""
    return [c for c in ("doc_id", "unit_id") if c == "unit_id" or all(c in f.columns for f in frames)]


def checked(items: DataFrame, by_document: bool) -> DataFrame:
    """Items with every column that matching needs; an unknown type is an error."""
    have = items.columns
    col = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    kind = F.upper(F.col("type"))
    kind = F.when(kind.isin(*TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(F.col("type"), F.lit("null")))))
    place = F.regexp_replace(location(col("unit_id"), col("location"), col("part")), "^/+", "")
    part, unit = split_location(place)
    return items.select(
        (document() if by_document else F.lit(ANY)).cast("long").alias("doc_id"),
        F.col("id").cast("long").alias("id"), kind.alias("type"), normal_text(col("text")).alias("norm"),
        place.alias("place"), part.alias("part_name"), unit.alias("unit_name"), normal_text(col("context")).alias("context"),
    )


GROUP = ("doc_id", "type", "norm", "part_name", "unit_key")


def matches(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(doc_id, truth_id, prediction_id): each item at most once. Both have ``id`` in their order, type and text, and may
    have doc_id, unit_id, location, part and context. Items of different documents never match; where not both sides tell the
    document, all are of one (doc_id ``ANY``).

    Candidates agree in document, type, normalised text, part and unit (where both have one) and context (where both have one).
    The best scored come first, then by order; the score depends on the truth row alone. Where all items of one text in a part
    name their unit and none a context, the k-th of a unit matches the k-th: a join on rank. The others, whose fit is no equality,
    are folded in order, a group for each text in a part.
    """
    by_document = "doc_id" in place_keys(truth, predictions)
    both = checked(truth, by_document).withColumn("is_truth", F.lit(True)).unionByName(checked(predictions, by_document).withColumn("is_truth", F.lit(False)))
    in_part = W.partitionBy("doc_id", "type", "norm", "part_name")
    both = both.withColumn("unit_key", F.when(F.min(F.length("unit_name")).over(in_part) > 0, F.col("unit_name")).otherwise(""))
    both = both.withColumn("by_rank", (F.col("unit_key") != "") & (F.max(F.length("context")).over(W.partitionBy(*GROUP)) == 0))
    ranked = both.where("by_rank").withColumn("rank", F.row_number().over(W.partitionBy(*GROUP, "is_truth").orderBy("id")))
    side = lambda f, name: ranked.where(f).select(*GROUP, "rank", F.col("id").alias(name))
    equal = side("is_truth", "truth_id").join(shuffled(side("NOT is_truth", "prediction_id")), [*GROUP, "rank"]).select("doc_id", "truth_id", "prediction_id")

    def fits(a, b) -> bool:
        units = not a.unit_name or not b.unit_name or a.unit_name == b.unit_name
        contexts = not a.context or not b.context or a.context in b.context or b.context in a.context
        return units and bool(a.place) == bool(b.place) and contexts

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.itertuples())
        free = dict(enumerate(sorted((x for x in rows if not x.is_truth), key=lambda x: x.id)))
        out = []
        for a in sorted((x for x in rows if x.is_truth), key=lambda x: (-(10 * bool(x.place) + 5 * bool(x.context)), x.id)):
            k = next((k for k, b in free.items() if fits(a, b)), None)
            if k is not None:
                out.append((a.doc_id, a.id, free.pop(k).id))
        return pd.DataFrame(out, columns=["doc_id", "truth_id", "prediction_id"])

    rest = both.where("NOT by_rank").groupBy(*GROUP).applyInPandas(fold, "doc_id long, truth_id long, prediction_id long")
    return equal.unionByName(rest)


def with_matches(items: DataFrame, matched: DataFrame, name: str, how: str, by_document: bool) -> DataFrame:
    """Items semi- or anti-joined with their side of the matches. The document is part of the key where matches tell it, since
    ids may start again in each."""
    m = matched.select(F.col("doc_id").alias("_doc"), F.col(name).alias("_id"))
    own = document() if by_document else F.lit(ANY)
    return items.join(shuffled(m), (F.col("id") == F.col("_id")) & (F.col("_doc") == own), how)


def ratio(a: Column, b: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(b > 0, a / b)


def with_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    p, r = F.col("precision"), F.col("recall")
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return out.withColumn("f1", f1).withColumn("accuracy", ratio(tp, tp + fp + fn))


def _ordered_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TYPES], "type string")


def by_type(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row for each of the nine types."""
    spark = truth.sparkSession
    kind = F.upper("type").alias("type")
    hit = with_matches(truth, matches(truth, predictions), "truth_id", "left_semi", "doc_id" in place_keys(truth, predictions)).groupBy(kind).agg(F.count("*").alias("TP"))
    n_truth = truth.groupBy(kind).agg(F.count("*").alias("ground_truth"))
    n_found = predictions.groupBy(kind).agg(F.count("*").alias("detected"))
    rows = _ordered_types(spark).join(n_truth, "type", "left").join(n_found, "type", "left").join(hit, "type", "left").fillna(0)
    return with_ratios(rows.select("type", "ground_truth", "detected", "TP", (F.col("detected") - F.col("TP")).alias("FP"), (F.col("ground_truth") - F.col("TP")).alias("FN")))


def totals(metrics: DataFrame) -> DataFrame:
    return with_ratios(metrics.agg(*(F.sum(c).alias(c) for c in ("ground_truth", "detected", "TP", "FP", "FN"))))


def unmatched(truth: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(truth without a prediction, predictions without a truth)."""
    m, by_document = matches(truth, predictions), "doc_id" in place_keys(truth, predictions)
    return with_matches(truth, m, "truth_id", "left_anti", by_document), with_matches(predictions, m, "prediction_id", "left_anti", by_document)


# ---- checks of annotations ----------------------------------------------------------------------------------------


def uncovered(spans: DataFrame, by: DataFrame) -> DataFrame:
    """Spans (unit_id, type, start, end) that no span of the same unit and type in ``by`` overlaps."""
    on = [*place_keys(spans, by), "type"]
    a, b = spans.alias("a"), by.select(*on, "start", "end").alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on))
    return a.join(b, same & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")), "left_anti")


def sweep(units: DataFrame) -> DataFrame:
    """Everything shaped like an e-mail address or a phone number, by looser shapes than the detectors'."""
    text = F.coalesce("text", F.lit(""))
    shaped = F.concat(as_spans(find(text, words(SWEEP_EMAIL), "@"), "EMAIL", "sweep"), as_spans(find(text, words(SWEEP_PHONE)), "PHONE", "sweep"))
    rows = units.select(*place_keys(units), F.explode(shaped).alias("s"))
    out = rows.select(*place_keys(units), "s.type", "s.start", "s.end", F.trim("s.text").alias("text"))
    return out.where((F.col("type") == "EMAIL") | F.regexp_replace("text", r"(?U)\D", "").rlike(r"(?U)\d{3}"))


def audit_gaps(units: DataFrame, annotations: DataFrame) -> DataFrame:
    return uncovered(sweep(units), annotations).withColumn("shape", audit_shape(F.col("text"))).drop("text")


def with_unit_text(items: DataFrame, units: DataFrame) -> DataFrame:
    """Items with the text of their unit; null where there is none."""
    on = place_keys(items, units)
    return items.join(units.select(*on, F.col("text").alias("unit_text")), on, "left")


def located(predictions: DataFrame, units: DataFrame) -> DataFrame:
    """Predictions at the first place of their text in their unit; ``start`` is null where it is not there."""
    rows = with_unit_text(predictions.drop("start", "end"), units)
    at = F.instr(F.coalesce("unit_text", F.lit("")), F.col("text")) - 1
    start = F.when(at >= 0, at)
    return rows.withColumn("start", start).withColumn("end", start + F.length("text")).drop("unit_text")


def audit_predictions(predictions: DataFrame, units: DataFrame, annotations: DataFrame) -> DataFrame:
    """Predictions that no annotation meets, with the reason."""
    rows = located(predictions, units)
    lost = rows.where("start IS NULL").withColumn("reason", F.lit("span not found in source unit"))
    alone = uncovered(rows.where("start IS NOT NULL"), annotations).withColumn("reason", F.lit("no annotation overlaps this span"))
    return lost.unionByName(alone)


def audit_misses(predictions: DataFrame, units: DataFrame, annotations: DataFrame) -> DataFrame:
    return uncovered(annotations, located(predictions, units).where("start IS NOT NULL"))


def audit_summary(predictions: DataFrame, units: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: annotations by type, shapes without an annotation and their units, predictions and annotations alone."""
    gaps = audit_gaps(units, annotations)
    kinds = annotations.groupBy("type").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "type", F.col("n").cast("string")))).alias("annotations"))
    where = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("unit_id"))))
    found = gaps.agg(*(f for k in ("EMAIL", "PHONE") for f in (F.count_if(F.col("type") == k).alias(f"{k.lower()}_gaps"), where(k).alias(f"{k.lower()}_units"))))
    alone = audit_predictions(predictions, units, annotations).agg(F.count("*").alias("unmatched_predictions"))
    missed = audit_misses(predictions, units, annotations).agg(F.count("*").alias("missed_annotations"))
    return kinds.crossJoin(found).crossJoin(alone).crossJoin(missed)  # one row each


def validate(annotations: DataFrame, units: DataFrame) -> DataFrame:
    """Annotations with a ``problem``: null where the offsets give back the text."""
    rows = with_unit_text(annotations, units)
    there = F.expr("substring(unit_text, start + 1, end - start)") == F.col("text")
    problem = F.when(F.col("unit_text").isNull(), "unknown unit").when(~F.coalesce(there, F.lit(False)), "text differs")
    return rows.withColumn("problem", problem).drop("unit_text")


MERGED_TYPES = ("PERSON", "ORG", "ADDRESS", "EMAIL", "PHONE")


def merge(records: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (id, unit_id, type, text) to (annotations with offsets, rejected records with a reason, dropped annotations).

    In order of id each record takes a place of its text that no equal span of its unit and type has; of several the
    first that no sentence mark precedes. A span inside a longer one of its unit and type is then dropped. ``in_order`` sorts
    what is kept, ``dropped_examples`` shows the first of the others.
    """
    on = place_keys(records, units)
    rows = with_unit_text(records, units)
    reason = (
        F.when(~F.coalesce(F.col("type").isin(*MERGED_TYPES), F.lit(False)), "bad type")
        .when(F.col("unit_text").isNull(), "unknown unit")
        .when((F.coalesce(F.col("text"), F.lit("")) == "") | ~F.contains("unit_text", "text"), "not found")
    )
    rows = rows.withColumn("reason", reason)
    placed = rows.where("reason IS NULL").select("id", *on, "type", "text", "unit_text", occurrences(F.col("unit_text"), F.col("text")).alias("places"))
    columns = ["id", *on, "type", "text", "start"]

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[tuple[int, int]] = set()
        starts = []
        pdf = pdf.sort_values("id")
        for text, unit, places in zip(pdf["text"], pdf["unit_text"], pdf["places"]):
            free = [int(p) for p in places if (p, p + len(text)) not in taken]
            open_ = [p for p in free if unit[p - 1 : p] not in tuple(".;:!?") or p == 0]
            start = (open_ or free or [-1])[0] if len(free) != 1 else free[0]
            if start >= 0:
                taken.add((start, start + len(text)))
            starts.append(start)
        return pdf.assign(start=starts)[columns]

    schema = T.StructType([*placed.select(columns[:-1]).schema.fields, T.StructField("start", T.IntegerType())])
    got = placed.groupBy(*on, "type").applyInPandas(take, schema)
    spans = got.where("start >= 0").withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    outer = spans.select(*on, "type", F.col("start").alias("_a"), F.col("end").alias("_z")).distinct()
    # one row for each span, whatever number of longer ones it lies in
    inside = spans.join(outer, [*on, "type"]).where("_a <= start AND end <= _z AND _z - _a > end - start").select("id", *on).distinct()
    kept, dropped = (spans.join(inside, ["id", *on], how) for how in ("left_anti", "left_semi"))
    late = got.where("start < 0").select("id", *on, "type", "text", F.lit("not found").alias("reason"))
    return kept, rows.where("reason IS NOT NULL").select("id", *on, "type", "text", "reason").unionByName(late), dropped


def in_order(annotations: DataFrame) -> DataFrame:
    """Annotations in their total order."""
    return annotations.orderBy(*place_keys(annotations), "start", "end", "type", "text")


def dropped_examples(dropped: DataFrame, most: int = 40) -> DataFrame:
    """The first dropped annotations, for a report."""
    on = place_keys(dropped)
    return dropped.orderBy(*on, "type", "start", F.desc("end"), "id").limit(most).select(*on, "type", "text")


def chunked(units: DataFrame, most: int = 24_000, extra: int = 40) -> DataFrame:
    """Non-blank units with ``chunk``: a chunk closes when the sizes of its units, with ``extra`` for each, reach ``most``.

    The sum starts anew after each close, so it is a fold over a document's units in order.
    """
    rows = units.where(F.col("text").rlike(r"(?U)\S"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        chunk, size, out = 0, 0, []
        for n in pdf["size"]:
            out.append(chunk)
            size += n + extra
            if size >= most:
                chunk, size = chunk + 1, 0
        return pdf.assign(chunk=out)[["doc_id", "seq", "chunk"]]

    sized = rows.select("doc_id", "seq", F.length("text").alias("size"))
    return rows.join(sized.groupBy("doc_id").applyInPandas(fold, "doc_id long, seq int, chunk int"), ["doc_id", "seq"])


def chunk_manifest(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id", "chunk").agg(
        F.count("*").alias("units"), F.sum(F.length("text")).alias("chars"), F.min_by("unit_id", "seq").alias("first_id"), F.max_by("unit_id", "seq").alias("last_id")
    )
