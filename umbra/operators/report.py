"""The evaluation report: at most nine metric rows and twenty examples each way come to the driver; no value does."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import location, metric_text, percent, value_shape
from ..schema import TYPES
from .evaluate import totals

EXAMPLES = 20
#: Metadata keys in the order in which they are shown.
ABOUT = ("source", "source_kind", "description", "document_stats", "category_counts", "annotation_policy", "limitations")


def described(items: DataFrame) -> Column:
    """type | shape | at place | via detector."""
    have = items.columns
    col = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    place = F.coalesce(F.nullif(location(col("unit_id"), col("location"), col("part")), F.lit("")), F.lit("unknown"))
    via = F.when(F.coalesce(col("detector"), F.lit("")) != "", F.concat(F.lit("via "), col("detector")))
    return F.concat_ws(" | ", F.coalesce(col("type"), F.lit("?")), value_shape(F.coalesce(col("text"), F.lit(""))), F.concat(F.lit("at "), place), via)


def examples(items: DataFrame) -> list[str]:
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.upper("type"))
    return [r[0] for r in items.orderBy(order, "id").limit(EXAMPLES).select(described(items)).collect()]


def render(metrics: DataFrame, missed: DataFrame, wrong: DataFrame, metadata: dict | None = None) -> str:
    cells = ["ground_truth", "detected", "TP", "FP", "FN"]
    ratios = [metric_text(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")]
    rows = {r["type"]: r for r in metrics.select("type", *cells, *ratios).collect()}
    total = totals(metrics)
    t = total.select(*cells, *(percent(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy"))).first()
    shown = {k: v for k, v in (metadata or {}).items() if k in ABOUT}
    about = []
    for k in ABOUT:
        if k in shown:
            v = shown[k]
            about += [f"- **{k}:**", "```json", *json.dumps(v, ensure_ascii=False, indent=2).splitlines(), "```"] if isinstance(v, (dict, list)) else [f"- **{k}:** {v}"]
    table = ["| Category | Ground truth | Detected | TP | FP | FN | Precision | Recall | F1 | Accuracy |", "| --- " + "| ---: " * 9 + "|"]
    for kind in TYPES:
        r = rows[kind]
        last = [r["precision"], r["recall"], r["f1"], r["accuracy"]] if r["ground_truth"] else ["N/A (no instances)"] * 3 + ["N/A"]
        table.append("| " + " | ".join(map(str, [kind, *(r[c] for c in cells), *last])) + " |")
    fp, fn = examples(wrong), examples(missed)
    sections = {
        "1. Summary": [f"{t['ground_truth']} annotations, {t['detected']} predictions: {t['TP']} TP, {t['FP']} FP, {t['FN']} FN."],
        "2. Data": about or ["- No metadata was given."],
        "3. Method": ["A prediction matches an annotation of the same category and normalised text whose place and context, where given, agree; each counts once. Accuracy is TP / (annotations + FP)."],
        "4. Results": table,
        "5. Overall": [f"- {name}: {t[c]}" for name, c in (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"))],
        "6. Errors": ["Values are never printed, only category, shape, size and place.", "", f"False positives ({t['FP']}):", *(f"- {x}" for x in fp), "", f"False negatives ({t['FN']}):", *(f"- {x}" for x in fn)],
        "7. Limits": ["Patterns miss unusual separators; names without context need a model; multi-line addresses may be missed; birth dates need a label; PDF output keeps pages, not layout."],
    }
    return "\n".join(["# Evaluation of personal data detection", *(line for title, body in sections.items() for line in ("", f"## {title}", "", *body)), ""])
