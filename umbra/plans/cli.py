"""Command line: redact packages, score and verify."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.evaluate import by_type, unmatched
from ..operators.report import render
from ..operators.verify import summary
from ..sources import docx, pdf
from ..sources.jsonio import prediction_file, read_annotations, read_source
from .redaction import redact_units


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="umbra", description="Redact personal data in DOCX packages or PDF pages.")
    p.add_argument("--input", required=True, help="file or folder of .docx or .pdf")
    p.add_argument("--output", required=True, help="folder of the redacted units (Parquet) and packages")
    p.add_argument("--predictions", help="folder of the prediction files (JSON lines)")
    p.add_argument("--ground-truth", help="annotations (JSON)")
    p.add_argument("--report", help="evaluation report (Markdown)")
    p.add_argument("--seed", type=int, default=1337, help="shifts the serial numbers from which replacements are made; 1337 shifts by none")
    p.add_argument("--model", help="module:function that loads a named-entity model, a callable from text to (label, start, end)")
    p.add_argument("--no-spacy", action="store_true", help="rules only, whatever --model says")
    p.add_argument("--include-examples", action="store_true", help="unmatched values in the result, for local use only")
    return p


def model_loader(name: str | None):
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function or "load")


def of_document(truth: DataFrame, source: str | None, packages: DataFrame) -> DataFrame:
    """Annotations with the document that they are of: their own doc_id, the package that ``source`` names, or the only one."""
    if truth.where("doc_id IS NOT NULL").limit(1).count():
        return truth
    names = packages.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    named = names.where(F.col("name") == (source or "").rsplit("/", 1)[-1]).limit(2).collect() or names.limit(2).collect()
    if len(named) != 1:
        raise ValueError("the annotations name none of the documents")
    return truth.withColumn("doc_id", F.lit(named[0]["doc_id"]))


def with_examples(result: dict, missed: DataFrame, wrong: DataFrame, most: int = 20) -> None:
    for name, items in (("missed", missed), ("wrong", wrong)):
        result[f"{name}_examples"] = [r.asDict() for r in items.orderBy("doc_id", "id").limit(most).select("type", "text", "unit_id").collect()]


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    if args.input.rstrip("/") == args.output.rstrip("/"):
        raise ValueError("input and output are the same")
    kind = args.input.rsplit(".", 1)[-1].lower() if "." in args.input.rsplit("/", 1)[-1] else "docx"
    if kind not in ("docx", "pdf"):
        raise ValueError(f"unsupported input: .{kind}")
    packages = docx.files(spark, args.input, f"*.{kind}")
    is_docx = kind == "docx"
    units = docx.read_units(packages) if is_docx else pdf.read_units(packages)
    done = redact_units(units, context=is_docx, spread=is_docx, load_model=None if args.no_spacy else model_loader(args.model), seed=args.seed)
    done.units.write.mode("errorifexists").parquet(f"{args.output}/units")
    members = None
    # pages of a PDF become a package with a heading for each page
    made = docx.write_packages(packages, done.replaced) if is_docx else docx.page_packages(packages.select("path"), done.units)
    made.write.parquet(f"{args.output}/packages")
    if is_docx:
        members = docx.read_members(spark.read.parquet(f"{args.output}/packages"))
    if args.predictions:
        prediction_file(done.entities, args.input, args.output, args.seed).write.mode("overwrite").json(args.predictions)
    redacted = spark.read.parquet(f"{args.output}/units")
    result = summary(done.entities, redacted, members).first().asDict()
    if args.ground_truth:
        truth = read_annotations(spark, args.ground_truth)
        # predictions of a document are numbered in reading order
        found = done.entities.withColumn("id", F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "start", "end", "type")))
        truth = of_document(truth, read_source(spark, args.ground_truth), packages)
        metrics = by_type(truth, found)
        missed, wrong = unmatched(truth, found)
        if args.include_examples:
            with_examples(result, missed, wrong)
        if args.report:
            with open(args.report, "w", encoding="utf-8") as f:
                f.write(render(metrics, missed, wrong))
        result["metrics"] = [r.asDict() for r in metrics.collect()]
    return result


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("umbra").getOrCreate()
    try:
        result = run(args, spark)
    except (ValueError, RuntimeError) as e:
        p.error(str(e))
    print(json.dumps(result, ensure_ascii=False))
    return 0 if result["passed"] else 1


if __name__ == "__main__":
    sys.exit(main())
