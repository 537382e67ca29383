"""JSON and JSONL: annotations, predictions, annotation chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import location
from ..schema import ANNOTATION

ITEM = "doc_id long, type string, text string, unit_id string, location string, part string, start int, end int, context string, score double, detector string, identity string"


def read_items(spark: SparkSession, path: str, under: str) -> DataFrame:
    """Items of a file that is a list, or an object with the list ``under`` a key."""
    whole = spark.read.text(path, wholetext=True)
    array, nested = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>", under
    as_list = F.from_json("value", array)
    as_object = F.from_json("value", f"struct<{nested}:{array}>")[nested]
    is_list = F.ltrim("value").startswith("[")
    return whole.select(F.posexplode(F.when(is_list, as_list).otherwise(as_object)).alias("id", "x")).select(F.col("id").cast("long").alias("id"), "x.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_items(spark, path, "annotations")


def read_source(spark: SparkSession, path: str) -> str | None:
    """The document that a file of annotations says it is of; null for a list."""
    return spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.source")).first()[0]


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_items(spark, path, "predictions")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Records of gt_*.jsonl with the file they came from; a line that is no JSON object fails the read."""
    lines = spark.read.option("pathGlobFilter", "gt_*.jsonl").text(path).withColumn("file", F.col("_metadata.file_name"))
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    parsed = lines.where(line != "").withColumn("x", F.from_json(line, ANNOTATION + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("x").isNull() | F.col("x._corrupt_record").isNotNull()
    # the file only: a message must not hold a value
    record = F.when(bad, F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("file")))).otherwise(F.col("x"))
    return parsed.select("file", record.alias("x")).select("file", "x.unit_id", "x.type", "x.text")


def write_predictions(entities: DataFrame, path: str) -> None:
    """One object a line, with the public names."""
    place = location(F.col("unit_id"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    entities.select("doc_id", "text", "type", "start", "end", place.alias("part"), "context", "score", "detector", "identity").write.json(path)


def prediction_file(entities: DataFrame, source: str, output: str, seed: int = 1337) -> DataFrame:
    """One row for each document: header and the list of its predictions, in order."""
    item = F.struct("seq", "start", "end", "text", "type", F.col("unit_id").alias("part"), "context", "score", "detector", "identity")
    rows = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    listed = F.transform("p", lambda p: p.dropFields("seq"))
    return rows.select("doc_id", F.lit(source).alias("source"), F.lit(output).alias("output"), F.lit(seed).alias("seed"), F.size("p").alias("prediction_count"), listed.alias("predictions"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Units for review, a folder for each document and chunk; ``chunks`` has the column chunk."""
    chunks.select("doc_id", "chunk", "unit_id", "seq", "text").sortWithinPartitions("doc_id", "chunk", "seq").write.partitionBy("doc_id", "chunk").json(path)
