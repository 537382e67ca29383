"""Units from tables of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of few splits, as a single small file is, dealt out to all cores; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join of units or of what was found in them: the join is by sorting, on the executors. What ``explode`` makes of
    a row is planned as one row, so a table of a few MB would be sent through the driver with all its units."""
    return df.hint("merge")


def apart(df: DataFrame) -> DataFrame:
    """The same rows as a frame whose plan is a leaf; shuffles below it run now. What is persisted still stands in each plan that reads
    it, once for each use, and the driver keeps such plans and their texts anew with each stage that ends."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)


def unit_id(part: Column, seq: Column) -> Column:
    return F.concat(part, F.lit(":p"), F.format_string("%04d", seq))


def lines(df: DataFrame, id_column: str, text: Column, part: str) -> DataFrame:
    """A unit for each line of ``text``, empty ones too, so that ids stay dense."""
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("seq", "text"))
    return rows.select("doc_id", F.lit(part).alias("part"), unit_id(F.lit(part), F.col("seq")).alias("unit_id"), "seq", "text")


def document_units(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", F.col("text"), "body")


def stripped(html: Column) -> Column:
    """Markup as spaces; scripts and styles with what they hold."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")


def page_units(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spread(table(spark, folder, "pages").select("page_id", "html")), "page_id", stripped(F.col("html")), "page")


def turn_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    seq = F.col("turn").cast("int")
    return rows.select(F.col("conv_id").cast("long").alias("doc_id"), F.lit("turn").alias("part"), unit_id(F.lit("turn"), seq).alias("unit_id"), seq.alias("seq"), "text", "role")


def full_text(units: DataFrame) -> DataFrame:
    """(doc_id, text): the units of a document joined by lines, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return units.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda u: F.coalesce(u["text"], F.lit(""))), "\n").alias("text"))
