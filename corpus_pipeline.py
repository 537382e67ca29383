"""The corpus pipeline: each stage gets what the one before it kept, and returns a DataFrame.

STAGES are (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.
Null ids and texts, empty tables, repeated rows and extra columns are treated as the operators' docstrings say; a null
text is kept by every filter that finds nothing in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import bpe, decontam, pii, quality, similar
from umbra.llm.common import bounded_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the ordinal regression grades best."""
    return quality.select(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of similar texts: SimHash fingerprints within 2 bits, found by BK-trees, and what
    these miss by the Jaccard of whole shingle sets (five words, 0.8)."""
    bounded_batches(spark)
    return similar.representatives(docs, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of personal data; n_chars follows where the table has it."""
    from pyspark.sql import functions as F

    bounded_batches(spark)
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they decode to."""
    import public_tokenizers

    from pyspark.sql import functions as F

    bounded_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, raw="decoded")
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", bpe_stage),
]

#: Trained models, edit distances and merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
