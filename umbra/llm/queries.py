"""The queries of this folder over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge

    return judge(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    from .quality import select

    kept = select(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", F.round("expected_grade", 9).alias("expected_grade"), F.round("p_best", 9).alias("p_best"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .annindex import search

    return search(table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_simhash": op4_simhash,
        "op5_url_filter": op5_url_filter,
        "op6_token_counts": op6_token_counts,
        "op7_quality": op7_quality,
        "op8_neighbours": op8_neighbours,
        "op9_pii": op9_pii,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    """Models, merges of tokenizers, hashes that SQL lacks and approximate search have none; tests hold them otherwise."""
    from .suffixdedup import ORACLE as op3
    from .urlfilter import ORACLE as op5

    return {"op3_suffix_dedup": op3, "op5_url_filter": op5}
