"""The pN_ queries: each takes (spark, data_dir) and runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, canonical, chunking, language, mixing, pairs, scans, spans
from leafmill.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.found(table(spark, d, "pages"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "pages").select("row_id", "path", "page", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(table(spark, d, "pages"), table(spark, d, "marks"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_form(canonical.rows_of(table(spark, d, "pages"), table(spark, d, "marks"))).drop("text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "messages"), table(spark, d, "lang_samples"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flag(table(spark, d, "messages"), table(spark, d, "lang_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "pages"), table(spark, d, "lang_samples"))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("row_id", F.col("lang").alias("label"), "text")
    return language.segments(pages, language.model_of(table(spark, d, "lang_samples")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(table(spark, d, "pages"))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "pages"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are not their text: none."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("was"))
    return bpe.decode(bpe.encode(docs)).where(F.xxhash64("text") != F.col("was")).select("doc_id")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.found(table(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.passages(table(spark, d, "documents"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}
