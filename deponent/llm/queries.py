"""Queries of the text operators for the driver; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.llm import entities, leaks, packing, privacy, quality, scans, turns
from deponent.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found_defects(table(spark, d, "mass_extract"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "mass_extract"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.linked_pairs(table(spark, d, "mass_extract"), table(spark, d, "case_participants"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.entities(table(spark, d, "mass_extract"), table(spark, d, "case_participants"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_starts(table(spark, d, "audio_utils"), table(spark, d, "recordings"))


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "audio_utils"), table(spark, d, "recordings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The five types of the problem; numbers of accounts and cards are only replaced."""
    return privacy.personal_data(table(spark, d, "mass_extract"), table(spark, d, "case_participants")).filter("pii_type <> 'account'").select("row_id", "pii_type", "start_pos")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redacted(table(spark, d, "mass_extract"), table(spark, d, "case_participants"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers hold how many tenths of their capacity."""
    filled = packing.packed(table(spark, d, "documents")).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return filled.groupBy(F.floor(F.col("n") * 10 / packing.CAPACITY).cast("int").alias("tenths")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("n").alias("tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.structural_documents(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_entities, p3_found, p3_turns, p5_found, p5_redacted, p6_packed, p6_fill, p7_found, p8_found, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    """None: the operators train models, search or parse; tests hold them against brute force, round trips and held-out cases."""
    return {}
