"""Queries over the corpus tables, one or more per operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, embedding_dedup, jaccard_join, language_id, license_scan, quality_rules, source_mixing, substring_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.query,
        "op2_warc_revisits": warc.query,
        "op3_jaccard_join": jaccard_join.query,
        "op4_quality_rules": quality_rules.query,
        "op5_byte_bpe": bpe.query,
        "op6_embedding_dedup": embedding_dedup.query,
        "op7_vp_tree_search": ann.query,
        "search_without_relaxation": ann.exact_query,
        "op8_source_mixing": source_mixing.query,
        "op9_license_scan": license_scan.query,
        "source_targets": source_mixing.targets_query,
        "op10_substring_dedup": substring_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_revisits": warc.ORACLE,
        "op3_jaccard_join": jaccard_join.ORACLE,
        "op6_embedding_dedup": embedding_dedup.ORACLE,
        "search_without_relaxation": ann.EXACT_ORACLE,
        "op9_license_scan": license_scan.ORACLE,
        "source_targets": source_mixing.TARGETS_ORACLE,
        "op10_substring_dedup": substring_dedup.ORACLE,
    }
