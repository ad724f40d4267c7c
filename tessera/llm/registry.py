"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import impact_search, license_scan, line_dedup, lm_scoring, mixing, ngram_jaccard, packing, quality_rules, repeated_bytes, sorted_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_sorted_tables": sorted_tables.op6_sorted_tables,
    "op7_repeated_bytes": repeated_bytes.op7_repeated_bytes,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_impact_search": impact_search.op9_impact_search,
    "op10_ngram_jaccard": ngram_jaccard.op10_ngram_jaccard,
}

#: The other operators can't be expressed in SQL (or not on whole tables); tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op9_impact_search": impact_search.ORACLE,
}
