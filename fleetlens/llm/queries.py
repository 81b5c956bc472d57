"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import byte_bpe, decontaminate, katz_lm, language_id, line_dedup, near_dedup, quality_rules, substring_dedup, token_counts, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_katz_lm": katz_lm.op6_katz_lm,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_language_id": language_id.op8_language_id,
    "op9_token_files": token_files.op9_token_files,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
