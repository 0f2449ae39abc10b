"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, chat, contamination, langid, line_dedup, mixing, packing, periodic, quality, simhash, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (toxicity.op1_toxicity, simhash.op2_simhash_dedup, chat.op3_chat_format, line_dedup.op4_line_dedup, mixing.op5_source_mixing, quality.op6_quality_rules, substring.op7_substring_dedup, ann.op8_nearest_neighbours, langid.op9_language_id, packing.op10_best_fit_packing, periodic.op11_periodic_runs, contamination.op12_benchmark_decontamination, audit.op13_filter_audit)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat.OP3_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op5_source_mixing": mixing.OP5_SQL, "op6_quality_rules": quality.OP6_SQL, "op7_substring_dedup": substring.OP7_SQL, "op12_benchmark_decontamination": contamination.OP12_SQL, "op13_filter_audit": audit.OP13_SQL}
