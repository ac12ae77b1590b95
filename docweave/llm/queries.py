"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import best_fit_packing, decontamination, filter_audit, importance_resampling, language_id, line_dedup, lm_scoring, pii, quality_rules, secret_scan, sharding, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_decontamination": decontamination.op2_decontamination,
    "op2_proximity": decontamination.op2_proximity,
    "op3_language_id": language_id.op3_language_id,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_simhash": simhash.op5_simhash,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_best_fit_packing": best_fit_packing.op10_best_fit_packing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_pii": pii.op12_pii,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = decontamination.ORACLE | line_dedup.ORACLE | filter_audit.ORACLE
