"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from cellarium.llm import decontamination, jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, run_length_index, sharding, url_filters


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.query,
        "op2_suffix_array_dedup": run_length_index.query,
        "op3_decontamination": decontamination.query,
        "op4_url_filters": url_filters.query,
        "op6_quality_rules": quality_rules.query,
        "op5_language_id": language_id.query,
        "op7_quality_classifier": quality_classifier.query,
        "op8_best_fit_packing": packing.query,
        "op9_jaccard_join": jaccard_join.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.sql(),
        "op3_decontamination": decontamination.sql(),
        "op4_url_filters": url_filters.sql(),
        "op6_quality_rules": quality_rules.sql(),
        "op9_jaccard_join": jaccard_join.sql(),
    }
