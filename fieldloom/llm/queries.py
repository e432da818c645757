"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_extraction, jaccard_join, language_id, merkle_manifest, packing, pii, quality_classifier, quality_rules, sharding, spelling_variants, substring_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_jaccard_join": jaccard_join.query,
    "op3_token_counts": token_counts.query,
    "op4_decontamination": decontamination.query,
    "op5_packing": packing.query,
    "op6_html_extraction": html_extraction.query,
    "op7_sharding": sharding.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_pii": pii.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_merkle_manifest": merkle_manifest.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_language_id": language_id.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle_sql(),
    "op11_merkle_manifest": merkle_manifest.oracle_sql(),
    "op12_spelling_variants": spelling_variants.oracle_sql(),
}
