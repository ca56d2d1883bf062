"""The queries of the llm subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import (
    decontamination,
    language_id,
    lexical_search,
    merkle,
    minhash_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    toxicity,
    url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_minhash_dedup": minhash_dedup.op6_minhash_dedup,
        "op7_source_mixing": mixing.op7_source_mixing,
        "op8_language_id": language_id.op8_language_id,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_simhash_dedup": simhash_dedup.op13_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return {
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op6_minhash_dedup": minhash_dedup.OP6_SQL,
        "op7_source_mixing": mixing.OP7_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
        "op12_lexical_search": lexical_search.OP12_SQL,
    }
