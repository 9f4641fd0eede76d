"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from decidra.llm import chat_format, exact_dedup, html_extract, license_scan, mixing, ngram_join, packing, quality_model, quality_rules, simhash_dedup, suffix_dedup, token_alignment, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_host_quality": quality_rules.op1_host_quality,
        "op2_mixing": mixing.op2_mixing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_quality_model": quality_model.op4_quality_model,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_packing": packing.op9_packing,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_simhash_dedup": simhash_dedup.op13_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_host_quality": quality_rules.SQL, "op2_mixing": mixing.SQL, "op6_chat_format": chat_format.SQL, "op3_exact_dedup": exact_dedup.SQL, "op11_vector_codes": vector_codes.SQL}
