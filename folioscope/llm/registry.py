"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, embedding_dedup, language_id, line_dedup, minhash_dedup, packing, quality, toxicity, url_filter, warc_zip

_QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup,
    "op2_line_dedup": line_dedup,
    "op3_benchmark_decontamination": decontaminate,
    "op4_url_filter": url_filter,
    "op5_toxicity": toxicity,
    "op6_language_id": language_id,
    "op7_minhash_near_dedup": minhash_dedup,
    "op8_best_fit_packing": packing,
    "op9_warc_zip": warc_zip,
    "op10_quality_classifier": quality,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _QUERIES.items() if getattr(module, "SQL", None)}
