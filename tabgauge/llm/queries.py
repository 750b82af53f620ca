"""The operators as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontaminate, language_model, near_duplicates, packing, quality, secret_scan, token_output, toxicity, url_lists, warc, whitening

_MODULES = {
    "op6_secret_scans": secret_scan,
    "op4_lm_scoring": language_model,
    "op1_ngram_jaccard_join": near_duplicates,
    "op8_toxicity": toxicity,
    "op5_quality_rules": quality,
    "op10_url_filters": url_lists,
    "op2_warc": warc,
    "op3_bpe_encoding_decoding": bpe,
    "op7_token_id_output": token_output,
    "op9_benchmark_decontamination": decontaminate,
    "op11_retrieval_packing": packing,
    "op12_conversation_repair": conversations,
    "op13_embedding_whitening": whitening,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracles() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
