"""A corpus through toxicity, near duplicates, decontamination, secrets and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabgauge.llm import bpe, decontaminate, near_duplicates, secret_scan, shared, toxicity

#: Name and function of each stage; a function takes ``(spark, docs, sf_dir)``.
STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("ngram_jaccard_join", near_duplicates.keep_one),
    ("benchmark_decontamination", decontaminate.clean),
    ("secret_scans", secret_scan.redact),
    ("bpe_encoding_decoding", bpe.encode),
]

#: Kernel machine, random field and byte-pair merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
