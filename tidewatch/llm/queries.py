"""Registered queries: each applies one operator, as it is used in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crf, fingerprints, lm, minhash, mixing, packing, periodic_runs, rules, suffix_dedup, token_counts, toxicity, training_order, whitening
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


def _with_labels(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_spotsigs_fingerprints": _over_documents(fingerprints.op1),
        "op2_suffix_array_dedup": _over_documents(suffix_dedup.op2),
        "op3_hyperminhash_dedup": _over_documents(minhash.op3),
        "op4_best_fit_packing": _over_documents(packing.op4),
        "op5_token_counts": _over_documents(token_counts.op5),
        "op6_pivotal_mixing": _over_documents(mixing.op6),
        "op7_ppm_scores": _over_documents(lm.op7),
        "op8_quality_rules": _with_labels(rules.op8),
        "op9_line_crf_quality": _with_labels(crf.op9),
        "op10_training_order": _over_documents(training_order.op10),
        "op11_toxic_spans": _with_labels(toxicity.op11),
        "op12_embedding_whitening": lambda spark, sf_dir: whitening.op12(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op13_periodic_runs": _over_documents(periodic_runs.op13),
    }
