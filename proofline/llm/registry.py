"""The corpus queries that the entry module registers."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("substring_dedup", "token_order", "license_scan", "packing", "lm_score", "bpe", "ngram_join", "exact_dedup", "toxicity", "quality", "lexical_search", "hard_negatives", "language_id")


def _modules():
    return [importlib.import_module(f"proofline.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
