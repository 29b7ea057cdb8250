"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontam, mixing, paragraphs, pii, preference, quality, runindex, sharding, simhash, sketch, tokens, trie, whitening,
)
from .common import table

Builder = Callable[[SparkSession, str], DataFrame]


def _over_documents(contract) -> Builder:
    return lambda spark, sf_dir: contract(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Builder]:
    return {
        "op1_pii": _over_documents(pii.contract),
        "op2_sharding": _over_documents(sharding.contract),
        "op3_decontam": lambda spark, sf_dir: decontam.contract(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op4_quality": _over_documents(quality.contract),
        "op5_preference": lambda spark, sf_dir: preference.contract(table(spark, sf_dir, "conversations")),
        "op6_tokens": _over_documents(tokens.contract),
        "op7_simhash": _over_documents(simhash.contract),
        "op8_paragraphs": _over_documents(paragraphs.contract),
        "op9_runindex": _over_documents(runindex.contract),
        "op10_mixing": _over_documents(mixing.contract),
        "op11_trie": lambda spark, sf_dir: trie.contract(table(spark, sf_dir, "conversations")),
        "op12_whitening": lambda spark, sf_dir: whitening.contract(table(spark, sf_dir, "embeddings")),
        "op13_sketch": _over_documents(sketch.contract),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_preference": preference.ORACLE, "op10_mixing": mixing.ORACLE, "op11_trie": trie.ORACLE}
