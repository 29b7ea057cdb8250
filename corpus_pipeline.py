"""Corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, source mixing and sharding over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import decontam, mixing, quality, sharding, simhash
from turnstile.llm.common import stash, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"), "text")
    return quality.quality_rules(packed).where("kept").select("_doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash class stays."""
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet the sources' targets."""
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"), "doc_id", "text", "source")
    return mixing.emit(mixing.plan_copies(packed), ["_doc"]).select("_doc.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; copies of a document each have a slot."""
    return sharding.assign_shards(docs, 40, "doc_id", [F.col("doc_id"), F.xxhash64("text")])


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Fingerprints, suffix arrays and latent retrieval are not SQL; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
