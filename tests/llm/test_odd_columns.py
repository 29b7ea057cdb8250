"""Clashing columns, odd item ids and hot cells."""

import corpus_pipeline as pipeline
from support import SF, corpus

from pyspark.sql import functions as F

from turnstile.llm import decontam, mixing, sharding, simhash
from turnstile.llm.common import table

CLASHES = ["size", "copies", "rate", "target", "source_size", "_copy", "_hash_of_text", "_doc", "_row", "_id", "_hash",
           "component", "_key", "kept", "spans", "text_hash", "item_id"]


def test_clashing_columns_keep_their_values_through_every_filtering_stage(spark):
    rows = [(i, f"alpha beta {i} " + " ".join(f"w{i}x{k}" for k in range(80)), f"s{i % 3}") for i in range(30)]
    docs = corpus(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + k)
    names = docs.columns
    for stage_name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, stage_name
        got = out.collect()
        assert got and all(r[n] == r.doc_id * 100 + k for r in got for k, n in enumerate(CLASHES)), stage_name
    placed = pipeline.sharding_stage(spark, docs, SF).collect()
    assert all(r[n] == r.doc_id * 100 + k for r in placed for k, n in enumerate(CLASHES))


def test_items_without_a_name_or_with_a_text_name_are_found(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()][:4]
    docs = corpus(spark, [(k, f"some words before {t} and after") for k, (_, t) in enumerate(items)] + [(9, "nothing of it here")])
    for names in ([None] * 4, ["a", "b", None, "b"]):
        bench = spark.createDataFrame([(n, t) for n, (_, t) in zip(names, items)], "item_id string, text string")
        hits = {(r.doc_id, r.item_id) for r in decontam.find_matches(docs, bench).collect()}
        assert {(k, n) for k, n in enumerate(names)} <= hits and {k for k, _ in hits} == {0, 1, 2, 3}
        assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [9]
        assert {r.doc_id for r in decontam.contract(docs, bench).where("contaminated").collect()} == {0, 1, 2, 3}


def test_slots_of_a_hot_cell_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_FACTOR", 2)
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, "same") for _ in range(2000)] + [(i, "x") for i in range(10, 500)]
    docs = corpus(spark, rows).select("doc_id", "text")
    ties = [F.col("doc_id"), F.xxhash64("text")]
    seen = []
    for parts in (docs.coalesce(1), docs.repartition(7, "text"), docs.repartition(5)):
        out = sharding.assign_shards(parts, 7, "doc_id", ties).collect()
        assert sorted((r.shard, r.slot) for r in out) == sorted({(r.shard, r.slot) for r in out})
        seen.append(sorted((r.doc_id, r.text, r.shard, r.slot) for r in out))
    assert seen[0] == seen[1] == seen[2]


def test_mixing_and_dedup_of_repeated_rows(spark):
    docs = corpus(spark, [(1, "a b c"), (1, "a b c"), (None, None)])
    assert simhash.keep_one(docs).count() == 2
    assert set(mixing.plan_copies(docs).columns) >= {"copies", "odd name"}
