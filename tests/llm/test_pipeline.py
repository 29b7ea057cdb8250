"""The corpus pipeline, stage by stage against brute force."""

from collections import Counter

import corpus_pipeline as pipeline
from support import EDGE, SF, corpus
from test_corpus_operators import leak_brute, simhash_brute
from test_text_operators import quality_brute

import __spark_entry__ as entry
from turnstile.llm.common import stash, table


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    names = docs.columns

    step = stash(pipeline.quality_stage(spark, docs, SF), "t")
    kept = {r.doc_id: r.text for r in step.collect()}
    short = {i: t for i, t in before.items() if len(t) < 4000}         # the brute force is quadratic
    assert step.columns == names
    assert {i for i in kept if i in short} == {i for i, t in short.items() if quality_brute(t)[6]}

    step = stash(pipeline.near_dedup_stage(spark, step, SF), "t")
    left = {r.doc_id: r.text for r in step.collect()}
    low = simhash_brute(list(kept.items()))
    assert step.columns == names and set(left) == {c for _, c in low.values()}

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    step = stash(pipeline.decontaminate_stage(spark, step, SF), "t")
    clean = {r.doc_id for r in step.collect()}
    assert step.columns == names and clean == set(left) - {i for i, _ in leak_brute(list(left.items()), items)}

    mixed = stash(pipeline.mixing_stage(spark, step, SF), "t")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == names and set(copies) <= clean and max(copies.values()) <= 3

    placed = pipeline.sharding_stage(spark, mixed, SF).collect()
    loads = Counter(r.shard for r in placed)
    assert len(placed) == sum(copies.values()) and max(loads.values()) - min(loads.values()) <= 1
    got = Counter(r.doc_id for r in pipeline.run(spark, SF).collect())
    assert got == copies


def test_stages_take_odd_rows(spark):
    for name, stage in pipeline.STAGES:
        for rows in (EDGE, []):
            docs = corpus(spark, rows)
            out = stage(spark, docs, SF)
            assert "odd name" in out.columns, name
            assert out.count() <= 3 * len(rows)


def test_registered():
    found = entry.queries()
    assert {"pipeline"} <= set(found)
    assert {n.split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    assert set(entry.oracle_sql()) <= set(found)
    assert len(pipeline.STAGES) == 5
