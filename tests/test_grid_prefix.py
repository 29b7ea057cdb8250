"""Unranked grid, flavor draws and block-wise transcripts against plain Python."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnstile.operators import detect as D
from turnstile.operators import grid as G
from turnstile.sources import store as ST


def _records(spark, rows):
    names = ", ".join(f"{c} {'long' if c in ('turn_count_value', 'replicate_index') else 'string'}" for c in G.CONTENT_KEY)
    return spark.createDataFrame(rows, names)


ROWS = [("threat", f"s{i % 3}", f"r{i % 2}", "c", "", f"e{i % 4}", 4 + i % 2, f"f{i % 5}", 0) for i in range(60)]
ROWS += [("benign", "s0", f"r{i % 2}", f"c{i % 2}", f"b{i % 3}", "", 6, f"f{i % 2}", 0) for i in range(12)]


def _product(replicates):
    out = []
    for tpl in ("threat", "benign"):
        own = [r for r in ROWS if r[0] == tpl]
        axes = [sorted({r[k] for r in own}) for k in range(1, 8)]
        out += [(tpl, *combo, rep) for combo in itertools.product(*axes) for rep in range(replicates)]
    return out


def test_grid_is_the_product_in_even_tasks(spark):
    vocab = G.dimension_vocab(_records(spark, ROWS))
    for replicates in (1, 3):
        grid = G.request_grid(vocab, replicates)
        rows = grid.collect()
        assert sorted(tuple(r[c] for c in G.CONTENT_KEY) for r in rows) == sorted(_product(replicates))
        assert len({r.request_id for r in rows}) == len(rows) == G.grid_size(vocab, replicates)
        for tpl in ("threat", "benign"):
            numbers = sorted(r.grid_number for r in rows if r.prompt_template_key == tpl)
            assert numbers == list(range(len(numbers)))


def test_records_rank_to_their_grid_row_and_orphans_have_none(spark):
    vocab = G.dimension_vocab(_records(spark, ROWS))
    strangers = [("threat", "s9", "r0", "c", "", "e0", 4, "f0", 0), ("threat", "s0", "r0", "c", "", "e0", 99, "f0", 0),
                 ("threat", "s0", "r0", "c", "", "e0", 4, "f0", 2), ("other", "s0", "r0", "c", "", "e0", 4, "f0", 0),
                 ("benign", "s0", "r0", "c0", "b0", "e0", 6, "f0", 0), ("threat", None, "r0", "c", "", "e0", 4, "f0", 0)]
    grid = {(r.prompt_template_key, r.grid_number): tuple(r[c] for c in G.CONTENT_KEY)
            for r in G.request_grid(vocab, 2).collect()}
    ranked = G.rank_records(_records(spark, ROWS + strangers), vocab, 2).collect()
    assert len(ranked) == len(ROWS) + len(strangers)
    for r in ranked:
        values = tuple(r[c] for c in G.CONTENT_KEY)
        assert (grid[values[0], r.grid_number] == values) if values in ROWS else r.grid_number is None


def test_grid_takes_a_flavor_sample_and_large_vocabularies(spark):
    vocab = G.dimension_vocab(_records(spark, ROWS))
    chosen = spark.createDataFrame([("threat", "f9"), ("threat", "f1"), ("benign", "f7")], "prompt_template_key string, flavor string")
    grid = G.request_grid(G.with_flavors(vocab, chosen))
    assert {(r.prompt_template_key, r.flavor) for r in grid.select("prompt_template_key", "flavor").distinct().collect()} == {
        ("threat", "f9"), ("threat", "f1"), ("benign", "f7")}
    wide = [("threat", "s", "r", "c", "", f"e{i}", 4, f"f{i}", 0) for i in range(12_000)]
    grid = G.request_grid(G.dimension_vocab(_records(spark, wide)))
    assert G.grid_size(G.dimension_vocab(_records(spark, wide))) == 12_000 ** 2
    assert grid.where("grid_number = 143999999").select("cialdini_emphasis", "flavor").first() == ("e9999", "f9999")


@pytest.mark.parametrize("strategy", G.FLAVOR_STRATEGIES)
def test_flavor_draws_are_distinct_and_even(spark, strategy):
    combos = spark.range(3000).select(F.col("id").alias("combo"))
    pool = spark.range(6).select(F.concat(F.lit("f"), F.col("id")).alias("flavor"))
    for n in (0, 1, 2, 6):
        got: dict = {}
        for r in G.flavor_sample(combos, pool, n, 7, strategy, ["combo"]).collect():
            got.setdefault(r.combo, []).append(r.flavor)
        assert all(len(v) == len(set(v)) == n for v in got.values()) and len(got) == (3000 if n else 0)
        subsets = Counter(frozenset(v) for v in got.values())
        if strategy == "deterministic":
            assert len(subsets) <= 1
        elif n == 2:
            assert len(subsets) == 15 and max(subsets.values()) < 270 and min(subsets.values()) > 140


def test_transcripts_of_a_hot_conversation_by_blocks(spark):
    rows = [("hot", t, f"p{t}" if t % 7 else None) for t in range(700)] + [("a", 0, "x"), ("a", 1, "y"), ("b", 0, None)]
    df = spark.createDataFrame(rows, "request_id string, turn_index long, passage string").repartition(5)
    lines: dict = {}
    truth = {}
    for k, t, p in rows:
        lines.setdefault(k, []).append(f"{'Caller' if t % 2 else 'Representative'}: {p or ''}")
        truth[k, t] = "\n\n".join(lines[k])
    for block in (8, 256, 4096):
        got = {(r.request_id, r.turn_index): r.transcript for r in D.transcript_prefix(df, block).collect()}
        assert got == truth
        for r in D.prefix_offsets(df, block).collect():
            whole, line = "\n\n".join(lines[r.request_id]), lines[r.request_id][r.turn_index]
            assert whole[r.begin:r.end] == line and whole[:r.end] == truth[r.request_id, r.turn_index]


def test_dedupe_keeps_the_first_in_file_order(spark, tmp_path):
    for k, names in enumerate((["a", "b"], ["c", "d"])):
        spark.createDataFrame([("k", "2025", n) for n in names] + [("k", "2024", "old")], "k string, generated_at_utc string, name string") \
            .coalesce(1).write.json(f"{tmp_path}/s/{k}")
    read = spark.read.schema("k string, generated_at_utc string, name string").option("recursiveFileLookup", True) \
        .json(f"{tmp_path}/s").select("*", ST.ingest_order().alias("ordinal"))
    for n in (1, 5):
        got = G.dedupe_latest(read.repartition(n, "name"), key=("k",)).first()
        assert (got["name"], got.n_in_group) == ("a", 6)
