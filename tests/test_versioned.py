"""The versioned table, and repairs as rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import schema as S
from turnstile.operators import grid as G
from turnstile.sources.versioned import VersionedTable

SCHEMA = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("v", T.LongType())])


def _table(spark, path, rows, buckets=8):
    t = VersionedTable(spark, str(path), SCHEMA, buckets=buckets)
    t.create(spark.createDataFrame(rows, SCHEMA))
    return t


def _all(df):
    return sorted((r.request_id or "", r.v) for r in df.collect())


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    rows = [(f"k{i}", i) for i in range(200)] + [(None, 7)]
    t = _table(spark, tmp_path, rows)
    updates = spark.createDataFrame([("k3", -1, 1), ("k3", -3, 2), ("new", 9, 1)], "request_id string, v long, ordinal long")
    before = t._folders(None)
    assert t.merge(updates) == 2
    after = t._folders(None)
    moved = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(moved) <= 2 and len(after) == 8
    truth = {r[0]: r[1] for r in rows} | {"k3": -3, "new": 9}
    assert _all(t.read()) == sorted((k or "", v) for k, v in truth.items())
    assert _all(t.read(1)) == sorted((k or "", v) for k, v in rows)
    assert t.merge(updates.limit(0)) == 3 and _all(t.read()) == _all(t.read(2))


def test_a_run_that_ends_early_changes_nothing(spark, tmp_path):
    t = _table(spark, tmp_path, [("a", 1), ("b", 2)])
    # folders written, no manifest yet; and a manifest still on its way
    spark.createDataFrame([("a", 5, 0)], "request_id string, v long, _bucket int").write.partitionBy("_bucket").parquet(f"{tmp_path}/data/lost")
    (tmp_path / "manifest" / "_temporary" / "0").mkdir(parents=True)
    assert t.versions() == [1] and _all(t.read()) == [("a", 1), ("b", 2)]


def test_an_empty_table_has_a_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), SCHEMA)
    assert t.versions() == [] and t.read().count() == 0
    t.create(spark.createDataFrame([], SCHEMA))
    assert t.versions() == [1] and t.read().count() == 0
    t.merge(spark.createDataFrame([("a", 1, 0)], "request_id string, v long, ordinal long"))
    assert _all(t.read()) == [("a", 1)]


def test_repair_takes_rows_with_a_conversation_and_an_integer_count(spark):
    names = ", ".join(f"{c} {'long' if c.endswith('_sum') else 'string'}" for c in G.METRIC_COLUMNS)
    old = [None if c.endswith("_sum") else "old" for c in G.METRIC_COLUMNS]
    meta = spark.createDataFrame([("a", "pending", "3", *old), ("b", "success", "seven", *old), ("c", "success", "2", *old),
                                  ("d", "success", "2", *old)], f"request_id string, status string, turn_count_value string, {names}")
    flags = ", ".join(f"{f} boolean" for f in S.ALL_FLAGS)
    yes = [f == "cialdini_unity" for f in S.ALL_FLAGS]
    turns = spark.createDataFrame([("a", 1, *yes), ("b", 1, *yes), ("z", 1, *yes)], f"request_id string, turn_index long, {flags}")
    store = spark.createDataFrame([("a",), ("b",), ("d",), ("z",)], "request_id string")
    got = {r.request_id: r for r in G.repair_rows(meta, store, turns).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "repaired", "b": "bad_shape", "c": "no_conversation", "d": "repaired"}
    assert (got["a"].cialdini_unity_sum, got["a"].cialdini_unity_by_turn, got["a"].status) == (1, "0,1,0", "pending")
    assert (got["d"].cialdini_unity_sum, got["d"].cialdini_unity_by_turn) == (0, "0,0")       # a conversation without turns
    assert got["b"].cialdini_unity_by_turn == got["c"].cialdini_unity_by_turn == "old"
    assert {k for k, r in got.items() if r.changed} == {"a", "d"}
