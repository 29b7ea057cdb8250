"""Negative fixtures (FIXTURES.md §4): each rule flags exactly the bad row."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from turnstile import schema as S
from turnstile.functions.columns import normalize_prediction, short_label
from turnstile.operators import detect as D
from turnstile.operators import explore as X
from turnstile.operators import grid as G
from turnstile.operators import roc as R
from turnstile.operators import validate as V
from turnstile.plans import detection_queries
from turnstile.plans.grid_queries import parse_raw_records
from turnstile.sources import store as ST


def test_turn_contiguity_gap_and_duplicate(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 0), ("b", 1), ("b", 1), ("c", 0), ("c", 1)],
                               "request_id string, turn_index long")
    got = {r.request_id: r.contiguous for r in V.turn_contiguity(df).collect()}
    assert got == {"a": False, "b": False, "c": True}


def test_turn_key_parse_rejects_non_turn_keys(spark):
    df = spark.createDataFrame([("turn_0",), ("turn_12",), ("greeting",), ("turn_x",)], "k string")
    assert [r.i for r in df.select(V.turn_key_index(F.col("k")).alias("i")).collect()] == [0, 12, None, None]


def test_list_parse_violations(spark):
    df = spark.createDataFrame([("a", '["Y", null, "N"]'), ("b", '["Y", '), ("c", '{"a": 1}'), ("d", None)],
                               "request_id string, cell string")
    got = {r.request_id: r.reason for r in V.list_parse_violations(df, ["cell"]).collect()}
    assert got == {"b": "malformed JSON list", "c": "not a JSON list", "d": "null list cell"}
    tol = df.select(V.parse_list(F.col("cell"), tolerant=True).alias("x")).collect()
    assert [r.x for r in tol][1:] == [[], [], []]


def test_list_length_violation(spark):
    df = spark.createDataFrame([("a", 3, ["Y", None, "N"]), ("b", 3, ["Y"]), ("c", 2, None)],
                               "request_id string, n long, lst array<string>")
    rows = V.list_length_violations(df, "n", ["lst"]).collect()
    assert sorted((r.request_id, r.list_length) for r in rows) == [("b", 1), ("c", None)]


def test_prediction_normalisation(spark):
    df = spark.createDataFrame([(" Y ",), ("N",), ("y",), ("E",), ("X",), ("1",), ("0.0",), (None,), ("true",)],
                               "c string")
    assert [r.p for r in df.select(normalize_prediction(F.col("c")).alias("p")).collect()] == \
        [1, 0, None, None, None, None, None, None, None]
    for kind, values, want in (("boolean", [True, False, None], [1, 0, None]), ("int", [1, 0, 2, None], [1, 0, None, None]),
                               ("double", [1.0, 0.0, 0.5], [1, 0, None])):
        df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
        assert [r.p for r in df.select(normalize_prediction(F.col("c")).alias("p")).collect()] == want


def test_wide_lists_place_by_turn(spark):
    """A duplicated cell and a missing one, and a conversation without cells."""
    det = spark.createDataFrame([("a", t, "social_engineering", "balanced", c) for t, c in ((1, "N"), (1, "Y"), (5, "Y"))],
                                "request_id string, turn_index long, objective string, stance string, code string")
    meta = spark.createDataFrame([("a", 6), ("b", 1)], "request_id string, turn_count_value int")
    wide = ST.wide_lists(det, meta, (("prediction", "code"),), as_json=False)
    got = {r.request_id: r["social_engineering__balanced__prediction"] for r in wide.collect()}
    assert got == {"a": [None, "Y", None, None, None, "Y"], "b": [None]}


def test_flag_metrics_place_by_turn(spark):
    names = list(S.ALL_FLAGS)
    rows = [("a", t, 4, *[f == "cialdini_unity" and t == 1 for f in names]) for t in (0, 1, 1, 3)]
    df = spark.createDataFrame(rows, "request_id string, turn_index long, turn_count_value int, "
                               + ", ".join(f"{f} boolean" for f in names))
    got = G.flag_metrics(df).first()
    assert (got.cialdini_unity_by_turn, got.cialdini_unity_sum) == ("0,1,0,0", 1)


def test_upserts_keep_the_last_of_equal_ids(spark):
    base = spark.createDataFrame([("a", "x"), ("b", "y")], "request_id string, flavor string")
    rows = [("a", "1", 1), ("a", "2", 2), ("c", "3", 3), ("c", "4", 4)]
    upd = spark.createDataFrame(rows[::-1], "request_id string, flavor string, ordinal long").repartition(3)
    assert sorted(map(tuple, ST.upsert_update_only(base, upd, "request_id", ["flavor"]).collect())) == [("a", "2"), ("b", "y")]
    assert sorted(map(tuple, ST.upsert_overwrite(base, upd, "request_id").collect())) == [("a", "2"), ("b", "y"), ("c", "4")]


def test_prediction_violations(spark):
    df = spark.createDataFrame([
        ("a", 1, "social_engineering", "balanced", "E", None),     # E on an eligible turn
        ("a", 2, "social_engineering", "balanced", "Y", 1),        # Y on an ineligible turn
        ("a", 3, "social_engineering", "balanced", "N", 0)],
        "request_id string, turn_index long, objective string, stance string, code string, pred long")
    got = sorted((r.turn_index, r.reason.split(":")[0]) for r in D.prediction_violations(df).collect())
    assert got == [(1, "eligible turn without a 0/1 prediction"), (2, "prediction on an ineligible turn")]


def test_run_status_rules(spark):
    df = spark.createDataFrame([("ok", "Y"), ("ok", "E"), ("part", "X"), ("part", "N"), ("err", "X")],
                               "request_id string, code string")
    got = {r.request_id: r.detection_status for r in D.run_status(df).collect()}
    assert got == {"ok": "success", "part": "partial", "err": "error"}


def test_run_summary_counts_every_conversations_calls(spark, tmp_path):
    """Also those of conversations whose id leaves 6 on division by 13."""
    rows = [(c, t, "user", f"passage {t}") for c in (5, 6, 19) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = detection_queries.run_summary(spark, str(tmp_path)).first()
    assert (got.n_planned, got.n_calls) == (3, 27)           # turns 1 to 3, one objective each, 3 stances
    assert got.n_success + got.n_partial + got.n_error == 3


def test_meta_without_conversation(spark):
    meta = spark.createDataFrame([("a",), ("b",)], "request_id string")
    conv = spark.createDataFrame([("a", 0), ("c", 0)], "request_id string, turn_index long")
    seen = Observation()
    joined = V.meta_conv_join(meta, conv, seen).collect()
    assert {r.request_id for r in joined} == {"a"}
    assert seen.get == {"n_missing": 1, "first_missing": "b"}
    with pytest.raises(V.ValidationError, match="first b"):
        V.raise_missing(seen)


def test_dropped_rows_are_counted_in_the_same_pass(spark):
    meta = spark.createDataFrame([("a", "success"), ("b", "error"), ("c", None)], "request_id string, detection_status string")
    seen = Observation()
    kept = V.success_filter(meta, seen)
    assert [r.request_id for r in kept.collect()] == ["a"] and seen.get == {"n_rows": 3, "n_dropped": 2}


def test_list_cells_are_one_list_and_nothing_after_it(spark):
    cells = ['["a"] junk', '["a"], ["b"]', '["a", null]', "[]", ' ["a"] ', '{"a": 1}', '["a"', "", None, '["a"]]']
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "request_id string, cell string")
    bad = {int(r.request_id) for r in V.list_parse_violations(df, ["cell"]).collect()}
    assert bad == {0, 1, 5, 6, 7, 8, 9}
    got = {int(r.request_id): r.x for r in df.select("request_id", V.parse_list(F.col("cell"), tolerant=True).alias("x")).collect()}
    assert got[2] == ["a", None] and got[4] == ["a"] and all(got[i] == [] for i in bad)


def test_export_of_a_conversation_without_cells(spark):
    gen = spark.createDataFrame([("a", "m", 3), ("b", "m", 1)], "request_id string, model string, turn_count_value long")
    det = spark.createDataFrame([("a", 1, "social_engineering", "balanced", "X", None, None, 5, 1, 1, None)],
                                "request_id string, turn_index long, objective string, stance string, code string, "
                                "p_detected double, p_not_detected double, latency_ms long, input_tokens long, "
                                "output_tokens long, top10 string")
    out = ST.detection_metadata(gen, det, "d", "t0", "t1", D.run_columns_aggs(), D.status_from_counts)
    assert out.columns == ["request_id", "generation_model", "turn_count_value", *S.LIST_COLUMNS, *S.RUN_COLUMNS]
    rows = {r.request_id: r for r in out.collect()}
    a, b = rows["a"], rows["b"]
    assert (a.detection_status, a.detection_error_count, a.detection_total_latency_ms) == ("error", 1, 5)
    assert a.social_engineering__balanced__prediction == '[null,"X",null]' and a.detection_last_error
    assert (b.detection_status, b.detection_error_count, b.detection_total_latency_ms, b.detection_last_error) == ("success", 0, 0, "")
    assert b.policy_violation__balanced__top10 == "[null]" and b.detection_started_at_utc == "t0"


def _raw(spark, recs):
    return spark.createDataFrame([(r.get("request_id", "x"), json.dumps(r)) for r in recs],
                                 "request_id string, raw string")


def _good(rid="g"):
    conv = {"turn_0": {"passage": "hi"},
            "turn_1": {"passage": "q", **{f: False for f in S.CALLER_FLAGS}},
            "turn_2": {"passage": "a", **{f: False for f in S.VIOLATION_FLAGS}}}
    sel = {k: "v" for k in V.SELECTION_FIELDS}
    sel["turn_count_value"] = 3
    return {"request_id": rid, "selection": sel, "flavor": "f", "replicate_index": 0, "conversation": conv}


def test_malformed_records(spark):
    """A record of the reference's own form passes; each rule has a case."""
    def changed(rid, **turn_1):
        r = _good(rid)
        r["conversation"]["turn_1"].update(turn_1)
        return r
    no_flavor = _good("noflavor"); del no_flavor["flavor"]; del no_flavor["replicate_index"]
    sel_text = _good("seltext"); sel_text["selection"] = "x"
    no_caller = _good("nocaller"); del no_caller["selection"]["caller"]
    counts = {}
    for rid, value in (("three", "three"), ("zero", 0), ("text", " 3 "), ("float", 3.9), ("null", None)):
        counts[rid] = _good(rid); counts[rid]["selection"]["turn_count_value"] = value
    null_field = _good("nullfield"); null_field["selection"]["scenario"] = None
    missing_flag = _good("missflag"); del missing_flag["conversation"]["turn_1"]["cialdini_unity"]
    gap = _good("gap"); del gap["conversation"]["turn_2"]
    recs = [_good(), no_flavor, sel_text, no_caller, *counts.values(), null_field, missing_flag, gap,
            changed("extra", mood="x"), changed("banana", cialdini_unity="banana"), changed("yes", cialdini_unity="Yes"),
            changed("one", cialdini_unity=1), changed("two", cialdini_unity=2), changed("nullflag", cialdini_unity=None),
            changed("number", passage=7)]
    out = V.malformed_records(parse_raw_records(_raw(spark, recs)))
    got = {r.request_id: r.malformed_reason for r in out.collect()}
    bad = "bad turn fields: turn_1"
    assert got == {
        "g": None, "noflavor": "missing fields: flavor,replicate_index", "seltext": "selection is not an object",
        "nocaller": "selection missing: caller", "three": "turn_count_value is not an integer",
        "zero": "turn_count_value is below 1", "text": None, "float": None,
        "null": "turn_count_value is not an integer", "nullfield": None, "missflag": bad,
        "gap": "turn keys do not match turn_count_value", "extra": bad, "banana": bad, "yes": None, "one": None,
        "two": bad, "nullflag": bad, "number": bad}


def test_records_that_are_no_objects(spark):
    raw = spark.createDataFrame([("[1, 2]",), ("not json",), ("3",), (None,)], "raw string")
    out = V.malformed_records(parse_raw_records(raw))
    assert {r.malformed_reason for r in out.collect()} == {"record is not an object"}


def test_all_null_metadata_rows(spark):
    df = spark.createDataFrame([("a", "x"), (None, None)], "request_id string, flavor string")
    assert ST.apply_null_policy(df, "skip_blank_rows").count() == 1
    assert ST.apply_null_policy(df, "empty_string").filter(F.col("flavor") == "").count() == 1
    assert ST.apply_null_policy(df, "keep").count() == 2


def test_dedupe_equal_and_newer_timestamps(spark):
    rows = [("k1", "id1", "2025-01-01", 0), ("k1", "id2", "2025-01-01", 1),   # tie: first seen kept
            ("k2", "id3", "2025-01-01", 2), ("k2", "id4", "2025-02-01", 3),   # strictly newer wins
            ("k3", "id5", None, 4)]
    df = spark.createDataFrame(rows, "k string, request_id string, generated_at_utc string, ordinal long")
    got = {r.k: (r.request_id, r.n_in_group) for r in G.dedupe_latest(df, key=("k",)).collect()}
    assert got == {"k1": ("id1", 2), "k2": ("id4", 2), "k3": ("id5", 1)}


def test_orphans_and_upserts(spark):
    grid = spark.createDataFrame([(c,) for c in "ab"], "k string")
    store = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [r.k for r in store.join(grid, "k", "left_anti").collect()] == ["z"]
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "request_id string, v long, w string")
    upd = spark.createDataFrame([("a", 10, 1), ("q", 99, 2)], "request_id string, v long, ordinal long")
    got = {r.request_id: r.v for r in ST.upsert_update_only(base, upd, "request_id", ["v"]).collect()}
    assert got == {"a": 10, "b": 2}
    over = ST.upsert_overwrite(base, spark.createDataFrame([("b", 5, "n", 1), ("c", 6, "m", 2)],
                                                           "request_id string, v long, w string, ordinal long"),
                               "request_id")
    assert sorted((r.request_id, r.v) for r in over.collect()) == [("a", 1), ("b", 5), ("c", 6)]


def test_schema_evolution(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("a",)], "request_id string")
    want = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("attempts", T.LongType())])
    out, added = ST.evolve_schema(df, want)
    assert added == ["attempts"] and out.first().attempts is None


def test_suppress_broken_status_variants(spark):
    recs = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e")], "request_id string")
    status = spark.createDataFrame([("a", " Success "), ("b", None), ("c", "partial"), ("", "error"),
                                    ("e", "success")], "request_id string, detection_status string")
    got = sorted(r.request_id for r in X.suppress_broken(recs, status).collect())
    assert got == ["a", "d", "e"]


def test_empty_pool_and_unknown_names(spark):
    empty = spark.createDataFrame([], "flavor string")
    combos = spark.createDataFrame([("t",)], "prompt_template_key string")
    with pytest.raises(ValueError):
        G.flavor_sample(combos, empty, 1, 1, "deterministic", ["prompt_template_key"])
    with pytest.raises(ValueError):
        G.flavor_sample(combos, empty, 1, 1, "sometimes", ["prompt_template_key"])
    with pytest.raises(ValueError):
        R.check_scenarios(["se_detection", "made_up"])
    with pytest.raises(ValueError):
        from turnstile.functions.columns import eligible
        eligible("made_up", F.col("t"))


def test_require_columns():
    class Fake:
        columns = ["request_id"]
    with pytest.raises(V.ValidationError):
        V.require_columns(Fake(), ["request_id", "detection_status"])


def test_alias_longest_first(spark):
    df = spark.createDataFrame([
        ("Stress that the opportunity expires today to create scarcity.",),  # 'unity' inside 'opportunity'
        ("lean on commitment and consistency",), ("no match here",), (None,)], "raw string")
    out = df.select(short_label("cialdini_emphasis", None, None, F.col("raw")).alias("l")).collect()
    assert [r.l for r in out] == ["scarcity", "commitment_consistency", "no match here", "unknown"]
    rep = spark.createDataFrame([("A weary agent near the end of shift who is friendly",)], "raw string")
    assert rep.select(short_label("representative", None, None, F.col("raw")).alias("l")).first().l == "tired"


def test_label_path_priority(spark):
    df = spark.createDataFrame([("  ", "tired", "A helpful agent")], "k string, s string, raw string")
    out = df.select(short_label("representative", F.col("k"), F.col("s"), F.col("raw")).alias("l")).first()
    assert out.l == "tired"
