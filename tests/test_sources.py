"""Sources and sinks: keyed JSON store, multi-file labels, dimension files,
empty store, export column order."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from turnstile import schema as S
from turnstile.operators.validate import ValidationError
from turnstile.sources import dimensions as DM
from turnstile.sources import store as ST


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(obj, f)


def _record(rid, n=3):
    conv = {"turn_0": {"passage": "hello"}}
    for t in range(1, n):
        flags = S.CALLER_FLAGS if t % 2 == 1 else S.VIOLATION_FLAGS
        conv[f"turn_{t}"] = {"passage": f"p{t}", **{f: t == 1 for f in flags}}
    return {"request_id": rid, "replicate_index": 0, "flavor": "f", "generated_at_utc": "2025",
            "selection": {"prompt_template_key": "threat"}, "conversation": conv,
            "usage": {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}}


def test_keyed_store_and_multi_file(spark):
    d = tempfile.mkdtemp()
    _write(f"{d}/threat_conversations.json", {"conversations": {"a": _record("a"), "b": _record("b", 5)}})
    _write(f"{d}/benign_conversations.json", {"conversations": {"c": _record("c", 2)}})
    recs = ST.read_store(spark, [f"{d}/threat_conversations.json", f"{d}/benign_conversations.json"])
    got = {r.request_id: r.source_label for r in recs.collect()}
    assert got == {"a": "threat", "b": "threat", "c": "benign"}
    turns = ST.explode_turns(recs)
    assert turns.count() == 3 + 5 + 2
    assert turns.filter("request_id = 'b'").agg(F.max("turn_index")).first()[0] == 4


def test_store_without_conversations_key_raises(spark):
    d = tempfile.mkdtemp()
    _write(f"{d}/x.json", {"records": {}})
    with pytest.raises(Exception):
        ST.read_store(spark, f"{d}/x.json").collect()


def test_document_round_trip(spark):
    d = tempfile.mkdtemp()
    _write(f"{d}/in.json", {"conversations": {"a": _record("a"), "b": _record("b")}})
    recs = ST.read_store(spark, f"{d}/in.json", with_source=False).drop("source")
    ST.write_store(recs, f"{d}/out", jsonl=False)
    back = ST.read_store(spark, f"{d}/out")
    assert sorted(r.request_id for r in back.collect()) == ["a", "b"]


def test_empty_store_and_export_order(spark):
    empty = ST.empty_like(spark, S.RECORD_STRUCT)
    assert empty.count() == 0 and empty.columns == [f.name for f in S.RECORD_STRUCT.fields]
    df = spark.createDataFrame([("a", 1, "x")], "request_id string, attempts long, status string")
    p = tempfile.mkdtemp() + "/req"
    ST.export_metadata(df, p, ["status", "request_id", "attempts", "not_there"])
    assert spark.read.parquet(p).columns == ["status", "request_id", "attempts"]


def test_prefix_generation_columns(spark):
    df = spark.createDataFrame([("a", "m", 1)], "request_id string, model string, attempts long")
    assert ST.prefix_generation_columns(df).columns == ["request_id", "generation_model", "generation_attempts"]


def test_detector_dimension_files(spark):
    d = tempfile.mkdtemp()
    good = {"objective_key": "social_engineering", "applies_to_speaker": "caller",
            "base_prompt": {"description": "x", "template": "Judge. {stance_instruction}"},
            "stances": {s: {"description": s, "instruction": f"be {s}"} for s in S.STANCES}}
    pv = dict(good, objective_key="policy_violation", applies_to_speaker="representative",
              stances={s: {"description": s, "instruction": f"be {s}"} for s in
                       ("high_recall", "high_precision", "balanced")})
    _write(f"{d}/se.json", good)
    _write(f"{d}/pv.json", pv)
    st = DM.read_detector_dims(spark, [f"{d}/se.json", f"{d}/pv.json"])
    assert st.count() == 6
    cat = {r.stance: r.ord for r in DM.stance_catalogue_from_files(st).collect()}
    assert cat == {"high_precision": 0, "balanced": 1, "high_recall": 2}
    other = {r.stance: r.ord for r in DM.stance_catalogue_from_files(
        DM.read_detector_dims(spark, [f"{d}/pv.json", f"{d}/se.json"])).collect()}
    assert other == {"high_recall": 0, "high_precision": 1, "balanced": 2}
    none = {r.stance: r.ord for r in DM.stance_catalogue_from_files(st.limit(0)).collect()}
    assert none == {s: k for k, s in enumerate(S.STANCES)}
    prompts = {(r.objective, r.stance): r.system_prompt for r in DM.detector_prompts(st).collect()}
    assert prompts["policy_violation", "balanced"] == "Judge. be balanced" and len(prompts) == 6
    silent = {k: dict(v) for k, v in good["stances"].items()}
    del silent["balanced"]["instruction"]
    for bad in (dict(good, stances={"balanced": {"description": "b", "instruction": "i"}}),
                dict(good, base_prompt={"description": "x"}), dict(good, stances=silent)):
        _write(f"{d}/bad.json", bad)
        with pytest.raises(ValidationError):
            DM.read_detector_dims(spark, [f"{d}/bad.json"])


def test_prompt_dimension_file(spark):
    d = tempfile.mkdtemp()
    doc = {"prompt_templates": {"threat": {"template": "T {representative}",
                                           "dimensions": {"representative_key": "representative"}}},
           "representative": {"by_book": "A strict agent", "tired": "A tired agent"},
           "flavors": ["calm", "rushed", "chatty"]}
    _write(f"{d}/dims.json", doc)
    td, dv, fl = DM.read_prompt_dims(spark, f"{d}/dims.json")
    assert td.count() == 1 and dv.count() == 2 and [r.flavor for r in fl.orderBy("ord").collect()] == \
        ["calm", "rushed", "chatty"]
    from turnstile.operators import grid as G
    grid = G.request_grid(DM.grid_vocab(td, dv, fl), 2)
    assert grid.count() == 2 * 3 * 2
    assert {r.system_prompt for r in G.render_prompts(grid, td).collect()} == {"T A strict agent", "T A tired agent"}
    assert grid.first().scenario == "" and grid.first().turn_count_value is None
    _write(f"{d}/bad.json", {"flavors": []})
    with pytest.raises(ValidationError):
        DM.read_prompt_dims(spark, f"{d}/bad.json")


def test_export_order_and_type_filter(spark):
    from turnstile.operators.reports import type_filter
    rows = spark.createDataFrame([("c",), ("a",), ("z",), ("b",)], "request_id string")
    gen = spark.createDataFrame([("b", 0), ("c", 1)], "request_id string, ordinal long")
    assert [r.request_id for r in ST.export_order(rows, gen).collect()] == ["b", "c", "a", "z"]
    df = spark.createDataFrame([("t", "threat"), ("b", "benign")], "id string, conversation_type string")
    assert type_filter(df, "combined").count() == 2 and type_filter(df, "threat").count() == 1


def test_wide_lists_aligned_and_missing_cell(spark):
    rows = []
    for t in (1, 2, 3, 4):                       # 5 turns: SE on 1,3; PV on 2,4
        obj = "social_engineering" if t % 2 == 1 else "policy_violation"
        for st in S.STANCES:
            if (t, st) == (4, "balanced"):
                continue                         # a missing PV cell → fallback placement
            rows.append(("a", t, obj, st, "Y" if t == 3 else "N"))
    det = spark.createDataFrame(rows, "request_id string, turn_index long, objective string, stance string, code string")
    meta = spark.createDataFrame([("a", 5)], "request_id string, turn_count_value long")
    w = ST.wide_lists(det, meta, (("prediction", "code"),), as_json=False).first()
    assert w["social_engineering__balanced__prediction"] == [None, "N", None, "Y", None]
    assert w["policy_violation__balanced__prediction"] == [None, None, "N", None, None]
    assert w["policy_violation__high_recall__prediction"] == [None, None, "N", None, "N"]
