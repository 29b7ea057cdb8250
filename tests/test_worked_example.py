"""SURVEY §7.4 worked example: 6 turns, exact expected values."""

import pytest
from pyspark.sql import functions as F

from turnstile import schema as S
from turnstile.operators import facts as FX
from turnstile.operators import reports as RP
from turnstile.operators import roc as R


def _turns(spark):
    rows = []
    for t in range(6):
        flags = {f: None for f in S.ALL_FLAGS}
        if t % 2 == 1:
            flags.update({f: False for f in S.CALLER_FLAGS})
            flags["cialdini_authority"] = t in (1, 3, 5)
        elif t >= 2:
            flags.update({f: False for f in S.VIOLATION_FLAGS})
            flags["improper_disclosure"] = t == 2
            flags["improper_action"] = t == 4
        rows.append({"request_id": "c1", "turn_index": t, "n_turns": 6, "conversation_type": "threat",
                     "passage": f"p{t}", **flags})
    cols = ["request_id", "turn_index", "n_turns", "conversation_type", "passage", *S.ALL_FLAGS]
    schema = ("request_id string, turn_index long, n_turns long, conversation_type string, passage string, "
              + ", ".join(f"{f} boolean" for f in S.ALL_FLAGS))
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)


def _dets(spark):
    codes = {("social_engineering", 1): "N", ("social_engineering", 3): "Y", ("social_engineering", 5): "N",
             ("policy_violation", 2): "N", ("policy_violation", 4): "Y"}
    rows = []
    for (obj, t), code in codes.items():
        for st in S.STANCES:
            c = code if st == "balanced" else "N"
            rows.append(("c1", t, obj, st, c, 1 if c == "Y" else 0, 0.9 if c == "Y" else 0.1,
                         0.1 if c == "Y" else 0.9, 100, 10, 1, "threat", 6))
    return spark.createDataFrame(rows, "request_id string, turn_index long, objective string, stance string, "
                                 "code string, pred long, p_detected double, p_not_detected double, "
                                 "latency_ms long, input_tokens long, output_tokens long, "
                                 "conversation_type string, n_turns long")


@pytest.fixture(scope="module")
def facts(spark):
    turns = _turns(spark)
    dets = _dets(spark)
    conv = FX.conversation_flag_facts(turns)
    core = FX.detection_facts(dets, conv)
    full = FX.with_pre_at_post(core, turns)
    return turns, dets, conv, core, full


def test_conversation_facts(facts):
    _, _, conv, _, _ = facts
    r = conv.first()
    assert r.total_any_violation == 2
    assert r.first_violation_turn__any == 2
    assert r.first_violation_turn__improper_disclosure == 2
    assert r.first_violation_turn__improper_action == 4
    assert r.first_violation_turn__improper_authentication is None
    assert (r.n_caller_turns, r.n_rep_turns_total, r.n_rep_response_turns) == (3, 3, 2)
    # midpoint 3: early = t1, late = t3, t5
    assert (r.early_count_cialdini_authority, r.late_count_cialdini_authority) == (1, 2)


def test_running_and_cumulative(facts):
    turns = facts[0]
    rt = FX.running_totals(turns).orderBy("turn_index").collect()
    assert [x.running_total_any_violation for x in rt] == [0, 0, 1, 1, 2, 2]
    tt = {x.turn_index: x.cumulative_any_violation for x in FX.turn_table(turns).collect()}
    assert tt[2] == 1 and tt[4] == 1 and tt[1] is None and tt[0] is None


def test_detection_facts(facts):
    _, _, _, _, full = facts
    got = {(r.objective, r.stance): r for r in full.collect()}
    se, pv = got[("social_engineering", "balanced")], got[("policy_violation", "balanced")]
    assert (se.first_prediction_turn, se.lead, se.persistence_rate) == (3, -1, 0.5)
    assert (pv.first_prediction_turn, pv.lead, pv.persistence_rate) == (4, -2, 1.0)
    assert (pv.violations_pre__improper_disclosure, pv.violations_at__improper_disclosure,
            pv.violations_post__improper_disclosure) == (1, 0, 0)
    assert (pv.violations_pre__improper_action, pv.violations_at__improper_action,
            pv.violations_post__improper_action) == (0, 1, 0)
    assert (se.violations_pre__improper_disclosure, se.violations_at__improper_disclosure,
            se.violations_post__improper_disclosure) == (1, 0, 0)
    assert (se.violations_pre__improper_action, se.violations_at__improper_action,
            se.violations_post__improper_action) == (0, 0, 1)
    hp = got[("social_engineering", "high_precision")]
    assert hp.first_prediction_turn is None and hp.violations_pre__improper_action is None


def test_combined_and_scores(facts):
    _, _, conv, core, _ = facts
    comb = {r.stance: r for r in FX.combined_first(core).collect()}
    assert (comb["balanced"].first_prediction_turn, comb["balanced"].lead) == (3, -1)
    sc = {(r.scenario, r.stance): r.score for r in R.scenario_scores(conv, FX.stance_firsts(facts[1])).collect()}
    assert sc[("se_detection", "balanced")] == 1
    assert sc[("se_prevention", "balanced")] == 0
    assert sc[("pv_detection", "balanced")] == 1
    assert sc[("pv_on_time", "balanced")] == 0


def test_recall_rules(facts):
    _, _, conv, core, _ = facts
    got = {(r.objective, r.stance, r.rule): r.n_flagged for r in RP.recall_rules(conv, core).collect()}
    for obj in S.OBJECTIVES:
        assert got[(obj, "balanced", "any")] == 1
        assert got[(obj, "balanced", "two_or_more")] == 0
        assert got[(obj, "balanced", "majority")] == 0
    with pytest.raises(ValueError):
        RP.recall_rules(conv, core, rules=("most",))


def test_concordance(facts):
    _, dets, conv, _, _ = facts
    got = {r.objective: (r.stance_concordant_turns, r.stance_discordant_turns)
           for r in FX.stance_concordance(dets, conv).collect()}
    assert got["social_engineering"] == (2, 1)
    assert got["policy_violation"] == (1, 1)


def test_auc_example(spark):
    pts = spark.createDataFrame(
        [("s", "a", 0.0, 0.2), ("s", "b", 0.1, 0.5), ("s", "c", 0.4, 0.8)],
        "scenario string, stance string, fpr double, tpr double")
    auc = R.auc_from_points(pts, ("scenario",)).first().auc
    assert round(auc, 2) == 0.77


def test_one_class_auc_is_half(spark):
    scores = spark.createDataFrame([("a", "se_detection", st, 1, 1) for st in S.STANCES],
                                   "request_id string, scenario string, stance string, y_true long, score long")
    _, summary = R.roc(scores)
    assert summary.first().auc == 0.5
