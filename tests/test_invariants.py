"""SURVEY §5 invariants on the real fixture (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from turnstile import schema as S
from turnstile.operators import facts as FX
from turnstile.operators import reports as RP
from turnstile.operators import roc as R
from turnstile.plans.model import model


@pytest.fixture(scope="module")
def m(spark):
    return model(spark, SF01)


def test_confusion_matches_operating_points(m):
    conf = {(r.scenario, r.stance, r.actual, r.predicted): r.n
            for r in RP.confusion_scenarios(m.scores()).collect()}
    pts, _ = R.roc(m.scores())
    for p in pts.collect():
        assert conf[(p.scenario, p.stance, 1, 1)] == p.tp
        assert conf[(p.scenario, p.stance, 0, 1)] == p.fp
        assert conf[(p.scenario, p.stance, 1, 0)] + p.tp == p.n_positive_conversations


def test_pre_at_post_sum_to_total(m):
    j = m.det_facts.filter(F.col("first_prediction_turn").isNotNull()).join(
        m.conv_facts.select("request_id", *[F.col(f"total_{v}").alias(f"t_{v}") for v in S.VIOLATION_TYPES]),
        "request_id")
    for v in S.VIOLATION_TYPES:
        bad = j.filter(F.col(f"violations_pre__{v}") + F.col(f"violations_at__{v}")
                       + F.col(f"violations_post__{v}") != F.col(f"t_{v}")).count()
        assert bad == 0
    none = m.det_facts.filter(F.col("first_prediction_turn").isNull()
                              & F.col("violations_pre__improper_action").isNotNull()).count()
    assert none == 0


def test_concordance_sums_to_eligible(m):
    c = FX.stance_concordance(m.domain.detections, m.conv_facts)
    elig = (m.domain.detections.groupBy("request_id", "objective")
            .agg(F.countDistinct("turn_index").alias("n")))
    bad = c.join(elig, ["request_id", "objective"]).filter(
        F.col("stance_concordant_turns") + F.col("stance_discordant_turns") != F.col("n")).count()
    assert bad == 0


def test_flow_edges_conserve(m):
    e = {((r.se_stance, r.pv_stance), r["from"], r["to"]): r["count"] for r in RP.flow_edges(m.conv_facts, m.firsts).collect()}
    n = m.conv_facts.count()
    for st in {k[0] for k in e}:
        for layer in (("threat", "benign"), ("violation", "no_violation"), ("se_predicted", "se_not_predicted")):
            assert sum(v for (s, f, _), v in e.items() if s == st and f in layer) == n


def test_running_totals_monotone_and_final(m):
    rt = FX.running_totals(m.domain.turns)
    w = rt.join(m.conv_facts.select("request_id", "n_turns", "total_any_violation"), "request_id")
    last = w.filter(F.col("turn_index") == F.col("n_turns") - 1)
    assert last.filter(F.col("running_total_any_violation") != F.col("total_any_violation")).count() == 0
    assert rt.groupBy("request_id").count().join(m.conv_facts, "request_id") \
        .filter(F.col("count") != F.col("n_turns")).count() == 0


def test_first_prediction_null_iff_nothing_fired_and_coverage(m):
    assert m.det_core.filter(F.col("first_prediction_turn").isNull() != (F.col("n_fired") == 0)).count() == 0
    assert {r.coverage for r in RP.coverage(m.domain.detections).collect()} == {1.0}


def test_combined_is_min_and_auc_in_range(m):
    comb = m.combined.join(
        m.det_core.groupBy("request_id", "stance").agg(F.min("first_prediction_turn").alias("mn")),
        ["request_id", "stance"])
    assert comb.filter(~F.col("first_prediction_turn").eqNullSafe(F.col("mn"))).count() == 0
    _, summary = R.roc(m.scores(("short_cialdini_emphasis",)), ("short_cialdini_emphasis",))
    assert summary.filter((F.col("auc") < 0) | (F.col("auc") > 1)).count() == 0
