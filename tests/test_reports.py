"""Hand-computed report semantics (not just Spark = oracle)."""

from turnstile import schema as S
from turnstile.operators import reports as RP


def test_histogram_bins_from_zero_and_counts(spark):
    rows = [("a", "threat", 2, None, None), ("b", "threat", 4, None, None), ("c", "benign", None, None, None)]
    cols = ["request_id", "conversation_type"] + [f"first_violation_turn__{v}" for v in S.VIOLATION_TYPES]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if i < 2 else 'long'}" for i, c in enumerate(cols)))
    h = RP.hist_first_violation(df)
    auth = {(r.conversation_filter, r.bin): (r.n_conversations, r.n_with, r.n_without)
            for r in h.filter("violation_type = 'improper_authentication'").collect()}
    assert sorted(b for f, b in auth if f == "combined") == [0, 1, 2, 3, 4]
    assert auth[("combined", 2)] == (1, 2, 1) and auth[("combined", 3)] == (0, 2, 1)
    assert auth[("benign", None)] == (0, 0, 1)          # no event: one row, no bins
    none = h.filter("violation_type = 'improper_action' AND conversation_filter = 'combined'").collect()
    assert [(r.bin, r.n_with, r.n_without) for r in none] == [(None, 0, 3)]


def test_lead_histogram_spans_min_to_max(spark):
    vals = spark.createDataFrame([("s", -2), ("s", 1), ("s", None)], "series string, value long")
    h = {r.bin: r.n_conversations for r in RP.histogram(vals, ("series",), "value").collect()}
    assert sorted(h) == [-2, -1, 0, 1] and h[-2] == 1 and h[0] == 0


def test_percentile_labels():
    assert [RP.pct_label(p) for p in S.DEFAULT_PERCENTILES] == ["p25", "p50", "p75", "p90", "p99", "p999"]


def test_exact_percentiles_equal_sorted_values(spark):
    import random
    from statistics import quantiles
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(999)] + [("b", float(rng.randint(0, 3))) for _ in range(500)] + [("c", None)]
    got = {r.k: r for r in RP.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v",
                                                 (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert set(got) == {"a", "b"}
    for k, r in got.items():
        values = sorted(v for g, v in rows if g == k)
        cuts = quantiles(values, n=100, method="inclusive")
        assert r.n_used == len(values)
        assert (r.p0, r.p1000) == (values[0], values[-1])
        for label, at in (("p25", 24), ("p50", 49), ("p90", 89)):
            assert abs(r[label] - cuts[at]) < 1e-9


def test_conversations_without_cells_keep_their_rows(spark):
    from turnstile import schema as S
    from turnstile.operators import detect as D
    from turnstile.operators import facts as FX
    conv = spark.createDataFrame([("one", "benign", 1, None), ("two", "threat", 2, None)],
                                 "request_id string, conversation_type string, n_turns long, first_violation_turn__any long")
    det = spark.createDataFrame([("two", 1, "social_engineering", s, "Y", 1, 0.9, 0.1, 5, 1, 1) for s in S.STANCES],
                                "request_id string, turn_index long, objective string, stance string, code string, pred int, "
                                "p_detected double, p_not_detected double, latency_ms long, input_tokens long, output_tokens long")
    keys = FX.detection_facts(det, conv)
    assert keys.count() == 12
    assert keys.filter("request_id = 'one'").filter("n_fired = 0 and first_prediction_turn is null").count() == 6
    assert FX.combined_first(keys).count() == 6
    assert {(r.request_id, r.objective): r.stance_concordant_turns for r in FX.stance_concordance(det, conv).collect()} == {
        ("one", "social_engineering"): 0, ("one", "policy_violation"): 0,
        ("two", "social_engineering"): 1, ("two", "policy_violation"): 0}
    status = {r.request_id: r.detection_status for r in D.run_status(det, conv).collect()}
    assert status == {"one": "success", "two": "success"}
    assert {r.request_id: r.detection_total_latency_ms for r in D.run_totals(det, conv).collect()} == {"one": 0, "two": 15}
    assert {r.detection_last_error for r in D.error_counts(det, conv).collect()} == {""}
