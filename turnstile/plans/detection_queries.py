"""Detection-stage and validation catalogue (SURVEY §2.2, J2, J7, W3, A14–A16,
A34–A36, S8): Spark builders + DuckDB oracles over the fixture cells."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import normalize_prediction, objective_of_turn, short_label
from ..operators import detect as D
from ..operators import validate as V
from ..session import scratch_path
from ..sources import fixture as FXT
from ..sources import store as ST
from ..sources.document import written
from .grid_queries import generation_metadata, generation_sql
from .model import LABEL_DIMENSIONS, model
from .oracle_base import ELIGIBLE, alias_case, with_fixture
from .registry import query

KEY5 = ["request_id", "turn_index", "objective", "stance"]


def _dets(spark, sf):
    return model(spark, sf).domain.all_detections


@query("run_status", with_fixture("""
SELECT m.request_id, count(code) AS n_applicable, count(*) FILTER (WHERE code = 'X') AS n_x,
  CASE WHEN count(code) = 0 OR count(*) FILTER (WHERE code = 'X') = 0 THEN 'success'
       WHEN count(*) FILTER (WHERE code = 'X') = count(code) THEN 'error' ELSE 'partial' END AS detection_status
FROM fx_meta m LEFT JOIN fx_cells c ON c.request_id = m.request_id GROUP BY m.request_id"""))
def run_status(spark, sf):
    return D.run_status(_dets(spark, sf), model(spark, sf).domain.meta)


@query("run_totals", with_fixture("""
SELECT m.request_id, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS detection_total_latency_ms,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS detection_total_input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS detection_total_output_tokens
FROM fx_meta m LEFT JOIN fx_cells c ON c.request_id = m.request_id GROUP BY m.request_id"""))
def run_totals(spark, sf):
    return D.run_totals(_dets(spark, sf), model(spark, sf).domain.meta)


_CALL_ORD = " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(D.CALL_ORDER))


@query("error_counts", with_fixture(f"""
SELECT m.request_id, count(*) FILTER (WHERE code = 'X') AS detection_error_count,
  count(*) FILTER (WHERE code = 'E') AS detection_no_valid_count,
  coalesce(arg_max('call failed at turn ' || CAST(turn_index AS VARCHAR) || ' (' || objective || '__' || stance || ')',
                   turn_index * 10 + CASE stance {_CALL_ORD} END) FILTER (WHERE code = 'X'), '') AS detection_last_error
FROM fx_meta m LEFT JOIN fx_cells c ON c.request_id = m.request_id GROUP BY m.request_id"""))
def error_counts(spark, sf):
    return D.error_counts(_dets(spark, sf), model(spark, sf).domain.meta)


@query("stance_index", with_fixture("""
SELECT request_id, objective, array_to_string(list_sort(list(DISTINCT stance)), ',') AS fired_stances
FROM fx_cells WHERE code IN ('Y', 'S') GROUP BY request_id, objective"""))
def stance_index(spark, sf):
    return D.stance_index(_dets(spark, sf))


@query("postrun_summary", with_fixture(f"""
, g AS (SELECT objective || '__' || stance AS key, count(*) AS n_calls,
          count(*) FILTER (WHERE code = 'Y') AS n_Y, count(*) FILTER (WHERE code = 'N') AS n_N,
          count(*) FILTER (WHERE code = 'E') AS n_E, count(*) FILTER (WHERE code = 'X') AS n_X,
          avg(CASE WHEN code = 'Y' THEN p_detected END) AS mean_p_Y_on_Y,
          avg(CASE WHEN code = 'N' THEN p_detected END) AS mean_p_Y_on_N,
          avg(latency_ms) AS mean_lat_ms, avg(input_tokens) AS mean_in_tok, avg(output_tokens) AS mean_out_tok
        FROM fx_cells WHERE code IS NOT NULL GROUP BY 1),
grid AS (SELECT UNNEST({list(S.DETECTION_KEYS)}) AS key)
SELECT key, coalesce(n_calls, 0) AS n_calls, coalesce(n_Y, 0) AS n_Y, coalesce(n_N, 0) AS n_N,
  coalesce(n_E, 0) AS n_E, coalesce(n_X, 0) AS n_X,
  round(CASE WHEN n_Y + n_N > 0 THEN CAST(n_Y AS DOUBLE) / (n_Y + n_N) END, 6) AS Y_rate,
  round(mean_p_Y_on_Y, 6) AS mean_p_Y_on_Y, round(mean_p_Y_on_N, 6) AS mean_p_Y_on_N,
  round(mean_lat_ms, 6) AS mean_lat_ms, round(mean_in_tok, 6) AS mean_in_tok, round(mean_out_tok, 6) AS mean_out_tok
FROM grid LEFT JOIN g USING (key)"""))
def postrun_summary(spark, sf):
    return D.postrun_summary(_dets(spark, sf))


@query("calls_failed", with_fixture("""
SELECT (SELECT count(DISTINCT request_id) FROM fx_cells WHERE code = 'X') AS n_with_failed_call,
       (SELECT count(*) FROM fx_meta) AS n_conversations"""))
def calls_failed(spark, sf):
    return D.calls_failed(_dets(spark, sf), model(spark, sf).domain.meta)


def _some_cells(spark, sf):
    """The cells without those of conversations (id % 13 = 6) that were run
    before they had a turn to score."""
    return _dets(spark, sf).where(F.col("request_id").cast("long") % 13 != 6)


@query("run_summary", with_fixture("""
SELECT (SELECT count(*) FROM fx_meta) AS n_planned,
  (SELECT count(*) FROM fx_meta WHERE detection_status = 'success') AS n_success,
  (SELECT count(*) FROM fx_meta WHERE detection_status = 'partial') AS n_partial,
  (SELECT count(*) FROM fx_meta WHERE detection_status = 'error') AS n_error,
  count(*) AS n_calls, count(*) FILTER (WHERE code = 'Y') AS n_y, count(*) FILTER (WHERE code = 'N') AS n_n,
  count(*) FILTER (WHERE code = 'E') AS n_e, count(*) FILTER (WHERE code = 'X') AS n_x
FROM fx_cells WHERE code IS NOT NULL"""))
def run_summary(spark, sf):
    dets = _dets(spark, sf)
    meta = model(spark, sf).domain.meta
    return D.run_summary(meta, dets, D.run_status(dets, meta))


@query("decode_top10", with_fixture("""
, c AS (SELECT request_id, turn_index, objective, stance, code,
          CASE WHEN code <> 'X' THEN [
            {'token': 'maybe', 'logprob': ln(0.002), 'pos': 0},
            {'token': CASE WHEN code = 'E' THEN 'No' ELSE 'N' END, 'logprob': ln(p_not_detected), 'pos': 1},
            {'token': CASE WHEN code = 'E' THEN 'Yes' ELSE 'Y' END, 'logprob': ln(p_detected), 'pos': 2}] END AS cands
        FROM fx_cells),
u AS (SELECT request_id, turn_index, objective, stance, UNNEST(cands) AS x FROM c WHERE cands IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id, turn_index, objective, stance
                                   ORDER BY x.logprob DESC, x.pos) AS rk FROM u),
d AS (SELECT request_id, turn_index, objective, stance,
        arg_min(x.token, rk) FILTER (WHERE x.token IN ('Y', 'N')) AS first_yn,
        arg_max(round_even(exp(x.logprob), 3), rk) FILTER (WHERE x.token = 'Y') AS p_y,
        arg_max(round_even(exp(x.logprob), 3), rk) FILTER (WHERE x.token = 'N') AS p_n,
        arg_min(x.token, rk) AS top_token, count(*) AS n_top
      FROM r WHERE rk <= 10 GROUP BY ALL)
SELECT c.request_id, c.turn_index, c.objective, c.stance, c.code,
  CASE WHEN c.code = 'X' THEN 'X' ELSE coalesce(d.first_yn, 'E') END AS prediction,
  round(CASE WHEN c.code <> 'X' THEN coalesce(d.p_y, 0.0) END, 6) AS p_detected,
  round(CASE WHEN c.code <> 'X' THEN coalesce(d.p_n, 0.0) END, 6) AS p_not_detected,
  d.top_token, d.n_top
FROM c LEFT JOIN d USING (request_id, turn_index, objective, stance)"""))
def decode_top10(spark, sf):
    out = D.decode_top10(D.candidates_from_cells(_dets(spark, sf)))
    return out.select(*KEY5, "code", "prediction", "p_detected", "p_not_detected",
                      F.try_element_at("top10", F.lit(1))["token"].alias("top_token"),
                      F.size("top10").cast("long").alias("n_top"))


@query("detector_requests", with_fixture("""
SELECT request_id, turn_index, speaker,
  CASE WHEN turn_index % 2 = 1 THEN 'social_engineering' ELSE 'policy_violation' END AS objective,
  stance, (CASE WHEN turn_index % 2 = 1 THEN 'social_engineering' ELSE 'policy_violation' END) || '__' || stance AS detection_key
FROM (SELECT *, UNNEST(['high_precision', 'balanced', 'high_recall']) AS stance FROM fx_rows WHERE turn_index >= 1)"""))
def detector_requests(spark, sf):
    return D.detector_requests(model(spark, sf).domain.all_turns, D.stance_dim(spark))


@query("transcript_prefix", with_fixture("""
SELECT request_id, turn_index,
  array_to_string(list(CASE WHEN turn_index % 2 = 1 THEN 'Caller' ELSE 'Representative' END || ': ' || coalesce(passage, ''))
    OVER (PARTITION BY request_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    chr(10) || chr(10)) AS transcript
FROM fx_rows"""))
def transcript_prefix(spark, sf):
    return D.transcript_prefix(model(spark, sf).domain.text_turns.select("request_id", "turn_index", "passage"))


@query("detection_plan", with_fixture("""
SELECT request_id, conv_id AS ordinal, detection_status FROM fx_meta m
WHERE detection_status <> 'success' AND EXISTS (SELECT 1 FROM fx_rows r WHERE r.conv_id = m.conv_id)"""))
def detection_plan(spark, sf):
    dom = model(spark, sf).domain
    gen = dom.meta.select("request_id", F.col("conv_id").alias("ordinal"), "detection_status")
    return D.detection_plan(gen, dom.meta, dom.all_turns)


@query("normalize_predictions", with_fixture("""
SELECT request_id, turn_index, objective, stance, code,
  CAST(CASE WHEN trim(code) = 'Y' THEN 1 WHEN trim(code) = 'N' THEN 0 END AS BIGINT) AS pred FROM fx_cells"""))
def normalize_predictions(spark, sf):
    return _dets(spark, sf).select(*KEY5, "code", normalize_prediction(F.col("code")).alias("pred"))


@query("prediction_violations", with_fixture(f"""
SELECT request_id, turn_index, objective, stance, code, pred,
  CASE WHEN {ELIGIBLE} AND pred IS NULL THEN 'eligible turn without a 0/1 prediction: code ' || coalesce(code, 'null')
       WHEN NOT {ELIGIBLE} AND pred IS NOT NULL THEN 'prediction on an ineligible turn' END AS reason
FROM fx_cells
WHERE ({ELIGIBLE} AND pred IS NULL) OR (NOT {ELIGIBLE} AND pred IS NOT NULL)"""))
def prediction_violations(spark, sf):
    return D.prediction_violations(_dets(spark, sf))


@query("success_filter", with_fixture("""
SELECT request_id, detection_status, n_e, (SELECT count(*) FROM fx_meta WHERE detection_status <> 'success') AS n_dropped
FROM fx_meta WHERE detection_status = 'success'"""))
def success_filter(spark, sf):
    """P1 as a write; the number dropped is observed in the same pass."""
    seen = Observation("success_filter")
    kept = V.success_filter(model(spark, sf).domain.meta, seen).select("request_id", "detection_status", "n_e")
    out = written(kept, "kept")
    return out.withColumn("n_dropped", F.lit(seen.get["n_dropped"]).cast("long"))


@query("pending_requests", with_fixture(
    "SELECT request_id, detection_status FROM fx_meta WHERE detection_status <> 'success'"))
def pending_requests(spark, sf):
    return model(spark, sf).domain.meta.filter(F.col("detection_status") != S.STATUS_SUCCESS) \
        .select("request_id", "detection_status")


# the six per-turn analysis fields (prediction carries the raw code)
WIDE_FIELDS = (("prediction", "code"), ("p_detected", "p_detected"), ("p_not_detected", "p_not_detected"),
               ("latency_ms", "latency_ms"), ("input_tokens", "input_tokens"),
               ("output_tokens", "output_tokens"))


def _wide_sql() -> str:
    cols = []
    for k in S.DETECTION_KEYS:
        obj, st = k.split("__")
        for f, src in (*WIDE_FIELDS, ("top10", "top10")):
            cells = f"list({{'t': turn_index, 'v': {src}}}) FILTER (WHERE objective = '{obj}' AND stance = '{st}')"
            cols.append(f"CAST(to_json(list_transform(range(any_value(n_turns)), lambda i: "
                        f"(list_filter({cells}, lambda e: e.t = i))[1].v)) AS VARCHAR) AS {k}__{f}")
    run = {"detection_model": f"'{FXT.DETECTION_MODEL}'", "detection_started_at_utc": f"'{RUN_TIMES[0]}'",
           "detection_finished_at_utc": f"'{RUN_TIMES[1]}'"}
    prob = "round_even({}, 3)"
    return with_fixture(generation_sql() + f"""
, c AS (SELECT f.*, CASE WHEN code <> 'X' THEN CAST(json_array(
          json_array(CASE WHEN code = 'E' THEN (CASE WHEN p_detected > p_not_detected THEN 'Yes' ELSE 'No' END)
                          WHEN p_detected > p_not_detected THEN 'Y' ELSE 'N' END,
                     {prob.format('greatest(p_detected, p_not_detected)')}),
          json_array(CASE WHEN code = 'E' THEN (CASE WHEN p_detected > p_not_detected THEN 'No' ELSE 'Yes' END)
                          WHEN p_detected > p_not_detected THEN 'N' ELSE 'Y' END,
                     {prob.format('least(p_detected, p_not_detected)')})) AS JSON) END AS top10
      FROM fx_cells f WHERE conv_id % 13 <> 6),
w AS (SELECT m.request_id, any_value(m.turn_count_value) AS n_turns, {", ".join(cols)},
        count(code) AS n_app, count(*) FILTER (WHERE code = 'X') AS detection_error_count,
        count(*) FILTER (WHERE code = 'E') AS detection_no_valid_count,
        CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS detection_total_latency_ms,
        CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS detection_total_input_tokens,
        CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS detection_total_output_tokens,
        coalesce(arg_max('call failed at turn ' || CAST(turn_index AS VARCHAR) || ' (' || objective || '__' || stance || ')',
                         turn_index * 10 + CASE stance {_CALL_ORD} END) FILTER (WHERE code = 'X'), '') AS detection_last_error
      FROM (SELECT *, turn_count_value AS n_turns FROM fx_meta) m LEFT JOIN c USING (conv_id) GROUP BY m.request_id)
SELECT g.* RENAME ({", ".join(f"{x} AS generation_{x}" for x in S.AMBIGUOUS_GENERATION_COLUMNS)}),
  w.* EXCLUDE (request_id, n_app, n_turns), {", ".join(f"{v} AS {n}" for n, v in run.items())},
  CASE WHEN n_app = 0 OR detection_error_count = 0 THEN 'success'
       WHEN detection_error_count = n_app THEN 'error' ELSE 'partial' END AS detection_status,
  row_number() OVER (ORDER BY CASE WHEN CAST(request_id AS BIGINT) % 11 <> 3 THEN CAST(request_id AS BIGINT) END
                     NULLS LAST, request_id) AS place
FROM generation g JOIN w USING (request_id)""".replace("any_value(n_turns)", "any_value(m.n_turns)"))


RUN_TIMES = ("2025-07-01T00:00:00Z", "2025-07-01T01:00:00Z")


@query("export_wide_metadata", _wide_sql())
def export_wide_metadata(spark, sf):
    """The whole detection metadata, written in generation order and read
    back with each row's place; rows that the generation file has no more
    (id % 11 = 3) come last. Some conversations (id % 13 = 6) have no cell."""
    gen, det = generation_metadata(spark, sf), _some_cells(spark, sf)
    decoded = D.decode_top10(D.candidates_from_cells(det)).select(
        "request_id", "turn_index", "objective", "stance",
        F.filter("top10", lambda x: x["token"] != "maybe").alias("top10"))
    cells = det.join(decoded, ["request_id", "turn_index", "objective", "stance"]).withColumn("top10", D.pair_list(F.col("top10")))
    rows = ST.detection_metadata(gen, cells, FXT.DETECTION_MODEL, *RUN_TIMES, D.run_columns_aggs(), D.status_from_counts)
    file = gen.select("request_id", F.col("request_id").cast("long").alias("ordinal")).where(F.col("ordinal") % 11 != 3)
    path = scratch_path(spark, "detection-metadata")
    ST.export_order(rows, file).write.parquet(path)
    back = spark.read.parquet(path)
    at = Window.orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return back.withColumn("place", F.row_number().over(at).cast("long"))


@query("sink_detection_store", with_fixture("""
SELECT request_id, objective || '__' || stance AS detection_key, turn_index,
  CASE WHEN turn_index % 2 = 1 THEN 'caller' ELSE 'representative' END AS speaker, code AS prediction,
  latency_ms, input_tokens, output_tokens,
  CASE WHEN code <> 'X' THEN 3 END AS n_candidates,
  CASE WHEN code = 'X' THEN 'call failed at turn ' || CAST(turn_index AS VARCHAR) || ' (' || objective || '__' || stance || ')' END
    AS error
FROM fx_cells"""))
def sink_detection_store(spark, sf):
    """The nested detection store written as JSON Lines and read back to cells."""
    dom = model(spark, sf).domain
    det = dom.all_detections
    decoded = D.decode_top10(D.candidates_from_cells(det)).select("request_id", "turn_index", "objective", "stance", "top10")
    path = scratch_path(spark, "detections")
    full = det.join(decoded, ["request_id", "turn_index", "objective", "stance"])
    ST.write_detection_store(full, dom.meta, path, D.error_message(full))
    back = ST.read_detection_store(spark, path)
    return back.select("request_id", "detection_key", "turn_index", "speaker", "prediction", "latency_ms", "input_tokens",
                       "output_tokens", F.when(F.col("top10").isNotNull(), F.size("top10")).cast("int").alias("n_candidates"), "error")


@query("n_turns", with_fixture("SELECT request_id, count(*) AS n_turns FROM fx_rows GROUP BY request_id"))
def n_turns(spark, sf):
    return V.n_turns(model(spark, sf).domain.all_turns)


@query("speaker_turns", with_fixture("SELECT request_id, turn_index, speaker FROM fx_rows"))
def speaker_turns(spark, sf):
    return model(spark, sf).domain.all_turns.select("request_id", "turn_index", "speaker")


@query("eligible_turns", with_fixture("""
SELECT request_id, turn_index, CASE WHEN turn_index % 2 = 1 THEN 'social_engineering' ELSE 'policy_violation' END AS objective
FROM fx_rows WHERE turn_index >= 1"""))
def eligible_turns(spark, sf):
    t = model(spark, sf).domain.all_turns
    return t.select("request_id", "turn_index", objective_of_turn(F.col("turn_index")).alias("objective")) \
        .filter(F.col("objective").isNotNull())


@query("turn_contiguity", with_fixture("""
SELECT request_id, count(*) AS n_rows, count(DISTINCT turn_index) AS n_distinct,
  min(turn_index) AS min_turn, max(turn_index) AS max_turn,
  (min(turn_index) = 0 AND count(DISTINCT turn_index) = count(*) AND max(turn_index) = count(*) - 1) AS contiguous
FROM fx_raw GROUP BY request_id"""))
def turn_contiguity(spark, sf):
    raw = FXT.raw_turns(spark, sf).select(F.col("conv_id").cast("string").alias("request_id"),
                                          "turn_index")
    return V.turn_contiguity(raw)


_FAULTY_LIST = f"{S.DETECTION_KEYS[0]}__{WIDE_FIELDS[0][0]}"


@query("list_length_violations", with_fixture(f"""
SELECT request_id, '{_FAULTY_LIST}' AS key,
  CASE WHEN conv_id % 17 = 3 THEN turn_count_value - 1 END AS list_length, turn_count_value AS n_turns
FROM fx_meta WHERE conv_id % 17 = 3 OR conv_id % 19 = 4"""))
def list_length_violations(spark, sf):
    """P9 over the wide lists, one of which is cut short or null in some conversations."""
    dom = model(spark, sf).domain
    wide = ST.wide_lists(dom.all_detections, dom.meta, WIDE_FIELDS, as_json=False).join(
        dom.meta.select("request_id", "conv_id", "turn_count_value"), "request_id")
    c, n = F.col("conv_id"), F.col("turn_count_value").cast("int")
    faulty = F.when(c % 17 == 3, F.slice(_FAULTY_LIST, F.lit(1), n - 1)).when(c % 19 != 4, F.col(_FAULTY_LIST))
    return V.list_length_violations(wide.withColumn(_FAULTY_LIST, faulty), "turn_count_value",
                                    [f"{k}__{f}" for k in S.DETECTION_KEYS for f, _ in WIDE_FIELDS])


def _short_sql() -> str:
    return "SELECT request_id, short_representative, short_benign_context, short_cialdini_emphasis FROM fx_meta"


@query("short_labels", with_fixture(_short_sql()))
def short_labels(spark, sf):
    m = model(spark, sf).domain.meta
    from .model import short_label_columns
    return m.select("request_id", *short_label_columns(m))


@query("label_leakage", with_fixture("""
, x AS (SELECT 'short_representative' AS target, short_representative AS v FROM fx_meta
        WHERE short_representative NOT IN ('by_book', 'tired', 'helpful', 'distracted')
        UNION ALL SELECT 'short_benign_context', short_benign_context FROM fx_meta
        WHERE short_benign_context NOT IN ('minimal', 'moderate', 'heavy')
        UNION ALL SELECT 'short_cialdini_emphasis', short_cialdini_emphasis FROM fx_meta
        WHERE short_cialdini_emphasis NOT IN ('reciprocity', 'commitment_consistency', 'social_proof',
                                              'authority', 'liking', 'scarcity', 'unity'))
SELECT target, count(DISTINCT v) AS n_unrecognized,
       array_to_string(list_sort(list(DISTINCT v))[1:3], ' | ') AS first_values
FROM x GROUP BY target"""))
def label_leakage(spark, sf):
    m = model(spark, sf).domain.meta
    from .model import short_label_columns
    return V.label_leakage(m.select("request_id", *short_label_columns(m)),
                           {f"short_{d}": S.canonical_labels(d) for d in LABEL_DIMENSIONS})


@query("alias_theta", with_fixture(" UNION ALL ".join(
    f"SELECT request_id, '{d}' AS dimension, {alias_case(d, d)} AS label FROM fx_meta"
    f" WHERE {alias_case(d, d)} IS NOT NULL" for d in LABEL_DIMENSIONS)))
def alias_theta(spark, sf):
    from ..operators.labels import alias_table, alias_theta_join
    m = model(spark, sf).domain.meta
    out = None
    for d in LABEL_DIMENSIONS:
        j = alias_theta_join(m.select("request_id", F.col(d).alias("text")), alias_table(spark, d)) \
            .select("request_id", F.lit(d).alias("dimension"), "label")
        out = j if out is None else out.unionByName(j)
    return out


@query("dataset_summary", with_fixture("""
SELECT prompt_template_key AS run_label, count(*) AS n_conversations,
  count(*) FILTER (WHERE detection_status = 'success' AND n_e = 0) AS n_kept,
  count(*) FILTER (WHERE NOT (detection_status = 'success' AND n_e = 0)) AS n_dropped,
  CAST(sum(CASE WHEN detection_status = 'success' AND n_e = 0 THEN turn_count_value ELSE 0 END) AS BIGINT) AS n_turn_rows
FROM fx_meta GROUP BY 1"""))
def dataset_summary(spark, sf):
    return V.dataset_summary(model(spark, sf).domain.meta)


@query("dataset_labels", with_fixture("""
SELECT prompt_template_key AS run_label, short_cialdini_emphasis AS label, count(*) AS n_conversations
FROM fx_meta WHERE detection_status = 'success' AND n_e = 0 GROUP BY 1, 2"""))
def dataset_labels(spark, sf):
    m = model(spark, sf).domain.meta
    from .model import short_label_columns
    return V.dataset_labels(m.select("*", *short_label_columns(m)))


@query("stance_catalogue", with_fixture("""
SELECT stance, CAST(min(CASE stance WHEN 'high_precision' THEN 1 WHEN 'high_recall' THEN 2 WHEN 'balanced' THEN 3 END) AS BIGINT) AS ord
FROM fx_cells GROUP BY stance"""))
def stance_catalogue(spark, sf):
    return V.stance_catalogue(_dets(spark, sf), D.CALL_ORDER)


@query("meta_conv_join", with_fixture("""
SELECT m.request_id, count(*) AS n_turns, any_value(m.detection_status) AS detection_status,
  (SELECT count(*) FROM fx_meta WHERE conv_id % 17 = 5) AS n_missing,
  (SELECT min(request_id) FROM fx_meta WHERE conv_id % 17 = 5) AS first_missing
FROM fx_meta m JOIN fx_rows r USING (conv_id) WHERE conv_id % 17 <> 5 GROUP BY m.request_id"""))
def meta_conv_join(spark, sf):
    """J1 with some conversations (id % 17 = 5) gone from the store; the ids
    without one are observed in the same pass."""
    d = model(spark, sf).domain
    stored = d.all_turns.where(F.col("request_id").cast("long") % 17 != 5).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_turns"))
    seen = Observation("meta_conv_join")
    out = written(V.meta_conv_join(d.meta.select("request_id", "detection_status"), stored, seen), "joined")
    return out.select("request_id", "n_turns", "detection_status", F.lit(seen.get["n_missing"]).cast("long").alias("n_missing"),
                      F.lit(seen.get["first_missing"]).alias("first_missing"))
