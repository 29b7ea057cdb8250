"""Analysis catalogue: Spark builders + DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import facts as FX
from ..operators import reports as RP
from ..operators import roc as R
from ..operators import validate as V
from ..sources import store as ST
from .model import model
from .oracle_base import ELIGIBLE, roc_sql, with_fixture
from .registry import query


def _cols(*names: str) -> str:
    return ", ".join(names)


# ---------------------------------------------------------------- §2.4 facts
TOTALS = [f"total_{c}" for c in S.ALL_FLAGS + ("any_violation",)]


@query("flag_totals", with_fixture(f"SELECT request_id, {_cols(*TOTALS)} FROM a_conv"))
def flag_totals(spark, sf):
    return model(spark, sf).conv_facts.select("request_id", *TOTALS)


SPEAKER = ["n_turns", "n_caller_turns", "n_rep_turns_total", "n_rep_response_turns"]


@query("speaker_counts", with_fixture(f"SELECT request_id, {_cols(*SPEAKER)} FROM a_conv"))
def speaker_counts(spark, sf):
    return model(spark, sf).conv_facts.select("request_id", *SPEAKER)


FV = [f"first_violation_turn__{v}" for v in S.VIOLATION_FLAGS] + ["first_violation_turn__any"]


@query("first_violation", with_fixture(f"SELECT request_id, {_cols(*FV)} FROM a_conv"))
def first_violation(spark, sf):
    return model(spark, sf).conv_facts.select("request_id", *FV)


FO = [f"first_occurrence_turn__{c}" for c in S.CALLER_FLAGS]


@query("first_occurrence", with_fixture(f"SELECT request_id, {_cols(*FO)} FROM a_conv"))
def first_occurrence(spark, sf):
    return model(spark, sf).conv_facts.select("request_id", *FO)


EL = [f"{w}_count_{c}" for c in S.CALLER_FLAGS for w in ("early", "late")]


@query("early_late", with_fixture(f"SELECT request_id, {_cols(*EL)} FROM a_conv"))
def early_late(spark, sf):
    return model(spark, sf).conv_facts.select("request_id", *EL)


KEY = ["request_id", "objective", "stance"]


@query("first_prediction", with_fixture(
    "SELECT request_id, objective, stance, first_prediction_turn FROM a_key"))
def first_prediction(spark, sf):
    return model(spark, sf).det_core.select(*KEY, "first_prediction_turn")


@query("lead_time", with_fixture(
    "SELECT request_id, objective, stance, first_prediction_turn, first_violation_turn__any, lead FROM a_key"))
def lead_time(spark, sf):
    return model(spark, sf).det_core.select(*KEY, "first_prediction_turn",
                                             "first_violation_turn__any", "lead")


PAP = [f"violations_{w}__{v}" for v in S.VIOLATION_FLAGS for w in ("pre", "at", "post")]


@query("pre_at_post", with_fixture(f"SELECT request_id, objective, stance, {_cols(*PAP)} FROM a_key"))
def pre_at_post(spark, sf):
    return model(spark, sf).det_facts.select(*KEY, *PAP)


@query("persistence", with_fixture(
    "SELECT request_id, objective, stance, n_fired, round(persistence_rate, 6) AS persistence_rate FROM a_key"))
def persistence(spark, sf):
    return model(spark, sf).det_core.select(*KEY, "n_fired", "persistence_rate")


@query("confidence_margin", with_fixture(
    "SELECT request_id, objective, stance, round(mean_confidence_margin, 6) AS mean_confidence_margin FROM a_key"))
def confidence_margin(spark, sf):
    return model(spark, sf).det_core.select(*KEY, "mean_confidence_margin")


@query("combined_first", with_fixture("""
SELECT request_id, stance, min(first_prediction_turn) AS first_prediction_turn,
       any_value(first_violation_turn__any) AS first_violation_turn__any,
       any_value(first_violation_turn__any) - min(first_prediction_turn) AS lead
FROM a_key GROUP BY request_id, stance"""))
def combined_first(spark, sf):
    return model(spark, sf).combined


@query("stance_concordance", with_fixture(f"""
, per_turn AS (
  SELECT request_id, objective, turn_index,
         min(CASE WHEN pred = 1 THEN 1 ELSE 0 END) = max(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS agree
  FROM a_dets GROUP BY request_id, objective, turn_index)
SELECT c.request_id, o.objective,
       count(*) FILTER (WHERE agree) AS stance_concordant_turns,
       count(*) FILTER (WHERE NOT agree) AS stance_discordant_turns
FROM a_conv c CROSS JOIN (SELECT UNNEST({list(S.OBJECTIVES)}) AS objective) o
LEFT JOIN per_turn p ON p.request_id = c.request_id AND p.objective = o.objective GROUP BY c.request_id, o.objective"""))
def stance_concordance(spark, sf):
    m = model(spark, sf)
    return FX.stance_concordance(m.domain.detections, m.conv_facts)


# ---------------------------------------------------------------- §2.6 windows
RUN = list(S.ALL_FLAGS + ("any_violation",))


@query("running_totals", with_fixture(
    "SELECT request_id, turn_index, "
    + ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS running_total_{c}" for c in RUN)
    + " FROM a_flags WINDOW w AS (PARTITION BY request_id ORDER BY turn_index "
      "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def running_totals(spark, sf):
    return FX.running_totals(model(spark, sf).domain.turns)


@query("cumulative_violation", with_fixture("""
SELECT request_id, turn_index,
  CASE WHEN turn_index >= 2 AND turn_index % 2 = 0 THEN
    max(any_violation) OVER (PARTITION BY request_id ORDER BY turn_index
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cumulative_any_violation
FROM a_flags"""))
def cumulative_violation(spark, sf):
    return model(spark, sf).turn_table.select("request_id", "turn_index", "cumulative_any_violation")


def _masked_sql() -> str:
    cols = []
    for f in S.CALLER_FLAGS:
        cols.append(f"CASE WHEN turn_index % 2 = 1 THEN {f} END AS {f}")
    for f in S.VIOLATION_FLAGS + ("any_violation",):
        cols.append(f"CASE WHEN turn_index >= 2 AND turn_index % 2 = 0 THEN {f} END AS {f}")
    return ", ".join(cols)


def _cell_sql() -> str:
    """The 36 prediction columns of a turn."""
    cols = []
    for k in S.DETECTION_KEYS:
        objective, stance = k.split("__")
        cols += [f"max({src}) FILTER (WHERE objective = '{objective}' AND stance = '{stance}' AND {ELIGIBLE}) AS {k}__{f}"
                 for f, src in FX.CELL_FIELDS.items()]
    return ", ".join(cols)


@query("turn_table", with_fixture(f"""
, cells AS (SELECT request_id, turn_index, {_cell_sql()} FROM fx_cells GROUP BY 1, 2),
t AS (SELECT request_id, conversation_type, turn_index,
  CASE WHEN turn_index % 2 = 1 THEN 'caller' ELSE 'representative' END AS speaker, n_turns,
  CAST(length(coalesce(passage, '')) AS BIGINT) AS passage_length, {_masked_sql()},
  CASE WHEN turn_index >= 2 AND turn_index % 2 = 0 THEN
    max(any_violation) OVER (PARTITION BY request_id ORDER BY turn_index
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cumulative_any_violation
FROM a_flags)
SELECT t.*, cells.* EXCLUDE (request_id, turn_index) FROM t LEFT JOIN cells USING (request_id, turn_index)"""))
def turn_table(spark, sf):
    m = model(spark, sf)
    return FX.with_predictions(m.turn_table, m.domain.detections)


@query("turns_from_lists", with_fixture(f"""
, cells AS (SELECT request_id, turn_index, {_cell_sql()} FROM fx_cells GROUP BY 1, 2)
SELECT r.request_id, r.turn_index, cells.* EXCLUDE (request_id, turn_index)
FROM fx_rows r LEFT JOIN cells USING (request_id, turn_index)"""))
def turns_from_lists(spark, sf):
    """P8 over the wide form: lists as JSON text, parsed and walked by turn."""
    d = model(spark, sf).domain
    fields = tuple((f, "code" if f == "prediction" else f) for f in S.PER_TURN_FIELDS)
    return FX.turns_from_lists(ST.wide_lists(d.all_detections, d.meta, fields), V.parse_list)


# ---------------------------------------------------------------- ROC family
@query("scenario_labels", with_fixture("""
SELECT request_id, conversation_type, CAST(conversation_type = 'threat' AS BIGINT) AS y_threat,
       CAST(total_any_violation > 0 AS BIGINT) AS y_violation FROM a_conv"""))
def scenario_labels(spark, sf):
    return R.scenario_labels(model(spark, sf).conv_facts)


@query("scenario_scores", with_fixture(
    "SELECT request_id, scenario, stance, y_true, score FROM a_scores"))
def scenario_scores(spark, sf):
    return model(spark, sf).scores()


@query("confusion_scenarios", with_fixture("""
, g AS (SELECT scenario, stance, y_true AS actual, score AS predicted, count(*) AS n
        FROM a_scores GROUP BY ALL),
grid AS (SELECT * FROM (SELECT UNNEST(['se_detection','se_prevention','pv_detection','pv_on_time']) AS scenario)
         , (SELECT UNNEST(['high_precision','balanced','high_recall']) AS stance)
         , (SELECT CAST(UNNEST([0, 1]) AS BIGINT) AS actual)
         , (SELECT CAST(UNNEST([0, 1]) AS BIGINT) AS predicted))
SELECT grid.*, coalesce(g.n, 0) AS n FROM grid LEFT JOIN g USING (scenario, stance, actual, predicted)"""))
def confusion_scenarios(spark, sf):
    return RP.confusion_scenarios(model(spark, sf).scores())


def _roc_points_sql(slice_cols: tuple[str, ...], overall: bool = False) -> str:
    keys = ", ".join(("scenario",) + slice_cols)
    label = "'overall' AS slice_label, " if overall else ""
    return with_fixture(roc_sql(slice_cols) + f"""
SELECT {keys}, {label}stance, n_positive_conversations, n_negative_conversations, tp, fp,
       round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(auc.auc, 6) AS auc
FROM opr JOIN auc USING ({keys})""")


def _auc_summary_sql(slice_cols: tuple[str, ...], out_label: str | None = None,
                     two_class_only: bool = False, overall: bool = False) -> str:
    keys = ", ".join(("scenario",) + slice_cols)
    auc = "auc.auc"
    if two_class_only:
        auc = f"CASE WHEN n_positive_conversations > 0 AND n_negative_conversations > 0 THEN {auc} END"
    sel = keys if out_label is None else f"scenario, {slice_cols[0]} AS {out_label}"
    if overall:
        sel += ", 'overall' AS slice_label"
    return with_fixture(roc_sql(slice_cols) + f"""
SELECT {sel}, n_positive_conversations, n_negative_conversations, round({auc}, 6) AS auc
FROM summ JOIN auc USING ({keys})""")


@query("operating_points", _roc_points_sql((), overall=True))
def operating_points(spark, sf):
    pts, _ = R.roc(model(spark, sf).scores())
    return pts.withColumn("slice_label", F.lit("overall"))


@query("auc_overall", _auc_summary_sql((), overall=True))
def auc_overall(spark, sf):
    _, summary = R.roc(model(spark, sf).scores())
    return summary.withColumn("slice_label", F.lit("overall"))


BREAKDOWNS = (("overall", None), ("cialdini_emphasis", "short_cialdini_emphasis"),
              ("benign_context", "short_benign_context"))


def _breakdown_sql(name: str, col: str | None) -> str:
    cols = (col,) if col else ()
    return with_fixture(roc_sql(cols) + f"""
SELECT scenario, '{name}' AS breakdown, {col or "'overall'"} AS slice_label,
       n_positive_conversations, n_negative_conversations, round_even(auc.auc, 3) AS auc
FROM summ JOIN auc USING ({", ".join(("scenario",) + cols)})""")


@query("auc_summary", " UNION ALL ".join(f"SELECT * FROM ({_breakdown_sql(*b)})" for b in BREAKDOWNS))
def auc_summary(spark, sf):
    """A28 report form: overall AUC and AUC by emphasis and by context, rounded
    to 3 dp (half-even)."""
    out = None
    for name, col in BREAKDOWNS:
        cols = (col,) if col else ()
        _, summary = R.roc(model(spark, sf).scores(cols), cols)
        rows = summary.select("scenario", F.lit(name).alias("breakdown"),
                              (F.col(col) if col else F.lit("overall")).alias("slice_label"),
                              "n_positive_conversations", "n_negative_conversations", F.bround("auc", 3).alias("auc"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _slice_query(name: str, col: str, dim: str):
    @query(name, _auc_summary_sql((col,), "slice_label"))
    def _q(spark, sf):
        _, summary = R.roc(model(spark, sf).scores((col,)), (col,))
        return (summary.select("scenario", F.col(col).alias("slice_label"),
                               "n_positive_conversations", "n_negative_conversations", "auc")
                .orderBy("scenario", R.canonical_order(F.col("slice_label"), dim), "slice_label"))
    return _q


_slice_query("auc_by_emphasis", "short_cialdini_emphasis", "cialdini_emphasis")
_slice_query("auc_by_context", "short_benign_context", "benign_context")
_slice_query("auc_by_representative", "short_representative", "representative")


@query("auc_heatmap", f"""
WITH h AS ({_auc_summary_sql(("short_benign_context", "short_cialdini_emphasis"), two_class_only=True)}),
r AS (SELECT DISTINCT scenario, short_benign_context FROM h),
c AS (SELECT DISTINCT scenario, short_cialdini_emphasis FROM h)
SELECT r.scenario, r.short_benign_context, c.short_cialdini_emphasis,
  coalesce(h.n_positive_conversations, 0) AS n_positive_conversations,
  coalesce(h.n_negative_conversations, 0) AS n_negative_conversations, h.auc
FROM r JOIN c USING (scenario) LEFT JOIN h ON h.scenario = r.scenario
  AND h.short_benign_context IS NOT DISTINCT FROM r.short_benign_context
  AND h.short_cialdini_emphasis IS NOT DISTINCT FROM c.short_cialdini_emphasis""")
def auc_heatmap(spark, sf):
    cols = ("short_benign_context", "short_cialdini_emphasis")
    return R.auc_heatmap(model(spark, sf).scores(cols), *cols)


# ---------------------------------------------------------------- reports
def _pct_sql(col: str) -> str:
    return ", ".join(f"round(quantile_cont({col}, {p}), 6) AS {RP.pct_label(p)}"
                     for p in S.DEFAULT_PERCENTILES)


@query("latency_percentiles", with_fixture(f"""
, d AS (SELECT objective || '__' || stance AS detection_key, UNNEST([conversation_type, 'combined']) AS conversation_type,
               latency_ms FROM a_dets WHERE latency_ms IS NOT NULL),
g AS (SELECT detection_key, conversation_type, count(*) AS n_turns_used, {_pct_sql('latency_ms')}
      FROM d GROUP BY ALL),
grid AS (SELECT * FROM (SELECT UNNEST({list(S.DETECTION_KEYS)}) AS detection_key),
                       (SELECT UNNEST(['threat', 'benign', 'combined']) AS conversation_type))
SELECT grid.detection_key, grid.conversation_type, coalesce(g.n_turns_used, 0) AS n_turns_used,
       {", ".join(RP.pct_label(p) for p in S.DEFAULT_PERCENTILES)}
FROM grid LEFT JOIN g USING (detection_key, conversation_type)"""))
def latency_percentiles(spark, sf):
    return RP.latency_percentiles(model(spark, sf).domain.detections)


@query("confusion_turns", with_fixture("""
, ct AS (SELECT request_id, turn_index,
           max(any_violation) OVER (PARTITION BY request_id ORDER BY turn_index
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
         FROM a_flags)
SELECT d.stance, CAST(ct.cum = 1 AS BIGINT) AS had_cumulative_violation,
       CAST(d.pred = 1 AS BIGINT) AS pv_predicted_positive, count(*) AS n
FROM a_dets d JOIN ct USING (request_id, turn_index)
WHERE d.objective = 'policy_violation' AND d.pred IS NOT NULL
GROUP BY ALL"""))
def confusion_turns(spark, sf):
    m = model(spark, sf)
    return RP.confusion_turns(m.conv_facts, m.domain.detections)


@query("coverage", with_fixture(f"""
, g AS (SELECT objective || '__' || stance AS detection_key, count(pred) AS n_eligible_turns,
               count(*) FILTER (WHERE pred IN (0, 1)) AS n_valid_predictions FROM a_dets GROUP BY 1),
grid AS (SELECT UNNEST({list(S.DETECTION_KEYS)}) AS detection_key)
SELECT detection_key, coalesce(n_eligible_turns, 0) AS n_eligible_turns,
       coalesce(n_valid_predictions, 0) AS n_valid_predictions,
       round(CASE WHEN coalesce(n_eligible_turns, 0) > 0
                  THEN CAST(n_valid_predictions AS DOUBLE) / n_eligible_turns END, 6) AS coverage
FROM grid LEFT JOIN g USING (detection_key)"""))
def coverage(spark, sf):
    return RP.coverage(model(spark, sf).domain.detections)


@query("recall_rules", with_fixture(f"""
, k AS (SELECT c.request_id, x.objective, x.stance
        FROM (SELECT request_id, UNNEST([{", ".join(f"{{'objective': '{o}', 'stance': '{s}'}}" for o in S.OBJECTIVES for s in S.STANCES)}]) AS x
              FROM a_conv WHERE conversation_type = 'threat') c),
f AS (SELECT k.objective, k.stance, coalesce(a.n_fired, 0) AS fired, a.n_predicted AS n
      FROM k LEFT JOIN a_key a USING (request_id, objective, stance)),
r AS (SELECT objective, stance, 'any' AS rule, fired >= 1 AS flagged FROM f
      UNION ALL SELECT objective, stance, 'two_or_more', fired >= 2 FROM f
      UNION ALL SELECT objective, stance, 'majority', coalesce(fired > n / 2.0, false) FROM f)
SELECT objective, stance, rule, count(*) AS n_threat_conversations,
       count(*) FILTER (WHERE flagged) AS n_flagged,
       round(CAST(count(*) FILTER (WHERE flagged) AS DOUBLE) / count(*), 6) AS recall
FROM r GROUP BY ALL"""))
def recall_rules(spark, sf):
    m = model(spark, sf)
    return RP.recall_rules(m.conv_facts, m.det_core)


def _hist_sql(values_cte: str, series: str, from_zero: bool = False) -> str:
    lo = "CASE WHEN min(value) IS NULL THEN NULL ELSE 0 END" if from_zero else "min(value)"
    return with_fixture(f"""
, v AS ({values_cte}),
summ AS (SELECT {series}, count(value) AS n_with, count(*) FILTER (WHERE value IS NULL) AS n_without,
                {lo} AS lo, max(value) AS hi FROM v GROUP BY ALL),
cnt AS (SELECT {series}, CAST(value AS BIGINT) AS bin, count(*) AS n_conversations
        FROM v WHERE value IS NOT NULL GROUP BY ALL),
bins AS (SELECT {series}, n_with, n_without,
                CASE WHEN lo IS NULL THEN NULL ELSE UNNEST(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) END AS bin
         FROM summ WHERE lo IS NOT NULL
         UNION ALL SELECT {series}, n_with, n_without, NULL FROM summ WHERE lo IS NULL)
SELECT bins.*, coalesce(cnt.n_conversations, 0) AS n_conversations
FROM bins LEFT JOIN cnt USING ({series}, bin)""")


_FV_VALUES = " UNION ALL ".join(
    f"SELECT UNNEST([conversation_type, 'combined']) AS conversation_filter, '{v}' AS violation_type, "
    f"first_violation_turn__{v} AS value FROM a_conv" for v in S.VIOLATION_TYPES)


@query("hist_first_violation", _hist_sql(_FV_VALUES, "conversation_filter, violation_type", from_zero=True))
def hist_first_violation(spark, sf):
    return RP.hist_first_violation(model(spark, sf).conv_facts)


def _per_stance_values_sql(column: str) -> str:
    keys = ", ".join(f"{{'objective': '{o}', 'stance': '{s}'}}" for o in S.OBJECTIVES for s in S.STANCES)
    comb = ("min(first_prediction_turn)" if column == "first_prediction_turn"
            else "any_value(first_violation_turn__any) - min(first_prediction_turn)")
    return f"""
SELECT UNNEST([conversation_type, 'combined']) AS conversation_filter, objective, stance, value FROM (
  SELECT c.conversation_type, c.x.objective AS objective, c.x.stance AS stance, a.{column} AS value
  FROM (SELECT request_id, conversation_type, UNNEST([{keys}]) AS x FROM a_conv) c
  LEFT JOIN a_key a ON a.request_id = c.request_id AND a.objective = c.x.objective AND a.stance = c.x.stance
  UNION ALL
  SELECT any_value(conversation_type), 'combined', stance, {comb}
  FROM a_key GROUP BY request_id, stance)"""


@query("hist_first_prediction", _hist_sql(_per_stance_values_sql("first_prediction_turn"),
                                          "conversation_filter, objective, stance", from_zero=True))
def hist_first_prediction(spark, sf):
    m = model(spark, sf)
    return RP.hist_first_prediction(m.conv_facts, m.det_core, m.combined)


@query("hist_lead", _hist_sql(_per_stance_values_sql("lead"), "conversation_filter, objective, stance"))
def hist_lead(spark, sf):
    m = model(spark, sf)
    return RP.hist_lead(m.conv_facts, m.det_core, m.combined)


@query("violations_by_rep", with_fixture(" UNION ALL ".join(
    f"""SELECT conversation_filter, representative, '{v}' AS violation_type, CAST(sum(total_{v}) AS BIGINT) AS total_count,
        count(*) AS n_conversations, round(CAST(sum(total_{v}) AS DOUBLE) / count(*), 6) AS mean_per_conversation
      FROM (SELECT *, short_representative AS representative,
                   UNNEST([conversation_type, 'combined']) AS conversation_filter FROM a_conv_l)
      GROUP BY conversation_filter, representative""" for v in S.VIOLATION_TYPES)))
def violations_by_rep(spark, sf):
    return RP.violations_by_rep(model(spark, sf).conv)


def _pap_mean_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT conversation_filter, objective, stance, '{v}' AS violation_type, "
        f'violations_pre__{v} AS "pre", violations_at__{v} AS "at", violations_post__{v} AS "post" FROM k'
        for v in S.VIOLATION_TYPES)
    return with_fixture(f"""
, k AS (SELECT *, UNNEST([conversation_type, 'combined']) AS conversation_filter FROM a_key
        WHERE first_prediction_turn IS NOT NULL),
x AS ({parts}),
g AS (SELECT conversation_filter, objective, stance, violation_type, avg("pre") AS "pre", avg("at") AS "at",
             avg("post") AS "post", count(*) AS n_conversations FROM x GROUP BY ALL),
grid AS (SELECT * FROM (SELECT UNNEST(['threat', 'benign', 'combined']) AS conversation_filter),
                       (SELECT UNNEST({list(S.OBJECTIVES)}) AS objective),
                       (SELECT UNNEST({list(S.STANCES)}) AS stance),
                       (SELECT UNNEST({list(S.VIOLATION_TYPES)}) AS violation_type))
SELECT grid.*, round(coalesce("pre", 0.0), 6) AS "pre", round(coalesce("at", 0.0), 6) AS "at",
       round(coalesce("post", 0.0), 6) AS "post", coalesce(n_conversations, 0) AS n_conversations
FROM grid LEFT JOIN g USING (conversation_filter, objective, stance, violation_type)""")


@query("pre_at_post_mean", _pap_mean_sql())
def pre_at_post_mean(spark, sf):
    return RP.pre_at_post_mean(model(spark, sf).det_facts)


@query("flow_edges", with_fixture("""
, j AS (SELECT c.conversation_type, se.stance AS se_stance, pv.stance AS pv_stance,
          CASE WHEN c.total_any_violation > 0 THEN 'violation' ELSE 'no_violation' END AS v,
          CASE WHEN se.first_prediction_turn IS NOT NULL THEN 'se_predicted' ELSE 'se_not_predicted' END AS s,
          CASE WHEN pv.first_prediction_turn IS NOT NULL THEN 'pv_predicted' ELSE 'pv_not_predicted' END AS p
        FROM a_conv c
        JOIN a_key se ON se.request_id = c.request_id AND se.objective = 'social_engineering'
        JOIN a_key pv ON pv.request_id = c.request_id AND pv.objective = 'policy_violation')
SELECT se_stance, pv_stance, conversation_type AS "from", v AS "to", count(*) AS "count" FROM j GROUP BY 1, 2, 3, 4
UNION ALL SELECT se_stance, pv_stance, v, s, count(*) FROM j GROUP BY 1, 2, 3, 4
UNION ALL SELECT se_stance, pv_stance, s, p, count(*) FROM j GROUP BY 1, 2, 3, 4"""))
def flow_edges(spark, sf):
    m = model(spark, sf)
    return RP.flow_edges(m.conv_facts, m.firsts)


@query("emphasis_matrix", with_fixture(
    "SELECT short_cialdini_emphasis AS prompted_emphasis, count(*) AS n_conversations, "
    + ", ".join(f"round(avg(total_cialdini_{p}), 6) AS {p}" for p in S.PRINCIPLES)
    + " FROM a_conv_l WHERE conversation_type = 'threat' GROUP BY 1"))
def emphasis_matrix(spark, sf):
    return RP.emphasis_matrix(model(spark, sf).conv)
