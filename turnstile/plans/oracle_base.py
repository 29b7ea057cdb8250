"""DuckDB oracle: the fixture rules and the analysis facts as plain SQL CTEs.

Independent of the Spark code path on purpose (SQL text over the raw driver
tables), so a matching result is evidence both are right. Only the shared
constants in ``schema``/``fixture`` and the integer hash text are reused.
"""

from __future__ import annotations

from .. import schema as S
from ..functions.columns import mix_expr
from ..sources import fixture as FXT


def _lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _case_map(expr: str, table: dict[str, str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in table.items()) + " END"


def mix(k: str | int) -> str:
    return mix_expr("conv_id", "turn_index", str(k))


def alias_case(raw: str, dimension: str) -> str:
    """Longest-alias CASE chain (ties in declaration order); NULL when no hit."""
    whens = " ".join(f"WHEN contains(lower({raw}), {_lit(a)}) THEN {_lit(lab)}"
                     for a, lab in S.flat_aliases(S.aliases_for(dimension)))
    return f"CASE {whens} END"


def short_label_sql(dimension: str, key: str, sel: str, raw: str) -> str:
    nb = lambda c: f"CASE WHEN length(trim({c})) > 0 THEN trim({c}) END"
    return (f"coalesce({nb(key)}, {nb(sel)}, CASE WHEN {raw} IS NULL THEN 'unknown' "
            f"ELSE coalesce({alias_case(raw, dimension)}, trim({raw})) END)")


def _threshold_case() -> str:
    parts = " ".join(
        f"WHEN {_lit(st)} THEN (CASE WHEN threat THEN {t} ELSE {b} END)"
        for st, (t, b) in FXT.FIRE_THRESHOLD.items())
    return f"CASE stance {parts} END"


def _flag_cols() -> str:
    cols = []
    for k, f in enumerate(S.CALLER_FLAGS):
        cols.append(f"CASE WHEN turn_index % 2 = 1 THEN ({mix(k)} < CASE WHEN threat THEN "
                    f"{FXT.CALLER_FLAG_RATE[0]} ELSE {FXT.CALLER_FLAG_RATE[1]} END) END AS {f}")
    for k, f in enumerate(S.VIOLATION_FLAGS):
        cols.append(f"CASE WHEN turn_index >= 2 AND turn_index % 2 = 0 THEN ({mix(7 + k)} < "
                    f"CASE WHEN threat THEN {FXT.VIOLATION_FLAG_RATE[0]} ELSE "
                    f"{FXT.VIOLATION_FLAG_RATE[1]} END) END AS {f}")
    return ",\n    ".join(cols)


def _int_flags() -> str:
    cols = []
    for f in S.CALLER_FLAGS:
        cols.append(f"CASE WHEN turn_index % 2 = 1 THEN CAST(coalesce({f}, false) AS BIGINT) ELSE 0 END AS {f}")
    for f in S.VIOLATION_FLAGS:
        cols.append(f"CASE WHEN turn_index >= 2 AND turn_index % 2 = 0 THEN "
                    f"CAST(coalesce({f}, false) AS BIGINT) ELSE 0 END AS {f}")
    anyv = " OR ".join(f"coalesce({f}, false)" for f in S.VIOLATION_FLAGS)
    cols.append(f"CASE WHEN turn_index >= 2 AND turn_index % 2 = 0 THEN CAST(({anyv}) AS BIGINT) "
                f"ELSE 0 END AS any_violation")
    return ",\n    ".join(cols)


def _conv_aggs() -> str:
    mid = "(2 * ((n_turns // 2) // 2) + 1)"
    a = ["any_value(n_turns) AS n_turns",
         "count(*) FILTER (WHERE turn_index % 2 = 1) AS n_caller_turns",
         "count(*) FILTER (WHERE turn_index % 2 = 0) AS n_rep_turns_total",
         "greatest(count(*) FILTER (WHERE turn_index % 2 = 0) - 1, 0) AS n_rep_response_turns"]
    for c in S.ALL_FLAGS + ("any_violation",):
        a.append(f"CAST(sum({c}) AS BIGINT) AS total_{c}")
    for c in S.VIOLATION_FLAGS:
        a.append(f"min(CASE WHEN {c} = 1 THEN turn_index END) AS first_violation_turn__{c}")
    a.append("min(CASE WHEN any_violation = 1 THEN turn_index END) AS first_violation_turn__any")
    for c in S.CALLER_FLAGS:
        a.append(f"min(CASE WHEN {c} = 1 THEN turn_index END) AS first_occurrence_turn__{c}")
        a.append(f"CAST(sum(CASE WHEN n_turns // 2 > 0 AND turn_index < {mid} THEN {c} ELSE 0 END) "
                 f"AS BIGINT) AS early_count_{c}")
        a.append(f"CAST(sum(CASE WHEN n_turns // 2 > 0 AND turn_index >= {mid} THEN {c} ELSE 0 END) "
                 f"AS BIGINT) AS late_count_{c}")
    return ",\n    ".join(a)


def _pap_aggs() -> str:
    a = []
    for v in S.VIOLATION_FLAGS:
        a.append(f"CAST(sum(CASE WHEN f.turn_index < k.first_prediction_turn THEN f.{v} ELSE 0 END) AS BIGINT) AS violations_pre__{v}")
        a.append(f"CAST(sum(CASE WHEN f.turn_index = k.first_prediction_turn THEN f.{v} ELSE 0 END) AS BIGINT) AS violations_at__{v}")
        a.append(f"CAST(sum(CASE WHEN f.turn_index > k.first_prediction_turn THEN f.{v} ELSE 0 END) AS BIGINT) AS violations_post__{v}")
    return ",\n    ".join(a)


ELIGIBLE = ("((objective = 'social_engineering' AND turn_index >= 1 AND turn_index % 2 = 1) OR "
            "(objective = 'policy_violation' AND turn_index >= 2 AND turn_index % 2 = 0))")


def _ctes() -> str:
    emph = f"list_extract({_list(S.PRINCIPLES)}, CAST(conv_id % 7 AS INTEGER) + 1)"
    rep = f"list_extract({_list(FXT.REPRESENTATIVE_ORDER)}, CAST((conv_id % 5) % 4 AS INTEGER) + 1)"
    ctx = f"list_extract({_list(FXT.CONTEXT_ORDER)}, CAST(conv_id % 3 AS INTEGER) + 1)"
    j = "(CASE WHEN turn_index % 2 = 1 THEN 3 ELSE 0 END + si)"
    stance_rows = ", ".join(f"{{'stance': {_lit(s)}, 'si': {i}}}" for i, s in enumerate(S.STANCES))
    return f"""
fx_raw AS (
  SELECT conv_id, turn AS turn_index, text AS passage,
         CAST(conv_id AS VARCHAR) AS request_id, (conv_id % 2 = 0) AS threat
  FROM conversations),
fx_rows AS (
  SELECT conv_id, request_id, turn_index, passage, threat,
    CASE WHEN turn_index % 2 = 1 THEN 'caller' ELSE 'representative' END AS speaker,
    {_flag_cols()}
  FROM fx_raw),
fx_cells0 AS (
  SELECT conv_id, request_id, turn_index, threat, s.stance AS stance, s.si AS si,
    CASE WHEN turn_index % 2 = 1 THEN 'social_engineering' ELSE 'policy_violation' END AS objective
  FROM (SELECT *, UNNEST([{stance_rows}]) AS s FROM fx_raw WHERE turn_index >= 1)),
fx_cells1 AS (
  SELECT *,
    ({mix(f"(10 + {j})")} < {_threshold_case()}) AS fires,
    ((conv_id % 33 = 16) OR (conv_id % 11 = 5 AND turn_index = 1 AND stance = 'balanced')) AS x_code,
    (conv_id % 13 = 6 AND turn_index % 5 = 3 AND stance = 'high_precision') AS e_code,
    {mix(f"(40 + {j})")} % 401 AS p_off,
    {mix(f"(50 + {j})")} % 721 AS lat_off,
    {mix(f"(60 + {j})")} % 351 AS tok_off
  FROM fx_cells0),
fx_cells AS (
  SELECT conv_id, request_id, turn_index, objective, stance,
    CASE WHEN x_code THEN 'X' WHEN e_code THEN 'E' WHEN fires THEN 'Y' ELSE 'N' END AS code,
    CAST(CASE WHEN x_code OR e_code THEN NULL WHEN fires THEN 1 ELSE 0 END AS BIGINT) AS pred,
    CASE WHEN NOT x_code THEN CAST((CASE WHEN fires THEN 550 ELSE 50 END) + p_off AS DOUBLE) / 1000.0 END AS p_detected,
    CASE WHEN NOT x_code THEN CAST(1000 - ((CASE WHEN fires THEN 550 ELSE 50 END) + p_off) AS DOUBLE) / 1000.0 END AS p_not_detected,
    CAST(CASE WHEN NOT x_code THEN 80 + lat_off END AS BIGINT) AS latency_ms,
    CAST(CASE WHEN NOT x_code THEN 50 + tok_off END AS BIGINT) AS input_tokens,
    CAST(CASE WHEN NOT x_code THEN 1 END AS BIGINT) AS output_tokens
  FROM fx_cells1),
fx_agg AS (
  SELECT conv_id, count(*) AS turn_count_value, sum(length(passage)) AS n_chars
  FROM fx_raw GROUP BY conv_id),
fx_cagg AS (
  SELECT conv_id, count(*) AS n_cells, count(*) FILTER (WHERE code = 'X') AS n_x,
         count(*) FILTER (WHERE code = 'E') AS n_e
  FROM fx_cells GROUP BY conv_id),
fx_meta0 AS (
  SELECT a.conv_id, a.turn_count_value, a.n_chars,
    coalesce(c.n_cells, 0) AS n_cells, coalesce(c.n_x, 0) AS n_x, coalesce(c.n_e, 0) AS n_e,
    {emph} AS emph_label, {rep} AS rep_label, {ctx} AS ctx_label
  FROM fx_agg a LEFT JOIN fx_cagg c USING (conv_id)),
fx_meta1 AS (
  SELECT *,
    CASE WHEN conv_id % 3 = 2 AND conv_id % 23 = 11 THEN NULL
         WHEN conv_id % 3 = 2 AND conv_id % 19 = 17 THEN {_lit(FXT.UNRECOGNISED_EMPHASIS)}
         ELSE {_case_map('emph_label', FXT.PRINCIPLE_SENTENCES)} END AS cialdini_emphasis,
    {_case_map('rep_label', FXT.REPRESENTATIVE_SENTENCES)} AS representative,
    {_case_map('ctx_label', FXT.CONTEXT_SENTENCES)} AS benign_context,
    CASE WHEN conv_id % 3 = 0 THEN emph_label WHEN conv_id % 3 = 1 THEN '  ' END AS cialdini_emphasis_key,
    CASE WHEN conv_id % 3 = 1 THEN emph_label END AS sel_cialdini_emphasis_key,
    CASE WHEN conv_id % 4 = 0 THEN rep_label WHEN conv_id % 4 = 1 THEN '  ' END AS representative_key,
    CASE WHEN conv_id % 4 = 1 THEN rep_label END AS sel_representative_key,
    CASE WHEN conv_id % 5 = 0 THEN ctx_label WHEN conv_id % 5 = 1 THEN '  ' END AS benign_context_key,
    CASE WHEN conv_id % 5 = 1 THEN ctx_label END AS sel_benign_context_key
  FROM fx_meta0),
fx_meta AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS request_id, CAST(0 AS BIGINT) AS replicate_index,
    CASE WHEN conv_id % 2 = 0 THEN 'threat' ELSE 'benign' END AS prompt_template_key,
    {_lit(FXT.SCENARIO)} AS scenario,
    representative, representative_key, sel_representative_key,
    CASE WHEN conv_id % 2 = 0 THEN {_lit(FXT.CALLERS[0])} ELSE {_lit(FXT.CALLERS[1])} END AS caller,
    benign_context, benign_context_key, sel_benign_context_key,
    cialdini_emphasis, cialdini_emphasis_key, sel_cialdini_emphasis_key,
    turn_count_value, 'flavor_' || CAST(conv_id % 8 AS VARCHAR) AS flavor,
    {_lit(FXT.GENERATION_MODEL)} AS generation_model,
    strftime(to_timestamp({FXT.EPOCH_SECONDS} + conv_id * 37), '%Y-%m-%dT%H:%M:%SZ') AS generated_at_utc,
    CAST(400 + (conv_id * 37) % 211 AS BIGINT) AS generation_input_tokens,
    CAST(n_chars // 4 AS BIGINT) AS generation_output_tokens,
    {_lit(FXT.DETECTION_MODEL)} AS detection_model,
    CASE WHEN n_cells = 0 OR n_x = 0 THEN 'success' WHEN n_x = n_cells THEN 'error'
         ELSE 'partial' END AS detection_status,
    n_cells, n_x, n_e,
    {short_label_sql('representative', 'representative_key', 'sel_representative_key', 'representative')} AS short_representative,
    {short_label_sql('benign_context', 'benign_context_key', 'sel_benign_context_key', 'benign_context')} AS short_benign_context,
    {short_label_sql('cialdini_emphasis', 'cialdini_emphasis_key', 'sel_cialdini_emphasis_key', 'cialdini_emphasis')} AS short_cialdini_emphasis
  FROM fx_meta1),
a_meta AS (
  SELECT * FROM fx_meta WHERE detection_status = 'success' AND n_e = 0),
a_turns AS (
  SELECT r.*, m.turn_count_value AS n_turns, m.prompt_template_key AS conversation_type
  FROM fx_rows r JOIN a_meta m USING (conv_id)),
a_flags AS (
  SELECT request_id, turn_index, n_turns, conversation_type, passage,
    {_int_flags()}
  FROM a_turns),
a_dets AS (
  SELECT c.*, m.prompt_template_key AS conversation_type, m.turn_count_value AS n_turns
  FROM fx_cells c JOIN a_meta m USING (conv_id)),
a_conv AS (
  SELECT request_id, conversation_type,
    {_conv_aggs()}
  FROM a_flags GROUP BY request_id, conversation_type),
a_cellkeys AS (
  SELECT request_id, objective, stance,
    min(CASE WHEN pred = 1 THEN turn_index END) AS first_prediction_turn,
    max(CASE WHEN pred = 1 THEN turn_index END) AS last_prediction_turn,
    count(*) FILTER (WHERE pred = 1) AS n_fired,
    count(pred) AS n_predicted,
    count(*) AS n_eligible,
    avg(CASE WHEN p_detected IS NOT NULL AND p_not_detected IS NOT NULL
             THEN p_detected - p_not_detected END) AS mean_confidence_margin
  FROM a_dets WHERE {ELIGIBLE} GROUP BY request_id, objective, stance),
a_key0 AS (
  SELECT c.request_id, o.objective, s.stance, k.first_prediction_turn, k.last_prediction_turn,
    coalesce(k.n_fired, 0) AS n_fired, coalesce(k.n_predicted, 0) AS n_predicted,
    coalesce(k.n_eligible, 0) AS n_eligible, k.mean_confidence_margin
  FROM a_conv c CROSS JOIN (SELECT UNNEST({_list(S.OBJECTIVES)}) AS objective) o
  CROSS JOIN (SELECT UNNEST({_list(S.STANCES)}) AS stance) s
  LEFT JOIN a_cellkeys k ON k.request_id = c.request_id AND k.objective = o.objective AND k.stance = s.stance),
a_key1 AS (
  SELECT k.*, c.conversation_type, c.n_turns, c.first_violation_turn__any,
    c.first_violation_turn__any - k.first_prediction_turn AS lead,
    CAST(k.n_fired AS DOUBLE) / ((c.n_turns - 1 - k.first_prediction_turn) // 2 + 1) AS persistence_rate
  FROM a_key0 k JOIN a_conv c USING (request_id)),
a_pap AS (
  SELECT k.request_id, k.objective, k.stance,
    {_pap_aggs()}
  FROM a_key0 k JOIN a_flags f USING (request_id)
  WHERE k.first_prediction_turn IS NOT NULL
  GROUP BY k.request_id, k.objective, k.stance),
a_key AS (
  SELECT k.*, {", ".join(f"p.violations_{w}__{v}" for v in S.VIOLATION_FLAGS for w in ("pre", "at", "post"))}
  FROM a_key1 k LEFT JOIN a_pap p USING (request_id, objective, stance)),
a_conv_l AS (
  SELECT c.*, m.short_representative, m.short_benign_context, m.short_cialdini_emphasis
  FROM a_conv c JOIN a_meta m USING (request_id)),
a_scores0 AS (
  SELECT s.request_id, s.conversation_type, s.total_any_violation, s.first_violation_turn__any AS fv,
    s.short_representative, s.short_benign_context, s.short_cialdini_emphasis, s.stance,
    se.first_prediction_turn AS se_first, pv.first_prediction_turn AS pv_first,
    pv.last_prediction_turn AS pv_last
  FROM (SELECT *, UNNEST({_list(S.STANCES)}) AS stance FROM a_conv_l) s
  LEFT JOIN a_key0 se ON se.request_id = s.request_id AND se.stance = s.stance AND se.objective = 'social_engineering'
  LEFT JOIN a_key0 pv ON pv.request_id = s.request_id AND pv.stance = s.stance AND pv.objective = 'policy_violation'),
a_scores AS (
  SELECT request_id, stance, short_representative, short_benign_context, short_cialdini_emphasis,
         'se_detection' AS scenario, CAST(conversation_type = 'threat' AS BIGINT) AS y_true,
         CAST(se_first IS NOT NULL AS BIGINT) AS score FROM a_scores0
  UNION ALL
  SELECT request_id, stance, short_representative, short_benign_context, short_cialdini_emphasis,
         'se_prevention', CAST(conversation_type = 'threat' AS BIGINT),
         CAST(CASE WHEN fv IS NULL THEN se_first IS NOT NULL ELSE coalesce(se_first < fv, false) END AS BIGINT)
  FROM a_scores0
  UNION ALL
  SELECT request_id, stance, short_representative, short_benign_context, short_cialdini_emphasis,
         'pv_detection', CAST(total_any_violation > 0 AS BIGINT),
         CAST(CASE WHEN pv_last IS NULL THEN false WHEN fv IS NULL THEN true ELSE pv_last >= fv END AS BIGINT)
  FROM a_scores0
  UNION ALL
  SELECT request_id, stance, short_representative, short_benign_context, short_cialdini_emphasis,
         'pv_on_time', CAST(total_any_violation > 0 AS BIGINT),
         CAST(CASE WHEN fv IS NULL THEN pv_first IS NOT NULL ELSE coalesce(pv_first = fv, false) END AS BIGINT)
  FROM a_scores0)"""


CTES = _ctes()


def with_fixture(body: str) -> str:
    """A complete oracle statement: the fixture/analysis CTEs, then ``body``
    (which may add its own CTEs by starting with ``, name AS (...)``)."""
    body = body.strip()
    if body.startswith(","):
        return "WITH " + CTES + body
    return "WITH " + CTES + "\n" + body


def roc_sql(slice_cols: tuple[str, ...], source: str = "a_scores") -> str:
    """Operating points + AUC per scenario × slice (window lag trapezoid)."""
    keys = ", ".join(("scenario",) + slice_cols)
    return f"""
, op AS (
  SELECT {keys}, stance,
    count(*) FILTER (WHERE y_true = 1) AS n_positive_conversations,
    count(*) FILTER (WHERE y_true = 0) AS n_negative_conversations,
    count(*) FILTER (WHERE y_true = 1 AND score = 1) AS tp,
    count(*) FILTER (WHERE y_true = 0 AND score = 1) AS fp
  FROM {source} GROUP BY {keys}, stance),
opr AS (
  SELECT *, CASE WHEN n_positive_conversations > 0 THEN CAST(tp AS DOUBLE) / n_positive_conversations END AS tpr,
            CASE WHEN n_negative_conversations > 0 THEN CAST(fp AS DOUBLE) / n_negative_conversations END AS fpr
  FROM op),
curve AS (
  SELECT {keys}, fpr, tpr FROM opr WHERE fpr IS NOT NULL AND tpr IS NOT NULL
  UNION ALL SELECT DISTINCT {keys}, 0.0, 0.0 FROM opr
  UNION ALL SELECT DISTINCT {keys}, 1.0, 1.0 FROM opr),
seg AS (
  SELECT {keys}, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2.0 AS area
  FROM curve WINDOW w AS (PARTITION BY {keys} ORDER BY fpr, tpr)),
auc AS (SELECT {keys}, coalesce(sum(area), 0.0) AS auc FROM seg GROUP BY {keys}),
summ AS (
  SELECT {keys}, any_value(n_positive_conversations) AS n_positive_conversations,
         any_value(n_negative_conversations) AS n_negative_conversations
  FROM opr GROUP BY {keys})
"""
