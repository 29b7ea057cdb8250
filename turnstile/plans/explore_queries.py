"""Explore / lookup, source round-trips and generic reports on the driver's
other tables (labels ⋈ documents, events)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import explore as X
from ..operators import reports as RP
from ..operators import roc as R
from ..operators import detect as D
from ..operators import grid as G
from ..session import scratch_path
from ..sources import fixture as FXT
from ..sources import store as ST
from ..operators import validate as V
from ..functions.columns import short_label
from .grid_queries import DEFECT_SQL, GEN_SQL, generation_metadata, generation_records, generation_sql
from .model import short_label_columns, model
from .oracle_base import _lit, with_fixture
from .registry import query

BY_BOOK = FXT.REPRESENTATIVE_SENTENCES["by_book"]


@query("match_conversations", with_fixture(f"""
SELECT request_id, prompt_template_key, representative FROM fx_meta m
WHERE prompt_template_key = 'threat' AND representative = {_lit(BY_BOOK)}
  AND EXISTS (SELECT 1 FROM fx_cells c WHERE c.request_id = m.request_id AND c.code IN ('Y', 'S')
              AND c.objective = 'social_engineering' AND c.stance = 'balanced')"""))
def match_conversations(spark, sf):
    d = model(spark, sf).domain
    idx = d.all_detections.filter(F.col("code").isin("Y", "S")).select("request_id", "objective", "stance")
    return X.match_conversations(d.meta, "threat", {"representative": BY_BOOK}, idx,
                                 {"social_engineering": "balanced", "policy_violation": X.WILDCARD}) \
        .select("request_id", "prompt_template_key", "representative")


TEMPLATE_DIMS = [("threat", "representative_key", "representative"),
                 ("threat", "cialdini_emphasis_key", "cialdini_emphasis"),
                 ("benign", "representative_key", "representative"),
                 ("benign", "benign_context_key", "benign_context")]
DIMS3 = ("representative", "benign_context", "cialdini_emphasis")


@query("template_options", with_fixture(f"""
, dv AS (SELECT DISTINCT * FROM (
           SELECT 'representative' AS dimension, short_representative AS key, representative AS value FROM fx_meta
           UNION ALL SELECT 'benign_context', short_benign_context, benign_context FROM fx_meta
           UNION ALL SELECT 'cialdini_emphasis', short_cialdini_emphasis, cialdini_emphasis FROM fx_meta)
         WHERE value IS NOT NULL),
td AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TEMPLATE_DIMS)}) t(template, field, dimension))
SELECT template, field, key, key || ': ' || left(value, 60) AS label FROM td JOIN dv USING (dimension)"""))
def template_options(spark, sf):
    m = model(spark, sf).domain.meta
    labelled = m.select(*DIMS3, *short_label_columns(m))
    dv = X.dimension_values(labelled, DIMS3)
    td = spark.createDataFrame(TEMPLATE_DIMS, "template string, field string, dimension string")
    return X.template_options(td, dv)


def _status_table(meta):
    c = F.col("conv_id")
    return meta.filter(c % 13 != 4).select(
        F.when(c % 17 == 8, F.lit("")).otherwise(F.col("request_id")).alias("request_id"),
        F.when(c % 10 == 3, F.lit(" Success ")).when(c % 10 == 7, F.lit(None))
         .otherwise(F.col("detection_status")).alias("detection_status"))


@query("suppress_broken", with_fixture("""
, st AS (SELECT CASE WHEN conv_id % 17 = 8 THEN '' ELSE request_id END AS request_id,
           CASE WHEN conv_id % 10 = 3 THEN ' Success ' WHEN conv_id % 10 = 7 THEN NULL ELSE detection_status END AS s
         FROM fx_meta WHERE conv_id % 13 <> 4),
bad AS (SELECT DISTINCT request_id FROM st WHERE request_id IS NOT NULL AND request_id <> ''
        AND coalesce(lower(trim(s)), '(null)') <> 'success')
SELECT request_id FROM fx_meta WHERE request_id NOT IN (SELECT request_id FROM bad)"""))
def suppress_broken(spark, sf):
    meta = model(spark, sf).domain.meta
    return X.suppress_broken(meta.select("request_id"), _status_table(meta))


@query("detections_by_turn", with_fixture("""
SELECT request_id, turn_index, objective, stance, code, round(p_detected, 6) AS p_detected,
       round(p_not_detected, 6) AS p_not_detected
FROM fx_cells WHERE code IS NOT NULL AND ((objective = 'social_engineering' AND stance = 'balanced')
  OR (objective = 'policy_violation' AND stance = 'high_recall'))"""))
def detections_by_turn(spark, sf):
    return X.detections_by_turn(model(spark, sf).domain.all_detections,
                                {"social_engineering": "balanced", "policy_violation": "high_recall"})


POOL_DIMS = ("representative", "caller", "benign_context", "cialdini_emphasis", "turn_count_value", "flavor")


@query("pool_values", with_fixture(GEN_SQL + " UNION ALL ".join(
    f"SELECT DISTINCT prompt_template_key, '{d}' AS dimension, CAST({d} AS VARCHAR) AS value "
    f"FROM gen WHERE {d} IS NOT NULL" for d in POOL_DIMS)))
def pool_values(spark, sf):
    recs = generation_records(model(spark, sf).domain.meta)
    return X.pool_values(recs, POOL_DIMS)


@query("random_match", with_fixture("""
SELECT prompt_template_key, arg_min(request_id, sha256('7|' || request_id)) AS request_id FROM fx_meta GROUP BY 1"""))
def random_match(spark, sf):
    return X.random_match(model(spark, sf).domain.meta, 7)


@query("random_stance", with_fixture(f"""
, k AS (SELECT request_id, UNNEST({list(S.OBJECTIVES)}) AS objective FROM fx_meta),
x AS (SELECT *, UNNEST({list(S.STANCES)}) AS stance FROM k),
y AS (SELECT x.*, EXISTS (SELECT 1 FROM fx_cells c WHERE c.request_id = x.request_id AND c.objective = x.objective
        AND c.stance = x.stance AND c.code IN ('Y', 'S')) AS hit,
      sha256('7|' || x.request_id || '|' || x.objective || '|' || x.stance) AS h FROM x)
SELECT request_id, objective, coalesce(arg_min(stance, h) FILTER (WHERE hit), arg_min(stance, h)) AS stance,
  bool_or(hit) AS fired FROM y GROUP BY 1, 2"""))
def random_stance(spark, sf):
    dom = model(spark, sf).domain
    return X.random_stance(dom.all_detections, dom.meta, 7)


@query("truncate_through", with_fixture(
    "SELECT request_id, turn_index, speaker, passage FROM fx_rows WHERE turn_index <= 3"))
def truncate_through(spark, sf):
    t = model(spark, sf).domain.text_turns.select("request_id", "turn_index", "speaker", "passage")
    return X.truncate_through(t, 3)


@query("records_by_time", with_fixture("SELECT request_id, generated_at_utc FROM fx_meta"))
def records_by_time(spark, sf):
    return X.records_by_time(model(spark, sf).domain.meta.select("request_id", "generated_at_utc"))


@query("record_captions", with_fixture("""
SELECT request_id, CASE WHEN length(concat_ws(' · ', prompt_template_key, nullif(sel_cialdini_emphasis_key, ''),
                                             nullif(sel_benign_context_key, ''))) > 0
  THEN '[' || left(request_id, 8) || '] ' || concat_ws(' · ', prompt_template_key,
                 nullif(sel_cialdini_emphasis_key, ''), nullif(sel_benign_context_key, ''))
  ELSE '[' || left(request_id, 8) || ']' END AS caption
FROM fx_meta"""))
def record_captions(spark, sf):
    m = model(spark, sf).domain.meta
    return m.select("request_id", X.record_caption(F.col("prompt_template_key"), F.col("selection"),
                                                    F.col("request_id")).alias("caption"))


@query("flavor_sample", with_fixture(GEN_SQL + """
, combos AS (SELECT DISTINCT prompt_template_key, representative, s.strategy
            FROM gen, (VALUES ('resampled'), ('deterministic')) s(strategy)),
pool AS (SELECT flavor, row_number() OVER (ORDER BY flavor) - 1 AS place FROM (SELECT DISTINCT flavor FROM gen)),
size AS (SELECT count(*) AS n FROM pool),
drawn AS (SELECT c.*, list_reduce([[]::BIGINT[], [0::BIGINT], [1::BIGINT]], lambda taken, k: list_append(taken,
    CASE WHEN list_contains(taken, ('0x' || substr(sha256(concat_ws('|', '11',
           CASE WHEN strategy = 'resampled' THEN prompt_template_key || '|' || representative END,
           k[1]::VARCHAR)), 1, 13))::BIGINT % (size.n - 2 + k[1] + 1)) THEN size.n - 2 + k[1]
         ELSE ('0x' || substr(sha256(concat_ws('|', '11',
           CASE WHEN strategy = 'resampled' THEN prompt_template_key || '|' || representative END,
           k[1]::VARCHAR)), 1, 13))::BIGINT % (size.n - 2 + k[1] + 1) END)) AS places
  FROM combos c, size)
SELECT strategy, prompt_template_key, representative, flavor
FROM (SELECT *, UNNEST(places) AS place FROM drawn) JOIN pool USING (place)"""))
def flavor_sample(spark, sf):
    recs = generation_records(model(spark, sf).domain.meta)
    combos = recs.select("prompt_template_key", "representative").distinct()
    out = None
    for strategy in G.FLAVOR_STRATEGIES:
        rows = G.flavor_sample(combos, recs.select("flavor"), 2, 11, strategy,
                               ["prompt_template_key", "representative"]).withColumn("strategy", F.lit(strategy))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("normalise_record", with_fixture("SELECT request_id, turn_index, speaker, passage AS text FROM fx_rows"))
def normalise_record(spark, sf):
    d = model(spark, sf).domain
    recs = ST.records_from_turns(d.text_turns, d.meta)
    n = X.normalise_record(recs)
    return n.select("request_id", F.explode("turns").alias("t")).select(
        "request_id", F.col("t.turn_index").cast("long").alias("turn_index"), "t.speaker", "t.text")


@query("custom_dims", with_fixture("""
SELECT DISTINCT * FROM (
  SELECT 'cialdini_emphasis' AS dimension, short_cialdini_emphasis AS key, cialdini_emphasis AS value
  FROM fx_meta WHERE cialdini_emphasis IS NOT NULL
  UNION ALL SELECT 'cialdini_emphasis', 'custom', 'custom text for ' || short_cialdini_emphasis
  FROM fx_meta WHERE short_cialdini_emphasis <> 'unity')"""))
def custom_dims(spark, sf):
    m = model(spark, sf).domain.meta
    labelled = m.select(*DIMS3, *short_label_columns(m))
    dv = X.dimension_values(labelled, ("cialdini_emphasis",))
    custom = labelled.select(F.lit("cialdini_emphasis").alias("dimension"), F.lit("custom").alias("key"),
                             F.when(F.col("short_cialdini_emphasis") == "unity", F.lit("  "))
                             .otherwise(F.concat(F.lit("custom text for "), F.col("short_cialdini_emphasis")))
                             .alias("value"))
    return X.custom_rows(dv, custom, "value").distinct()


# ---------------------------------------------------------------- generic data
THRESHOLDS = (1000, 1500, 2500)


def _doc_scores(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    j = labels.join(docs, "doc_id")
    arr = F.array(*[F.struct(F.lit(f"min_chars_{t}").alias("stance"),
                             (F.col("n_chars") >= t).cast("long").alias("score")) for t in THRESHOLDS])
    tgt = F.array(F.struct(F.lit("quality").alias("scenario"), F.col("quality").cast("long").alias("y_true")),
                  F.struct(F.lit("toxic").alias("scenario"), F.col("toxic").cast("long").alias("y_true")))
    return (j.select("n_chars", F.explode(tgt).alias("t")).select("n_chars", "t.*")
            .select("scenario", "y_true", F.explode(arr).alias("s")).select("scenario", "y_true", "s.*"))


def _doc_sql() -> str:
    pts = " UNION ALL ".join(
        f"SELECT scenario, y_true, 'min_chars_{t}' AS stance, CAST(n_chars >= {t} AS BIGINT) AS score FROM y"
        for t in THRESHOLDS)
    return f"""
, j AS (SELECT l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
y AS (SELECT 'quality' AS scenario, CAST(quality AS BIGINT) AS y_true, n_chars FROM j
      UNION ALL SELECT 'toxic', CAST(toxic AS BIGINT), n_chars FROM j),
doc_scores AS ({pts})"""


@query("roc_documents", with_fixture(_doc_sql() + """
, op AS (SELECT scenario, stance, count(*) FILTER (WHERE y_true = 1) AS n_positive_conversations,
           count(*) FILTER (WHERE y_true = 0) AS n_negative_conversations,
           count(*) FILTER (WHERE y_true = 1 AND score = 1) AS tp,
           count(*) FILTER (WHERE y_true = 0 AND score = 1) AS fp FROM doc_scores GROUP BY ALL),
opr AS (SELECT *, CASE WHEN n_positive_conversations > 0 THEN CAST(tp AS DOUBLE) / n_positive_conversations END AS tpr,
          CASE WHEN n_negative_conversations > 0 THEN CAST(fp AS DOUBLE) / n_negative_conversations END AS fpr FROM op),
curve AS (SELECT scenario, fpr, tpr FROM opr WHERE fpr IS NOT NULL AND tpr IS NOT NULL
          UNION ALL SELECT DISTINCT scenario, 0.0, 0.0 FROM opr UNION ALL SELECT DISTINCT scenario, 1.0, 1.0 FROM opr),
seg AS (SELECT scenario, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2.0 AS area
        FROM curve WINDOW w AS (PARTITION BY scenario ORDER BY fpr, tpr)),
auc AS (SELECT scenario, coalesce(sum(area), 0.0) AS auc FROM seg GROUP BY 1)
SELECT scenario, stance, n_positive_conversations, n_negative_conversations, tp, fp,
  round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(auc.auc, 6) AS auc
FROM opr JOIN auc USING (scenario)"""))
def roc_documents(spark, sf):
    pts, _ = R.roc(_doc_scores(spark, sf))
    return pts


@query("percentiles_events", f"""
SELECT grp AS event_type, count(*) AS n_used, {", ".join(
    f"round(quantile_cont(value, {p}), 6) AS {RP.pct_label(p)}" for p in S.DEFAULT_PERCENTILES)}
FROM (SELECT UNNEST([event_type, 'combined']) AS grp, value FROM events WHERE value IS NOT NULL)
GROUP BY grp""")
def percentiles_events(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "value")
    return RP.percentiles_by(ev, "event_type", "value")


# ---------------------------------------------------------------- sources
@query("src_store", with_fixture("SELECT request_id, turn_index, passage FROM fx_rows"))
def src_store(spark, sf):
    """S1 round trip: records written as a JSON store (JSON Lines) and read
    back with the declared record schema, then exploded to turns (P4)."""
    d = model(spark, sf).domain
    path = scratch_path(spark, "store")
    ST.write_store(ST.records_from_turns(d.text_turns, d.meta), path, jsonl=True)
    recs = ST.read_store(spark, path, jsonl=True)
    return ST.explode_turns(recs).select("request_id", "turn_index", "passage")


@query("src_multi", with_fixture("SELECT request_id, prompt_template_key AS source_label FROM fx_meta"))
def src_multi(spark, sf):
    """One store per template, read together; the label comes from the file name."""
    d = model(spark, sf).domain
    base = scratch_path(spark, "stores")
    recs = ST.records_from_turns(d.text_turns, d.meta).join(
        d.meta.select("request_id", "prompt_template_key"), "request_id")
    for tpl in (S.THREAT, S.BENIGN):
        ST.write_store(recs.filter(F.col("prompt_template_key") == tpl), f"{base}/{tpl}_conversations")
    out = ST.read_store(spark, [f"{base}/{t}_conversations" for t in (S.THREAT, S.BENIGN)], jsonl=True)
    return out.select("request_id", "source_label")


@query("src_document", with_fixture("""
SELECT request_id, CASE WHEN conv_id % 5 = 0 THEN 'late_conversations' ELSE prompt_template_key END AS source_label,
  CAST(coalesce(n, 0) AS BIGINT) AS n_turns,
  row_number() OVER (PARTITION BY conv_id % 5 = 0, prompt_template_key ORDER BY request_id) AS place
FROM fx_meta LEFT JOIN (SELECT conv_id, count(*) AS n FROM fx_rows GROUP BY 1) USING (conv_id)"""))
def src_document(spark, sf):
    """Stores in the keyed, bare-map and list forms, found in a folder,
    read by byte ranges, with every record's place in its file."""
    d = model(spark, sf).domain
    recs = ST.records_from_turns(d.text_turns, d.meta).join(
        d.meta.select("request_id", "prompt_template_key", "conv_id"), "request_id")
    base, late = scratch_path(spark, "forms"), F.col("conv_id") % 5 == 0
    of = F.when(late, F.lit("late")).otherwise(F.col("prompt_template_key"))
    out = None
    for name, form in ((S.THREAT, "keyed"), (S.BENIGN, "map"), ("late", "list")):
        path = f"{base}/{name}_conversations"
        # the two late groups are numbered apart
        rows = recs.filter(of == name)
        if name == "late":
            rows = rows.withColumn("request_id", F.concat("prompt_template_key", F.lit("/"), "request_id"))
        ST.write_store(rows, path, jsonl=False, form=form)
        read = ST.read_store(spark, path, strict=form == "keyed", with_order=True)
        out = read if out is None else out.unionByName(read)
    template = F.when(F.col("source_label") == "late_conversations", F.split_part("request_id", F.lit("/"), F.lit(1)))
    place = F.row_number().over(Window.partitionBy("source", template).orderBy("ordinal.at")).cast("long")
    return out.select(F.element_at(F.split("request_id", "/"), -1).alias("request_id"), "source_label",
                      F.size("conversation").cast("long").alias("n_turns"), place.alias("place"))


@query("src_meta_blank_rows", with_fixture("SELECT request_id, flavor FROM fx_meta"))
def src_meta_blank_rows(spark, sf):
    """S3: metadata written with all-null rows interleaved; the detection
    reader policy skips them."""
    m = model(spark, sf).domain.meta.select("request_id", "flavor", "conv_id")
    blanks = m.filter(F.col("conv_id") % 9 == 4).select(
        F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("flavor"),
        F.lit(None).cast("long").alias("conv_id"))
    path = scratch_path(spark, "meta_csv")
    m.unionByName(blanks).drop("conv_id").write.option("header", True).csv(path)
    return ST.read_metadata(spark, path, "csv", null_policy="skip_blank_rows")


@query("rename_generation", with_fixture(
    "SELECT request_id, generation_model AS generation_model, generation_input_tokens AS generation_input_tokens, "
    "flavor FROM fx_meta"))
def rename_generation(spark, sf):
    m = model(spark, sf).domain.meta.select("request_id", F.col("generation_model").alias("model"),
                                            F.col("generation_input_tokens").alias("input_tokens"), "flavor")
    return ST.prefix_generation_columns(m)


@query("parse_list", with_fixture("""
SELECT request_id, objective || '__' || stance AS key, turn_index, code FROM fx_cells"""))
def parse_list(spark, sf):
    """JSON list cells (the wide export) parsed back; position = turn."""
    from .detection_queries import WIDE_FIELDS
    d = model(spark, sf).domain
    wide = ST.wide_lists(d.all_detections, d.meta, WIDE_FIELDS)
    arr = F.array(*[F.struct(F.lit(k).alias("key"),
                             V.parse_list(F.col(f"{k}__prediction")).alias("codes"))
                    for k in S.DETECTION_KEYS])
    x = wide.select("request_id", F.explode(arr).alias("x")).select("request_id", "x.key",
                                                                    F.posexplode("x.codes"))
    return x.filter(F.col("col").isNotNull()).select(
        "request_id", "key", F.col("pos").cast("long").alias("turn_index"), F.col("col").alias("code"))


def _cue_hits(obj: str) -> str:
    return " + ".join(f"((length(last) - length(replace(last, '{c}', ''))) // {len(c)})"
                      for c in D.CUE_WORDS[obj])


# Oracle of the shipped lexical scorer (a deterministic function of the
# whole transcript, the objective and the stance) followed by P28.
SCORE_SQL = with_fixture(f"""
, tx AS (
  SELECT request_id, turn_index,
    array_to_string(list(CASE WHEN turn_index % 2 = 1 THEN 'Caller' ELSE 'Representative' END || ': ' || coalesce(passage, ''))
      OVER (PARTITION BY request_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      chr(10) || chr(10)) AS transcript
  FROM fx_rows),
r AS (
  SELECT request_id, turn_index, transcript,
    CASE WHEN turn_index % 2 = 1 THEN 'social_engineering' ELSE 'policy_violation' END AS objective,
    lower(transcript) AS last,
    UNNEST({list(S.STANCES)}) AS stance
  FROM tx WHERE turn_index >= 1),
h AS (
  SELECT *, CAST(CASE WHEN objective = 'social_engineering' THEN {_cue_hits('social_engineering')}
                      ELSE {_cue_hits('policy_violation')} END AS DOUBLE) AS hits,
    CAST((length(last) - length(replace(last, ' ', ''))) + 1 AS DOUBLE) AS words,
    CASE stance {" ".join(f"WHEN '{k}' THEN {v}" for k, v in D.STANCE_BIAS.items())} ELSE 0.0 END AS bias
  FROM r),
p AS (
  SELECT *, greatest(0.001, least(0.999, 0.05 + 0.9 * least(1.0, 20.0 * hits / words) + bias)) AS py FROM h)
SELECT request_id, turn_index, objective, stance,
  CASE WHEN ln(py) >= ln(1.0 - py) THEN 'Y' ELSE 'N' END AS prediction,
  round(round_even(exp(ln(py)), 3), 6) AS p_detected,
  round(round_even(exp(ln(1.0 - py)), 3), 6) AS p_not_detected,
  CAST(80 + length(transcript) % 721 AS BIGINT) AS latency_ms
FROM p""")


@query("score_batch", SCORE_SQL)
def score_batch(spark, sf):
    """W3 transcripts scored by the shipped lexical scorer through Arrow
    batches (stances expanded inside the batch), decoded by P28."""
    d = model(spark, sf).domain
    tx = D.transcript_prefix(d.text_turns.select("request_id", "turn_index", "passage"))
    scored = D.score_turns(tx)
    return scored.select("request_id", "turn_index", "objective", "stance", "prediction",
                         "p_detected", "p_not_detected", "latency_ms")


# ---------------------------------------------------------------- sinks / views
@query("sink_requests", with_fixture(generation_sql() + f"""
SELECT *, '{",".join(S.REQUEST_COLUMNS)}' AS column_order FROM generation"""))
def sink_requests(spark, sf):
    """Request metadata written in declared column order, read back."""
    path = scratch_path(spark, "requests")
    ST.export_metadata(generation_metadata(spark, sf), path, S.REQUEST_COLUMNS)
    back = spark.read.parquet(path)
    return back.withColumn("column_order", F.lit(",".join(back.columns)))


@query("sink_named", with_fixture(
    "SELECT scenario, count(*) AS n_points, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp "
    "FROM (SELECT scenario, stance, count(*) FILTER (WHERE y_true = 1 AND score = 1) AS tp, "
    "count(*) FILTER (WHERE y_true = 0 AND score = 1) AS fp FROM a_scores GROUP BY ALL) GROUP BY 1"))
def sink_named(spark, sf):
    """A named result table written and read back."""
    pts, _ = R.roc(model(spark, sf).scores())
    path = ST.write_named(pts, scratch_path(spark, "reports"), "operating_points")
    return spark.read.parquet(path).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


@query("views", with_fixture("""
SELECT conversation_type, count(*) AS n_conversations, CAST(sum(total_any_violation) AS BIGINT) AS n_violation_turns
FROM a_conv GROUP BY 1"""))
def views(spark, sf):
    """Facts registered as SQL views (list/map columns dropped) and queried."""
    m = model(spark, sf)
    ST.register_views(spark, m.conv, m.turn_table)
    return spark.sql("SELECT conversation_type, count(*) AS n_conversations, "
                     "sum(total_any_violation) AS n_violation_turns "
                     "FROM conversations_facts GROUP BY conversation_type")


_DEFECT = f"({DEFECT_SQL}) IS NOT NULL"


@query("quarantine_split", with_fixture(f"""
SELECT prompt_template_key, count(*) AS n_valid FROM fx_meta WHERE NOT ({_DEFECT}) GROUP BY 1"""))
def quarantine_split(spark, sf):
    """Split valid / malformed records in one write (bucket=valid is the
    store written back, bucket=malformed the quarantine)."""
    from .grid_queries import parse_raw_records, raw_store
    checked = V.malformed_records(parse_raw_records(raw_store(spark, sf)))
    base = scratch_path(spark, "quarantine")
    # one pass: the split is a partition column of a single write
    (checked.select("raw", "malformed_reason",
                    F.when(F.col("malformed_reason").isNull(), F.lit("valid"))
                    .otherwise(F.lit("malformed")).alias("bucket"))
     .write.partitionBy("bucket").parquet(base))
    back = spark.read.parquet(base).filter(F.col("bucket") == "valid").select(
        F.get_json_object("raw", "$.selection.prompt_template_key").alias("prompt_template_key"))
    return back.groupBy("prompt_template_key").agg(F.count(F.lit(1)).alias("n_valid"))


@query("malformed_first10", with_fixture(f"""
SELECT request_id FROM fx_meta WHERE {_DEFECT} ORDER BY request_id LIMIT 10"""))
def malformed_first10(spark, sf):
    """First-k diagnostics (the limit is the feature)."""
    from .grid_queries import parse_raw_records, raw_store
    checked = V.malformed_records(parse_raw_records(raw_store(spark, sf)))
    return X.first_k(checked.filter(F.col("malformed_reason").isNotNull()).select("request_id"),
                     10, ["request_id"])


# ---------------------------------------------------------------- small operators on their own
@query("type_filter", with_fixture("SELECT request_id FROM a_conv WHERE conversation_type = 'threat'"))
def type_filter(spark, sf):
    """The conversation-type filter."""
    return RP.type_filter(model(spark, sf).conv_facts, "threat").select("request_id")


@query("required_columns", with_fixture("SELECT request_id, flavor, detection_status FROM fx_meta"))
def required_columns(spark, sf):
    """The schema check passes before any job runs, then the columns are read."""
    meta, wanted = model(spark, sf).domain.meta, ["request_id", "flavor", "detection_status"]
    V.require_columns(meta, wanted, "metadata")
    return meta.select(*wanted)


@query("evolve_schema", with_fixture("""
SELECT request_id, flavor, CAST(NULL AS BIGINT) AS attempts, CAST(NULL AS VARCHAR) AS last_error FROM fx_meta"""))
def evolve_schema(spark, sf):
    """Missing columns appended as typed nulls."""
    rows, _ = ST.evolve_schema(model(spark, sf).domain.meta.select("request_id", "flavor"),
                               T.StructType.fromDDL("request_id string, attempts long, last_error string"))
    return rows


@query("empty_store", with_fixture("SELECT request_id, flavor FROM fx_meta"))
def empty_store(spark, sf):
    """An empty store of the declared schema takes its first rows."""
    schema = T.StructType.fromDDL("request_id string, flavor string")
    return ST.empty_like(spark, schema).unionByName(model(spark, sf).domain.meta.select("request_id", "flavor"))


@query("list_parse_violations", with_fixture("""
SELECT request_id, 'cell' AS "column", CASE conv_id % 7 WHEN 0 THEN 'null list cell' WHEN 1 THEN 'not a JSON list'
  ELSE 'malformed JSON list' END AS reason FROM fx_meta WHERE conv_id % 7 < 3"""))
def list_parse_violations(spark, sf):
    """P7 strict: null, non-list and broken cells are reported, good ones are not."""
    c = F.col("conv_id") % 7
    cell = F.when(c == 1, "{\"a\": 1}").when((c == 2) & (F.col("conv_id") % 2 == 0), "[\"Y\"] junk").when(c == 2, "[\"Y\", ").when(c > 2, "[\"Y\", null]")
    return V.list_parse_violations(model(spark, sf).domain.meta.select("request_id", cell.alias("cell")), ["cell"])


@query("detection_plan_capped", with_fixture("""
SELECT request_id, conv_id AS ordinal FROM fx_meta m WHERE detection_status <> 'success'
  AND EXISTS (SELECT 1 FROM fx_rows r WHERE r.conv_id = m.conv_id) ORDER BY conv_id LIMIT 5"""))
def detection_plan_capped(spark, sf):
    """The first five planned requests in file order (the cap is the feature)."""
    dom = model(spark, sf).domain
    gen = dom.meta.select("request_id", F.col("conv_id").alias("ordinal"))
    return D.detection_plan(gen, dom.meta, dom.all_turns, max_requests=5)


@query("custom_normalizer", with_fixture("""
SELECT request_id, CASE WHEN benign_context IS NULL THEN 'unknown' ELSE upper(substr(benign_context, 1, 12)) END AS label
FROM fx_meta"""))
def custom_normalizer(spark, sf):
    """A user's normalizer takes the place of the alias match."""
    label = short_label("benign_context", None, None, F.col("benign_context"), lambda c: F.upper(F.substring(c, 1, 12)))
    return model(spark, sf).domain.meta.select("request_id", label.alias("label"))
