"""Grid / reconstruction / repair / upsert catalogue."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import grid as G
from ..operators import validate as V
from ..session import scratch_path
from ..sources import dimensions as DM
from ..sources import store as ST
from ..sources.document import written
from ..sources.versioned import VersionedTable
from .model import model
from .oracle_base import with_fixture
from .registry import query

CK = list(G.CONTENT_KEY)
CKS = ", ".join(CK)


def generation_records(meta: DataFrame) -> DataFrame:
    """Generation-side records derived from the conversation metadata, plus
    derived copies that exercise dedupe and orphans: an older copy (id%19=4),
    a same-timestamp copy (id%19=9), a newer copy (id%19=14), and a copy
    with replicate 1 (id%23=5), which no replicate-0 grid row matches."""
    threat = F.col("prompt_template_key") == S.THREAT
    base = meta.select(
        "request_id", (F.col("conv_id") * 4).alias("ordinal"), "conv_id", "replicate_index",
        "prompt_template_key", "scenario", F.coalesce("representative", F.lit("")).alias("representative"),
        "caller",
        F.when(~threat, F.coalesce("benign_context", F.lit(""))).otherwise(F.lit("")).alias("benign_context"),
        F.when(threat, F.coalesce("cialdini_emphasis", F.lit(""))).otherwise(F.lit("")).alias("cialdini_emphasis"),
        "turn_count_value", "flavor", "generated_at_utc",
        F.col("generation_input_tokens").alias("input_tokens"),
        F.col("generation_output_tokens").alias("output_tokens"))
    c = F.col("conv_id")
    older = (base.filter(c % 19 == 4).withColumn("request_id", F.concat("request_id", F.lit("-a")))
             .withColumn("generated_at_utc", F.lit("2024-12-31T00:00:00Z"))
             .withColumn("ordinal", F.col("ordinal") + 1))
    tie = (base.filter(c % 19 == 9).withColumn("request_id", F.concat("request_id", F.lit("-b")))
           .withColumn("ordinal", F.col("ordinal") + 2))
    newer = (base.filter(c % 19 == 14).withColumn("request_id", F.concat("request_id", F.lit("-c")))
             .withColumn("generated_at_utc", F.lit("2026-01-01T00:00:00Z"))
             .withColumn("ordinal", F.col("ordinal") + 3))
    rep1 = (base.filter(c % 23 == 5).withColumn("request_id", F.concat("request_id", F.lit("-r")))
            .withColumn("replicate_index", F.lit(1).cast("long"))
            .withColumn("ordinal", F.col("ordinal") + 3))
    return base.unionByName(older).unionByName(tie).unionByName(newer).unionByName(rep1)


GEN_SQL = f"""
, gbase AS (
  SELECT request_id, conv_id * 4 AS ordinal, conv_id, replicate_index, prompt_template_key, scenario,
    coalesce(representative, '') AS representative, caller,
    CASE WHEN prompt_template_key <> 'threat' THEN coalesce(benign_context, '') ELSE '' END AS benign_context,
    CASE WHEN prompt_template_key = 'threat' THEN coalesce(cialdini_emphasis, '') ELSE '' END AS cialdini_emphasis,
    turn_count_value, flavor, generated_at_utc, generation_input_tokens AS input_tokens,
    generation_output_tokens AS output_tokens
  FROM fx_meta),
gen AS (
  SELECT * FROM gbase
  UNION ALL SELECT * REPLACE (request_id || '-a' AS request_id, ordinal + 1 AS ordinal,
                              '2024-12-31T00:00:00Z' AS generated_at_utc) FROM gbase WHERE conv_id % 19 = 4
  UNION ALL SELECT * REPLACE (request_id || '-b' AS request_id, ordinal + 2 AS ordinal) FROM gbase WHERE conv_id % 19 = 9
  UNION ALL SELECT * REPLACE (request_id || '-c' AS request_id, ordinal + 3 AS ordinal,
                              '2026-01-01T00:00:00Z' AS generated_at_utc) FROM gbase WHERE conv_id % 19 = 14
  UNION ALL SELECT * REPLACE (request_id || '-r' AS request_id, ordinal + 3 AS ordinal,
                              CAST(1 AS BIGINT) AS replicate_index) FROM gbase WHERE conv_id % 23 = 5),
dd AS (
  SELECT {CKS}, arg_max(request_id, (generated_at_utc, -ordinal)) AS request_id,
    arg_max(generated_at_utc, (generated_at_utc, -ordinal)) AS generated_at_utc,
    arg_max(input_tokens, (generated_at_utc, -ordinal)) AS input_tokens,
    arg_max(output_tokens, (generated_at_utc, -ordinal)) AS output_tokens,
    count(*) AS n_in_group
  FROM gen GROUP BY {CKS}),
voc AS (
  SELECT prompt_template_key, list_sort(list(DISTINCT scenario)) AS scenario,
    list_sort(list(DISTINCT representative)) AS representative, list_sort(list(DISTINCT caller)) AS caller,
    list_sort(list(DISTINCT benign_context)) AS benign_context,
    list_sort(list(DISTINCT cialdini_emphasis)) AS cialdini_emphasis,
    list_sort(list(DISTINCT CAST(turn_count_value AS VARCHAR))) AS turn_count_value,
    list_sort(list(DISTINCT flavor)) AS flavors
  FROM gen GROUP BY 1),
g0 AS (SELECT prompt_template_key, scenario AS l_s, representative AS l_r, caller AS l_c,
         CASE WHEN prompt_template_key = 'benign' THEN benign_context ELSE [''] END AS l_b,
         CASE WHEN prompt_template_key = 'threat' THEN cialdini_emphasis ELSE [''] END AS l_e,
         turn_count_value AS l_t, flavors AS l_f FROM voc),
g1 AS (SELECT *, UNNEST(l_s) AS scenario FROM g0),
g2 AS (SELECT *, UNNEST(l_r) AS representative FROM g1),
g3 AS (SELECT *, UNNEST(l_c) AS caller FROM g2),
g4 AS (SELECT *, UNNEST(l_b) AS benign_context FROM g3),
g5 AS (SELECT *, UNNEST(l_e) AS cialdini_emphasis FROM g4),
g6 AS (SELECT *, CAST(UNNEST(l_t) AS BIGINT) AS turn_count_value FROM g5),
g7 AS (SELECT *, UNNEST(l_f) AS flavor, CAST(0 AS BIGINT) AS replicate_index FROM g6),
grid AS (SELECT sha256(concat_ws('|', {", ".join(f"CAST({c} AS VARCHAR)" for c in CK)})) AS request_id,
           {CKS}, 'pending' AS status, CAST(0 AS BIGINT) AS attempts FROM g7),
rm AS (
  SELECT coalesce(dd.request_id, grid.request_id) AS request_id, grid.request_id AS grid_id,
    {", ".join(f"grid.{c}" for c in CK)},
    CASE WHEN dd.request_id IS NOT NULL THEN 'success' ELSE grid.status END AS status,
    CASE WHEN dd.request_id IS NOT NULL THEN 1 ELSE grid.attempts END AS attempts,
    CASE WHEN dd.request_id IS NOT NULL THEN dd.generated_at_utc ELSE '' END AS generated_at_utc,
    CASE WHEN dd.request_id IS NOT NULL THEN coalesce(dd.input_tokens, 0) ELSE 0 END AS input_tokens,
    CASE WHEN dd.request_id IS NOT NULL THEN coalesce(dd.output_tokens, 0) ELSE 0 END AS output_tokens
  FROM grid LEFT JOIN dd USING ({CKS}))
"""


class GridModel:
    def __init__(self, spark, sf):
        self.m = model(spark, sf)
        self.records = generation_records(self.m.domain.meta)
        self.vocab = written(G.dimension_vocab(self.records), "grid-vocab")
        self.dedup = written(G.rank_records(G.dedupe_latest(self.records), self.vocab), "grid-records")
        self.grid = G.request_grid(self.vocab)
        self.matched = G.reconstruct_match(self.grid, self.dedup)


_GM: dict = {}


def gm(spark, sf) -> GridModel:
    from ..session import session_key
    from ..sources import fixture as FXT
    k = (session_key(spark), sf, FXT.GROWTH)
    if k not in _GM:
        _GM[k] = GridModel(spark, sf)
    return _GM[k]


@query("request_grid", with_fixture(GEN_SQL + f"SELECT request_id, {CKS}, status, attempts FROM grid"))
def request_grid(spark, sf):
    return gm(spark, sf).grid.drop("grid_number")


@query("render_prompts", with_fixture(GEN_SQL + """
, t AS (SELECT *, CASE prompt_template_key
          WHEN 'threat' THEN '""" + G.PROMPT_TEMPLATES["threat"] + """'
          WHEN 'benign' THEN '""" + G.PROMPT_TEMPLATES["benign"] + """' END AS tpl FROM grid)
SELECT request_id,
  replace(replace(replace(replace(replace(replace(replace(tpl,
    '{scenario}', scenario), '{representative}', representative), '{caller}', caller),
    '{benign_context}', benign_context), '{cialdini_emphasis}', cialdini_emphasis),
    '{turn_count}', CAST(turn_count_value AS VARCHAR)), '{last_turn_index}', CAST(turn_count_value - 1 AS VARCHAR))
    AS system_prompt,
  'flavor: ' || flavor AS user_prompt
FROM t"""))
def render_prompts(spark, sf):
    return G.render_prompts(gm(spark, sf).grid).select("request_id", "system_prompt", "user_prompt")


def _document(spark, name: str, doc: dict) -> str:
    path = scratch_path(spark, name)
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    return path


def prompt_document(spark, sf) -> str:
    """A prompt document with the vocabularies of the stored records (tens of
    values each)."""
    doc: dict = {"prompt_templates": {}, "flavors": []}
    columns = {c: f for f, c in DM.FIELD_COLUMNS.items()}
    for r in gm(spark, sf).vocab.orderBy("prompt_template_key", "axis", "ord").collect():
        tpl = doc["prompt_templates"].setdefault(
            r["prompt_template_key"], {"template": G.PROMPT_TEMPLATES[r["prompt_template_key"]], "dimensions": {}})
        if r["axis"] == "flavor":
            doc["flavors"] += [r["value"]] if r["value"] not in doc["flavors"] else []
        elif r["axis"] in G.TEMPLATE_AXES[r["prompt_template_key"]]:
            name = f"{r['prompt_template_key']}_{r['axis']}"
            tpl["dimensions"][columns[r["axis"]]] = name
            value = int(r["value"]) if r["axis"] == "turn_count_value" else r["value"]
            doc.setdefault(name, {})[f"key_{r['ord']:03d}"] = value
    return _document(spark, "prompt-dimensions", doc)


@query("grid_from_documents", with_fixture(GEN_SQL + """
, all_flavors AS (SELECT DISTINCT flavor FROM gen),
d AS (SELECT DISTINCT g.* EXCLUDE (flavor, request_id), f.flavor FROM grid g, all_flavors f)
SELECT prompt_template_key, flavor, turn_count_value, cialdini_emphasis, benign_context, representative, status,
  replace(replace(replace(replace(replace(replace(replace(CASE prompt_template_key
          WHEN 'threat' THEN '""" + G.PROMPT_TEMPLATES["threat"] + """' ELSE '""" + G.PROMPT_TEMPLATES["benign"] + """' END,
    '{scenario}', scenario), '{representative}', representative), '{caller}', caller),
    '{benign_context}', benign_context), '{cialdini_emphasis}', cialdini_emphasis),
    '{turn_count}', CAST(turn_count_value AS VARCHAR)), '{last_turn_index}', CAST(turn_count_value - 1 AS VARCHAR))
    AS system_prompt FROM d"""))
def grid_from_documents(spark, sf):
    """S5 → J8 → P26: a prompt document read and checked, its grid unranked, and
    its own templates rendered."""
    template_dims, values, flavors = DM.read_prompt_dims(spark, prompt_document(spark, sf))
    grid = G.request_grid(written(DM.grid_vocab(template_dims, values, flavors), "document-vocab"))
    return G.render_prompts(grid, template_dims).select(
        "prompt_template_key", "flavor", "turn_count_value", "cialdini_emphasis", "benign_context", "representative",
        "status", "system_prompt")


@query("detector_prompts", with_fixture("""
SELECT request_id, turn_index, objective, stance, 'Judge ' || objective || '. Be ' || stance || '.' AS system_prompt,
  CASE stance WHEN 'high_recall' THEN 0 WHEN 'high_precision' THEN 1 ELSE 2 END AS stance_ord FROM fx_cells"""))
def detector_prompts(spark, sf):
    """S5/S6/P26 for detectors: both documents read and checked, the catalogue of
    stances in order of appearance, and every call's system prompt."""
    paths = []
    for objective, order in (("policy_violation", (2, 0, 1)), ("social_engineering", (0, 1, 2))):
        speaker = next(sp for sp, o in S.OBJECTIVE_OF_SPEAKER.items() if o == objective)
        paths.append(_document(spark, objective, {
            "objective_key": objective, "applies_to_speaker": speaker,
            "base_prompt": {"template": f"Judge {objective}. {{stance_instruction}}"},
            "stances": {S.STANCES[k]: {"description": "", "instruction": f"Be {S.STANCES[k]}."} for k in order}}))
    stances = DM.read_detector_dims(spark, paths)
    prompts = DM.detector_prompts(stances).join(DM.stance_catalogue_from_files(stances).withColumnRenamed("ord", "stance_ord"), "stance")
    calls = model(spark, sf).domain.all_detections.select("request_id", "turn_index", "objective", "stance")
    return calls.join(written(prompts, "detector-prompts"), ["objective", "stance"])


@query("dedupe_latest", with_fixture(GEN_SQL + f"SELECT request_id, {CKS}, generated_at_utc, n_in_group FROM dd"))
def dedupe_latest(spark, sf):
    return gm(spark, sf).dedup.select("request_id", *CK, "generated_at_utc", "n_in_group")


@query("reconstruct_match", with_fixture(GEN_SQL + "SELECT * FROM rm"))
def reconstruct_match(spark, sf):
    return gm(spark, sf).matched


@query("reconstruct_orphans", with_fixture(GEN_SQL + f"""
SELECT request_id, {CKS} FROM dd WHERE NOT EXISTS (
  SELECT 1 FROM grid WHERE {" AND ".join(f"grid.{c} = dd.{c}" for c in CK)})"""))
def reconstruct_orphans(spark, sf):
    return G.reconstruct_orphans(gm(spark, sf).dedup).select("request_id", *CK)


@query("reconstruct_summary", with_fixture(GEN_SQL + f"""
, j AS (SELECT g.k AS gk, d.k AS dk FROM (SELECT {CKS}, 1 AS k FROM grid) g
        FULL OUTER JOIN (SELECT {CKS}, 1 AS k FROM dd) d USING ({CKS}))
SELECT count(gk) AS n_grid, (SELECT count(*) FROM gen) AS n_records,
  count(*) FILTER (WHERE gk IS NOT NULL AND dk IS NOT NULL) AS n_matched,
  count(*) FILTER (WHERE gk IS NOT NULL AND dk IS NULL) AS n_unmatched,
  count(*) FILTER (WHERE dk IS NOT NULL AND gk IS NULL) AS n_orphans,
  (SELECT count(*) FROM gen) - (SELECT count(*) FROM dd) AS n_duplicates
FROM j"""))
def reconstruct_summary(spark, sf):
    g = gm(spark, sf)
    return G.reconstruct_summary(G.grid_size(g.vocab), g.dedup)


@query("repair_backfill", with_fixture(GEN_SQL + """
, j AS (SELECT rm.status, EXISTS (SELECT 1 FROM gen WHERE gen.request_id = rm.request_id) AS has FROM rm),
o AS (SELECT CASE WHEN NOT has THEN 'no_conversation' ELSE 'repaired' END AS outcome FROM j
      UNION ALL SELECT 'success_missing_conversation' FROM j WHERE NOT has AND status = 'success')
SELECT outcome, count(*) AS n FROM o GROUP BY 1"""))
def repair_backfill(spark, sf):
    g = gm(spark, sf)
    return G.repair_backfill(g.matched, g.records)


def _flag_sql() -> str:
    cols = []
    for f in S.ALL_FLAGS:
        cond = ("turn_index % 2 = 1" if f in S.CALLER_FLAGS else "turn_index >= 2 AND turn_index % 2 = 0")
        fires = f"list(turn_index) FILTER (WHERE {cond} AND {f} = true)"
        cols.append(f"CAST(len(coalesce({fires}, [])) AS BIGINT) AS {f}_sum")
        cols.append(f"CASE WHEN any_value(n) > 0 THEN array_to_string(list_transform(range(any_value(n)), "
                    f"lambda i: CASE WHEN list_contains(coalesce({fires}, []), i) THEN '1' ELSE '0' END), ',') "
                    f"ELSE '' END AS {f}_by_turn")
    return with_fixture(f"""
, t AS (SELECT r.*, m.turn_count_value AS n FROM fx_rows r JOIN fx_meta m USING (conv_id))
SELECT request_id, {", ".join(cols)} FROM t GROUP BY request_id""")


def generation_sql() -> str:
    """``generation``: the request metadata of the conversations, all columns."""
    flags = _flag_sql()
    flags = flags[flags.index(", t AS ("):].replace(", t AS (", ", ft AS (").replace("FROM t GROUP BY", "FROM ft GROUP BY")
    split = flags.index("SELECT request_id")
    values = {c: f"m.{c}" for c in S.REQUEST_COLUMNS_HEAD} | {
        "model": "m.generation_model", "temperature": "1.0::DOUBLE", "top_p": "1.0::DOUBLE", "status": "'success'",
        "attempts": "1::BIGINT", "last_error": "''", "input_tokens": "m.generation_input_tokens",
        "output_tokens": "m.generation_output_tokens",
        "total_tokens": "m.generation_input_tokens + m.generation_output_tokens"}
    text = "CASE prompt_template_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.PROMPT_TEMPLATES.items()) + " END"
    for c in ("scenario", "representative", "caller", "benign_context", "cialdini_emphasis"):
        text = f"replace({text}, '{{{c}}}', coalesce(m.{c}, ''))"
    text = (f"replace(replace({text}, '{{turn_count}}', CAST(m.turn_count_value AS VARCHAR)), '{{last_turn_index}}', "
            "CAST(m.turn_count_value - 1 AS VARCHAR))")
    return (f"{flags[:split]}, flags AS ({flags[split:]}), generation AS (SELECT "
            + ", ".join(f"{v} AS {c}" for c, v in values.items())
            + f", flags.* EXCLUDE (request_id), {text} AS system_prompt, 'flavor: ' || m.flavor AS user_prompt "
              "FROM fx_meta m JOIN flags USING (request_id))")


def generation_metadata(spark, sf) -> DataFrame:
    """The request metadata of the conversations in declared column order: what
    the generation stage leaves behind."""
    d = model(spark, sf).domain
    rows = d.meta.select("*", F.lit(1.0).alias("temperature"), F.lit(1.0).alias("top_p"), F.lit("success").alias("status"),
                         F.lit(1).cast("long").alias("attempts"), F.lit("").alias("last_error"),
                         F.col("generation_model").alias("model"), F.col("generation_input_tokens").alias("input_tokens"),
                         F.col("generation_output_tokens").alias("output_tokens"),
                         (F.col("generation_input_tokens") + F.col("generation_output_tokens")).alias("total_tokens"))
    flags = G.flag_metrics(d.all_turns.withColumnRenamed("n_turns", "turn_count_value"))
    return ST.in_declared_order(G.render_prompts(rows).join(flags, "request_id"), S.REQUEST_COLUMNS)


@query("flag_by_turn", _flag_sql())
def flag_by_turn(spark, sf):
    d = model(spark, sf).domain
    t = d.all_turns.withColumnRenamed("n_turns", "turn_count_value")
    return G.flag_metrics(t)


def update_log(name: str, *tables: DataFrame) -> DataFrame:
    """An update log of one JSON Lines folder per table, in order, read back
    with every row's place in file order (``ordinal``)."""
    spark = tables[0].sparkSession
    path = scratch_path(spark, name)
    for k, rows in enumerate(tables):
        rows.write.json(f"{path}/{k:04d}")
    read = spark.read.schema(tables[0].schema).option("recursiveFileLookup", True).json(path)
    return read.select("*", ST.ingest_order().alias("ordinal"))


def _blank_if(blank: str) -> str:
    """The metric columns of ``generation``, blank where the condition holds."""
    return ", ".join(f"CASE WHEN {blank} THEN {'NULL' if c.endswith('_sum') else repr('')} ELSE {c} END AS {c}"
                     for c in G.METRIC_COLUMNS)


@query("repair_rows", lambda: with_fixture(generation_sql() + f"""
SELECT request_id, status, {_blank_if("CAST(request_id AS BIGINT) % 4 = 1 AND CAST(request_id AS BIGINT) % 17 = 5")},
  CASE WHEN CAST(request_id AS BIGINT) % 17 = 5 THEN 'no_conversation' ELSE 'repaired' END AS outcome,
  2 AS n_versions FROM generation"""))
def repair_rows(spark, sf):
    """J6 as a change of a versioned table: rows (id % 4 = 1) that lost their
    metrics get them from the stored conversations (none for id % 17 = 5); only
    the buckets of changed rows are written."""
    d = model(spark, sf).domain
    c = F.col("request_id").cast("long")
    before = generation_metadata(spark, sf)
    before = before.select(*[F.when(c % 4 != 1, F.col(n)).otherwise(None if n.endswith("_sum") else "").alias(n)
                             if n in G.METRIC_COLUMNS else F.col(n) for n in before.columns])
    table = VersionedTable(spark, scratch_path(spark, "metadata"), before.schema)
    table.create(before)
    stored = d.all_turns.where(c % 17 != 5)
    repaired = written(G.repair_rows(table.read(), stored, stored), "repaired")
    table.merge(repaired.where("changed").select(*before.columns, F.lit(0).alias("ordinal")))
    return table.read().join(repaired.select("request_id", "outcome"), "request_id").select(
        "request_id", "status", *G.METRIC_COLUMNS, "outcome", F.lit(len(table.versions())).alias("n_versions"))


@query("reconstruct_rows", lambda: with_fixture(GEN_SQL + generation_sql() + f"""
SELECT rm.request_id, rm.grid_id, rm.status, rm.attempts, rm.input_tokens, rm.output_tokens,
  CASE WHEN rm.status = 'success' THEN rm.input_tokens + rm.output_tokens ELSE 0 END AS total_tokens, '' AS last_error,
  'flavor: ' || rm.flavor AS user_prompt,
  {", ".join(f"CASE WHEN rm.status = 'success' THEN g.{c} END AS {c}" for c in G.METRIC_COLUMNS)}
FROM rm LEFT JOIN generation g ON g.request_id = rm.request_id"""))
def reconstruct_rows(spark, sf):
    """J4 as whole rows: ids, prompts, tokens, status and flag metrics."""
    g, d = gm(spark, sf), model(spark, sf).domain
    records = G.render_prompts(g.dedup).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return G.reconstruct_rows(g.matched, records, d.all_turns).select(
        "request_id", "grid_id", "status", "attempts", "input_tokens", "output_tokens", "total_tokens", "last_error",
        "user_prompt", *G.METRIC_COLUMNS)


@query("upsert_update_only", with_fixture("""
, u AS (SELECT request_id, CASE WHEN conv_id % 4 = 0 THEN 'again ' || flavor ELSE upper(flavor) END AS flavor
        FROM fx_meta WHERE conv_id % 3 = 0 OR conv_id % 4 = 0
        UNION ALL SELECT 'missing-' || request_id, 'X' FROM fx_meta WHERE conv_id % 5 = 0)
SELECT b.request_id, coalesce(u.flavor, b.flavor) AS flavor, b.turn_count_value
FROM fx_meta b LEFT JOIN u USING (request_id)"""))
def upsert_update_only(spark, sf):
    """S10 over a log of two files; ids in both (id % 12 = 0) take the later."""
    meta = model(spark, sf).domain.meta
    c = F.col("conv_id")
    early = (meta.filter(c % 3 == 0).select("request_id", F.upper("flavor").alias("flavor"))
             .unionByName(meta.filter(c % 5 == 0).select(
                 F.concat(F.lit("missing-"), F.col("request_id")).alias("request_id"),
                 F.lit("X").alias("flavor"))))
    late = meta.filter(c % 4 == 0).select("request_id", F.concat(F.lit("again "), F.col("flavor")).alias("flavor"))
    base = meta.select("request_id", "flavor", "turn_count_value")
    return ST.upsert_update_only(base, update_log("updates", early, late), "request_id", ["flavor"])


@query("upsert_overwrite", with_fixture("""
, u AS (SELECT request_id, CASE WHEN conv_id % 2 = 0 THEN '2026-06-02T00:00:00Z' ELSE '2026-06-01T00:00:00Z' END
          AS generated_at_utc, flavor FROM fx_meta WHERE detection_status <> 'success' OR conv_id % 2 = 0
        UNION ALL SELECT 'new-' || request_id, '2026-06-01T00:00:00Z', flavor FROM fx_meta WHERE conv_id % 7 = 0)
SELECT request_id, generated_at_utc, flavor FROM fx_meta WHERE request_id NOT IN (SELECT request_id FROM u)
UNION ALL SELECT * FROM u"""))
def upsert_overwrite(spark, sf):
    """S11 over a log of two files with ids in both."""
    meta = model(spark, sf).domain.meta
    ts = F.lit("2026-06-01T00:00:00Z").alias("generated_at_utc")
    early = (meta.filter(F.col("detection_status") != S.STATUS_SUCCESS).select("request_id", ts, "flavor")
             .unionByName(meta.filter(F.col("conv_id") % 7 == 0).select(
                 F.concat(F.lit("new-"), F.col("request_id")).alias("request_id"), ts, "flavor")))
    late = meta.filter(F.col("conv_id") % 2 == 0).select(
        "request_id", F.lit("2026-06-02T00:00:00Z").alias("generated_at_utc"), "flavor")
    return ST.upsert_overwrite(meta.select("request_id", "generated_at_utc", "flavor"),
                               update_log("overwrites", early, late), "request_id")


@query("attempts_update", with_fixture("""
, b AS (SELECT request_id, conv_id, CASE WHEN detection_status = 'success' THEN 'success' ELSE 'error' END AS status,
          CAST(1 AS BIGINT) AS attempts, '' AS last_error FROM fx_meta),
r AS (SELECT request_id, conv_id, conv_id % 2 = 0 OR conv_id % 3 = 0 AS ok,
        CASE WHEN conv_id % 3 = 0 THEN 7 ELSE 1 + conv_id % 3 END AS used FROM b WHERE status <> 'success')
SELECT b.request_id,
  CASE WHEN r.request_id IS NULL THEN b.status WHEN r.ok THEN 'success' ELSE 'error' END AS status,
  CASE WHEN r.request_id IS NULL THEN b.attempts WHEN r.ok THEN b.attempts + r.used ELSE b.attempts + 10 END AS attempts,
  CASE WHEN r.request_id IS NULL THEN b.last_error WHEN r.ok THEN '' ELSE 'timeout' END AS last_error
FROM b LEFT JOIN r USING (request_id)"""))
def attempts_update(spark, sf):
    """T4 over a log in which every third failed row has a later, good result."""
    meta = model(spark, sf).domain.meta
    base = meta.select("request_id", "conv_id",
                       F.when(F.col("detection_status") == S.STATUS_SUCCESS, F.lit("success"))
                       .otherwise(F.lit("error")).alias("status"),
                       F.lit(1).cast("long").alias("attempts"), F.lit("").alias("last_error"))
    c, due = F.col("conv_id"), base.filter(F.col("status") != "success")
    first = due.select("request_id", (c % 2 == 0).alias("ok"), (1 + c % 3).alias("attempts_used"),
                       F.when(c % 2 != 0, F.lit("timeout")).alias("error"))
    again = due.filter(c % 3 == 0).select("request_id", F.lit(True).alias("ok"),
                                          F.lit(7).cast("long").alias("attempts_used"),
                                          F.lit(None).cast("string").alias("error"))
    return ST.attempts_update(base, update_log("results", first, again), max_attempts=10).select(
        "request_id", "status", "attempts", "last_error")


@query("token_usage", with_fixture("""
SELECT prompt_template_key, count(*) AS n_success, CAST(sum(generation_input_tokens) AS BIGINT) AS input_total,
  CAST(sum(generation_output_tokens) AS BIGINT) AS output_total,
  CAST(sum(generation_input_tokens + generation_output_tokens) AS BIGINT) AS total_total,
  CAST(sum(generation_input_tokens) // count(*) AS BIGINT) AS input_mean,
  CAST(sum(generation_output_tokens) // count(*) AS BIGINT) AS output_mean,
  CAST(sum(generation_input_tokens + generation_output_tokens) // count(*) AS BIGINT) AS total_mean
FROM fx_meta GROUP BY 1"""))
def token_usage(spark, sf):
    meta = model(spark, sf).domain.meta
    rows = meta.select("prompt_template_key", F.lit("success").alias("status"),
                       F.col("generation_input_tokens").alias("input_tokens"),
                       F.col("generation_output_tokens").alias("output_tokens"))
    return G.token_usage(rows)


@query("status_counts", with_fixture(GEN_SQL + """
SELECT prompt_template_key AS run_label, status, count(*) AS n FROM rm GROUP BY 1, 2"""))
def status_counts(spark, sf):
    return G.status_counts(gm(spark, sf).matched)


# Records serialised to JSON with injected defects, re-parsed and checked.
def malformed_input(spark, sf) -> DataFrame:
    d = model(spark, sf).domain
    recs = ST.records_from_turns(d.text_turns, d.meta).join(
        d.meta.select("request_id", "conv_id", "turn_count_value"), "request_id")
    c = F.col("conv_id")
    sel = F.col("selection")
    recs = (recs.withColumn("replicate_index", F.when(c % 29 != 7, F.col("replicate_index")))
            .withColumn("selection", F.when(c % 31 == 9, F.map_filter(sel, lambda k, v: k != "caller"))
                        .otherwise(sel))
            .withColumn("selection", F.when(c % 37 == 11, F.map_concat(
                F.map_filter(F.col("selection"), lambda k, v: k != "turn_count_value"),
                F.create_map(F.lit("turn_count_value"), F.lit("seven")))).otherwise(F.col("selection")))
            .withColumn("conversation", F.when(c % 41 == 13, F.map_filter(
                "conversation", lambda k, v: k != F.concat(F.lit("turn_"),
                                                          (F.col("turn_count_value") - 1).cast("string"))))
                        .otherwise(F.col("conversation")))
            .withColumn("conversation", F.when(c % 43 == 17, F.transform_values(
                "conversation", lambda k, v: F.when(k == "turn_1", v.withField("cialdini_unity", F.lit(None)))
                .otherwise(v))).otherwise(F.col("conversation"))))
    raw = F.to_json(F.struct("request_id", "selection", "conversation", "generated_at_utc", "flavor", "replicate_index"))
    raw = F.when(c % 47 == 5, F.regexp_replace(raw, r'"cialdini_unity":(true|false)', '"cialdini_unity":"banana"')).otherwise(raw)
    raw = F.when(c % 53 == 3, F.regexp_replace(raw, r'"selection":\{[^}]*\}', '"selection":"none"')).otherwise(raw)
    return recs.select("request_id", raw.alias("raw"))


_RAW: dict = {}


def raw_store(spark, sf) -> DataFrame:
    """The serialised records (with their injected defects) written once as a
    JSON Lines store — what P22/P23 validate is a store on disk."""
    from ..session import scratch_path, session_key
    from ..sources import fixture as FXT
    k = (session_key(spark), sf, FXT.GROWTH)
    if k not in _RAW:
        path = scratch_path(spark, "raw_store")
        malformed_input(spark, sf).select(F.col("raw").alias("value")).write.text(path)
        _RAW[k] = path
    return spark.read.text(_RAW[k]).select(F.col("value").alias("raw"))


def parse_raw_records(raw: DataFrame) -> DataFrame:
    """Raw JSON record text → ``request_id`` and the parsed value (a variant:
    types and nulls stay as written; null when the text is no JSON)."""
    return raw.select("raw", F.get_json_object("raw", "$.request_id").alias("request_id"),
                      F.try_parse_json("raw").alias("record"))


#: The injected defects in the order in which the rules find them.
DEFECT_SQL = """CASE
  WHEN conv_id % 29 = 7 THEN 'missing fields: replicate_index'
  WHEN conv_id % 53 = 3 THEN 'selection is not an object'
  WHEN conv_id % 31 = 9 THEN 'selection missing: caller'
  WHEN conv_id % 37 = 11 THEN 'turn_count_value is not an integer'
  WHEN conv_id % 41 = 13 THEN 'turn keys do not match turn_count_value'
  WHEN conv_id % 47 = 5 AND turn_count_value > 2 THEN
    'bad turn fields: ' || (SELECT string_agg('turn_' || i, ',' ORDER BY 'turn_' || i)
                            FROM range(1, turn_count_value, 2) r(i))
  WHEN conv_id % 47 = 5 AND turn_count_value = 2 OR conv_id % 43 = 17 AND turn_count_value > 1
    THEN 'bad turn fields: turn_1' END"""


@query("malformed_records", with_fixture(f"""
SELECT request_id, malformed_reason FROM (SELECT request_id, {DEFECT_SQL} AS malformed_reason FROM fx_meta)
WHERE malformed_reason IS NOT NULL"""))
def malformed_records(spark, sf):
    checked = V.malformed_records(parse_raw_records(raw_store(spark, sf)))
    return checked.filter(F.col("malformed_reason").isNotNull()).select("request_id", "malformed_reason")
