"""Domain tables derived from the driver's ``conversations`` parquet.

The rule set is FIXTURES.md §3: every flag, detector code and measure is an
integer hash of (conv_id, turn, k), so Spark and the DuckDB oracle derive the
identical rows. All row-level work is a projection of the scan (no shuffle);
the only exchange is one group-by on ``conv_id`` for the conversation-level
metadata, which is then joined back (AQE splits a hot conversation).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import mix_expr, speaker

# ---------------------------------------------------------------------------
# FIXED VALUES of the synthetic fixture (FIXTURES.md §3 thresholds) and the
# prompt sentences used for label path 3 (text containing an alias).
# ---------------------------------------------------------------------------
CALLER_FLAG_RATE = (300, 50)          # threat | benign, per mille
VIOLATION_FLAG_RATE = (150, 40)
FIRE_THRESHOLD = {                    # stance -> (threat, benign), per mille
    "high_precision": (200, 10),
    "balanced": (350, 40),
    "high_recall": (550, 100),
}
REPRESENTATIVE_ORDER = ("by_book", "tired", "helpful", "distracted")
CONTEXT_ORDER = ("minimal", "moderate", "heavy")

PRINCIPLE_SENTENCES = {
    "reciprocity": "Offer the agent a small favour first so that reciprocity makes them return it.",
    "commitment_consistency": "Collect small agreements early and lean on commitment and consistency.",
    "social_proof": "Claim that many other customers already got this, using social proof.",
    "authority": "Pose as a senior manager and lean on authority.",
    "liking": "Be warm and complimentary, building liking before the ask.",
    "scarcity": "Stress that the opportunity expires today to create scarcity.",
    "unity": "Stress a shared identity and a sense of unity with the agent.",
}
UNRECOGNISED_EMPHASIS = "Improvise freely without any particular tactic."
REPRESENTATIVE_SENTENCES = {
    "by_book": "A by-the-book agent who follows procedure to the letter.",
    "tired": "A weary agent near the end of shift who still tries to be friendly.",
    "helpful": "An agent who is eager to help and accommodating.",
    "distracted": "A busy agent who is multitasking across several chats.",
}
CONTEXT_SENTENCES = {
    "minimal": "The caller mostly stays on topic and is businesslike.",
    "moderate": "The caller adds two or three extraneous sentences per turn.",
    "heavy": "The caller is rambling and adds several extraneous sentences.",
}
SCENARIO = "account_takeover"
CALLERS = ("impersonator", "regular_customer")
GENERATION_MODEL = "gen-model-a"
DETECTION_MODEL = "det-model-a"
EPOCH_SECONDS = 1735689600            # 2025-01-01T00:00:00Z


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _mix(k: int | str) -> Column:
    """The fixture hash as written in FIXTURES.md (used for metadata-level rules)."""
    return F.expr(mix_expr("conv_id", "turn_index", str(k)))


# The hash factorises: ((x + k·c) mod m) = ((x mod m) + (k·c mod m)) mod m, so
# the two k-independent residues are computed once per row (_a, _b) and each
# mix(k) is then two small additions — far smaller generated code than 66
# full hash trees, which matters for whole-stage codegen.
_A = "((conv_id*7919 + turn_index*104729) % 10007)"
_B = "((conv_id*3571 + turn_index*15485863) % 10009)"


def _mixk(k: int) -> Column:
    return (((F.col("_a") + (k * 1299709) % 10007) % 10007)
            * ((F.col("_b") + (k * 611953) % 10009) % 10009)) % 1000


def _mixj(base: int, si: int) -> Column:
    """mix(base + j) with j = 3 (caller / SE) or 0 (PV) by parity, plus stance."""
    return F.when(F.col("turn_index") % 2 == 1, _mixk(base + 3 + si)).otherwise(_mixk(base + si))


def _label_paths(conv: Column, label: Column, sentence: Column, path: Column):
    """(metadata key, selection key, raw text) for a label under a path 0/1/2."""
    meta_key = F.when(path == 0, label).when(path == 1, F.lit("  "))
    sel_key = F.when(path == 1, label)
    return meta_key, sel_key, sentence


GROWTH = 1                 # replicate axis for volume benchmarks (1 = the table as is)
REPLICA_STRIDE = 10_000_000


def raw_turns(spark: SparkSession, sf_dir: str, growth: int | None = None) -> DataFrame:
    """Scan of the driver table, pruned to the three columns we use. With
    ``growth`` R > 1 every conversation is replicated R times under new ids
    (conv_id + r × stride) — the replicate axis, generated map-side."""
    df = (spark.read.parquet(f"{sf_dir}/conversations.parquet")
          .select("conv_id", F.col("turn").alias("turn_index"), F.col("text").alias("passage")))
    g = GROWTH if growth is None else growth
    if g > 1:
        df = (df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
                        .alias("_r"))
              .select((F.col("conv_id") + F.col("_r") * REPLICA_STRIDE).alias("conv_id"),
                      "turn_index", "passage"))
    return df


def turn_rows(raw: DataFrame) -> DataFrame:
    """One row per (conversation, turn): typed flags (null off-speaker) plus
    the turn's count of detector cells and of X / E codes (for the run
    status roll-up). A projection of the scan; the hash residues are
    computed once per row."""
    threat = F.col("conv_id") % 2 == 0
    t = F.col("turn_index")
    odd = t % 2 == 1
    rep_resp = (t >= 2) & (t % 2 == 0)
    base = raw.select("*", F.expr(_A).alias("_a"), F.expr(_B).alias("_b"))
    cid = F.col("conv_id")
    cols = [
        F.col("conv_id"),
        F.col("conv_id").cast("string").alias("request_id"),
        t,
        speaker(t).alias("speaker"),
        F.col("passage"),
    ]
    for k, flag in enumerate(S.CALLER_FLAGS):
        rate = F.when(threat, CALLER_FLAG_RATE[0]).otherwise(CALLER_FLAG_RATE[1])
        cols.append(F.when(odd, _mixk(k) < rate).alias(flag))
    for k, flag in enumerate(S.VIOLATION_FLAGS):
        rate = F.when(threat, VIOLATION_FLAG_RATE[0]).otherwise(VIOLATION_FLAG_RATE[1])
        cols.append(F.when(rep_resp, _mixk(7 + k) < rate).alias(flag))
    # codes X / E depend only on (conversation, turn, stance): count them here
    all_x = cid % 33 == 16
    bal_x = (cid % 11 == 5) & (t == 1)
    hp_e = (cid % 13 == 6) & (t % 5 == 3)
    scored = t >= 1
    n_x = F.when(scored & all_x, 3).when(scored & bal_x, 1).otherwise(0)
    n_e = F.when(scored & ~all_x & hp_e, 1).otherwise(0)
    cols += [F.when(scored, 3).otherwise(0).alias("n_cells_turn"), n_x.alias("n_x_turn"),
             n_e.alias("n_e_turn")]
    return base.select(*cols)


def detection_rows(raw: DataFrame) -> DataFrame:
    """The long detections table: one row per (turn ≥ 1, stance) — the three
    stances come from a generator over a literal array, every cell field is a
    scalar expression (no nested structs are built)."""
    t = F.col("turn_index")
    cid = F.col("conv_id")
    threat = cid % 2 == 0
    base = (raw.filter(t >= 1)
            .select("conv_id", "turn_index", F.expr(_A).alias("_a"), F.expr(_B).alias("_b"),
                    F.explode(F.array(*[F.lit(i) for i in range(len(S.STANCES))])).alias("si")))
    si = F.col("si")
    stance = F.element_at(F.array(*[F.lit(x) for x in S.STANCES]), si + 1)
    j = F.when(t % 2 == 1, 3).otherwise(0) + si

    def mix(base_k: int) -> Column:
        k = j + base_k
        return (((F.col("_a") + (k * 1299709) % 10007) % 10007)
                * ((F.col("_b") + (k * 611953) % 10009) % 10009)) % 1000

    h = base.select("conv_id", "turn_index", stance.alias("stance"), "si",
                    mix(10).alias("_fire"), mix(40).alias("_p"), mix(50).alias("_lat"),
                    mix(60).alias("_tok"))
    thr = F.element_at(F.when(threat, F.array(*[F.lit(FIRE_THRESHOLD[s][0]) for s in S.STANCES]))
                       .otherwise(F.array(*[F.lit(FIRE_THRESHOLD[s][1]) for s in S.STANCES])),
                       F.col("si") + 1)
    fires = F.col("_fire") < thr
    x_code = (cid % 33 == 16) | ((cid % 11 == 5) & (t == 1) & (F.col("stance") == "balanced"))
    e_code = (cid % 13 == 6) & (t % 5 == 3) & (F.col("stance") == "high_precision")
    code = (F.when(x_code, F.lit("X")).when(e_code, F.lit("E"))
             .when(fires, F.lit("Y")).otherwise(F.lit("N")))
    p_int = F.when(fires, 550).otherwise(50) + F.col("_p") % 401
    ok = ~x_code
    return h.select(
        "conv_id", cid.cast("string").alias("request_id"), "turn_index",
        F.when(t % 2 == 1, F.lit("social_engineering")).otherwise(F.lit("policy_violation"))
         .alias("objective"),
        "stance", code.alias("code"),
        F.when(code == "Y", 1).when(code == "N", 0).cast("long").alias("pred"),
        F.when(ok, p_int / 1000.0).alias("p_detected"),
        F.when(ok, (1000 - p_int) / 1000.0).alias("p_not_detected"),
        F.when(ok, (80 + F.col("_lat") % 721).cast("long")).alias("latency_ms"),
        F.when(ok, (50 + F.col("_tok") % 351).cast("long")).alias("input_tokens"),
        F.when(ok, F.lit(1).cast("long")).alias("output_tokens"))


def conversation_meta(rows: DataFrame) -> DataFrame:
    """Conversation-level metadata: one group-by over the turn rows (partial
    aggregation map-side), then labels and run status as projections."""
    agg = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turn_count_value"),
        F.sum("n_cells_turn").alias("n_cells"),
        F.sum("n_x_turn").alias("n_x"),
        F.sum("n_e_turn").alias("n_e"),
        F.sum(F.length("passage")).alias("n_chars"),
    )
    cid = F.col("conv_id")
    threat = cid % 2 == 0
    emph = _pick(cid % 7, S.PRINCIPLES)
    rep = _pick((cid % 5) % 4, REPRESENTATIVE_ORDER)
    ctx = _pick(cid % 3, CONTEXT_ORDER)

    def sentence(label: Column, table: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), label)

    emph_raw = (F.when((cid % 3 == 2) & (cid % 23 == 11), F.lit(None).cast("string"))
                 .when((cid % 3 == 2) & (cid % 19 == 17), F.lit(UNRECOGNISED_EMPHASIS))
                 .otherwise(sentence(emph, PRINCIPLE_SENTENCES)))
    e_key, e_sel, _ = _label_paths(cid, emph, emph_raw, cid % 3)
    r_key, r_sel, _ = _label_paths(cid, rep, None, cid % 4)
    c_key, c_sel, _ = _label_paths(cid, ctx, None, cid % 5)
    template = F.when(threat, F.lit(S.THREAT)).otherwise(F.lit(S.BENIGN))
    status = (F.when(F.col("n_cells") == 0, F.lit(S.STATUS_SUCCESS))
               .when(F.col("n_x") == 0, F.lit(S.STATUS_SUCCESS))
               .when(F.col("n_x") == F.col("n_cells"), F.lit(S.STATUS_ERROR))
               .otherwise(F.lit(S.STATUS_PARTIAL)))
    selection = F.map_filter(F.create_map(
        F.lit("prompt_template_key"), template,
        F.lit("scenario"), F.lit(SCENARIO),
        F.lit("cialdini_emphasis_key"), e_sel,
        F.lit("representative_key"), r_sel,
        F.lit("benign_context_key"), c_sel,
    ), lambda k, v: v.isNotNull())
    return agg.select(
        cid,
        cid.cast("string").alias("request_id"),
        F.lit(0).cast("long").alias("replicate_index"),
        template.alias("prompt_template_key"),
        F.lit(SCENARIO).alias("scenario"),
        sentence(rep, REPRESENTATIVE_SENTENCES).alias("representative"),
        r_key.alias("representative_key"),
        F.when(threat, F.lit(CALLERS[0])).otherwise(F.lit(CALLERS[1])).alias("caller"),
        sentence(ctx, CONTEXT_SENTENCES).alias("benign_context"),
        c_key.alias("benign_context_key"),
        emph_raw.alias("cialdini_emphasis"),
        e_key.alias("cialdini_emphasis_key"),
        selection.alias("selection"),
        F.col("turn_count_value"),
        F.concat(F.lit("flavor_"), (cid % 8).cast("string")).alias("flavor"),
        F.lit(GENERATION_MODEL).alias("generation_model"),
        F.date_format(F.timestamp_seconds(F.lit(EPOCH_SECONDS) + cid * 37),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at_utc"),
        (400 + (cid * 37) % 211).cast("long").alias("generation_input_tokens"),
        F.expr("n_chars div 4").cast("long").alias("generation_output_tokens"),
        F.lit(DETECTION_MODEL).alias("detection_model"),
        status.alias("detection_status"),
        F.col("n_cells"), F.col("n_x"), F.col("n_e"),
    )


ANALYSIS = "analysis_set"


def ingest(spark: SparkSession, sf_dir: str, out: str) -> dict[str, str]:
    """Derive the domain tables once and write them to ``out`` (a folder in the
    shared checkpoint dir): ``meta`` (one row per conversation), ``turns`` (one
    row per turn) and ``detections`` (one row per detector cell), the last two
    partitioned by analysis-set membership so analysis reads prune the
    quarantined conversations. No text is copied: a turn row keeps its passage's
    length, and what needs texts reads them from the source
    (``Domain.text_turns``). Conversation attributes are attached with a
    join on the conversation id (AQE broadcasts the narrow side when its
    runtime size allows, and splits a hot conversation otherwise)."""
    raw = raw_turns(spark, sf_dir)
    rows = turn_rows(raw)
    paths = {k: f"{out}/{k}" for k in ("meta", "turns", "detections")}
    conversation_meta(rows).write.mode("overwrite").parquet(paths["meta"])
    meta = spark.read.parquet(paths["meta"])
    m = meta.select(
        "conv_id", F.col("turn_count_value").alias("n_turns"),
        F.col("prompt_template_key").alias("conversation_type"), "detection_status", "n_e",
        ((F.col("detection_status") == S.STATUS_SUCCESS) & (F.col("n_e") == 0)).cast("int").alias(ANALYSIS))
    (rows.withColumn("passage_length", F.length(F.coalesce("passage", F.lit(""))).cast("long"))
     .drop("passage", "n_cells_turn", "n_x_turn", "n_e_turn").join(m, "conv_id")
     .write.mode("overwrite").partitionBy(ANALYSIS).parquet(paths["turns"]))
    detection_rows(raw.select("conv_id", "turn_index")).join(m, "conv_id").drop("conv_id") \
        .write.mode("overwrite").partitionBy(ANALYSIS).parquet(paths["detections"])
    return paths


_INGESTED: dict[tuple[str, str], dict[str, str]] = {}


@dataclass
class Domain:
    """Domain tables for one scale-factor directory, ingested on first use."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def paths(self) -> dict[str, str]:
        from ..session import scratch_path, session_key
        key = (session_key(self.spark), self.sf_dir, GROWTH)
        if key not in _INGESTED:
            _INGESTED[key] = ingest(self.spark, self.sf_dir, scratch_path(self.spark, "domain"))
        return _INGESTED[key]

    @cached_property
    def meta(self) -> DataFrame:
        """All conversations with run status (detection-stage view)."""
        return self.spark.read.parquet(self.paths["meta"])

    @cached_property
    def all_turns(self) -> DataFrame:
        """Turn rows of every conversation with n_turns, type and status."""
        return self.spark.read.parquet(self.paths["turns"])

    @cached_property
    def text_turns(self) -> DataFrame:
        """Turn rows with their passages and flags: a projection of the source."""
        return turn_rows(raw_turns(self.spark, self.sf_dir)).drop("n_cells_turn", "n_x_turn", "n_e_turn")

    @cached_property
    def all_detections(self) -> DataFrame:
        """Long detector cells of every conversation (raw codes)."""
        return self.spark.read.parquet(self.paths["detections"])

    @cached_property
    def analysis_meta(self) -> DataFrame:
        """P1 + quarantine: status success and no E code."""
        return self.meta.filter((F.col("detection_status") == S.STATUS_SUCCESS) & (F.col("n_e") == 0))

    @cached_property
    def turns(self) -> DataFrame:
        """Analysis turn rows (success conversations without E); partition-pruned."""
        return self.all_turns.filter(F.col(ANALYSIS) == 1)

    @cached_property
    def detections(self) -> DataFrame:
        """Analysis detector cells; partition-pruned."""
        return self.all_detections.filter(F.col(ANALYSIS) == 1)
