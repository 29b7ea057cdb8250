"""Turn- and conversation-level facts.

Inputs are the long tables:
  turns      (request_id, turn_index, n_turns, conversation_type, passage, <10 boolean flags>)
  detections (request_id, turn_index, objective, stance, pred, p_detected, p_not_detected, …)

Every fact is a group-by with partial (map-side) aggregation keyed by
``request_id`` — never a collected list — so a very long conversation is
reduced before the shuffle. Windows appear only in the running totals, which
are computed per block of turns so no single window partition is unbounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import eligible, n_eligible_from, normalize_prediction, speaker

RUNNING_BLOCK = 256   # turns per block for block-wise running totals


def _is_caller(t: Column) -> Column:
    return t % 2 == 1


def _is_rep_response(t: Column) -> Column:
    return (t >= 2) & (t % 2 == 0)


def flag_ints(turns: DataFrame, masked: bool = False) -> DataFrame:
    """Flags as integers plus ``any_violation``.

    masked=False (P15): 0 off-speaker, so sums and firsts work directly.
    masked=True (P14): null off-speaker — the turn-table presentation.
    """
    t = F.col("turn_index")
    off = F.lit(None) if masked else F.lit(0)
    cols = []
    for f in S.CALLER_FLAGS:
        cols.append(F.when(_is_caller(t), F.coalesce(F.col(f).cast("int"), F.lit(0)))
                    .otherwise(off).cast("long").alias(f))
    for f in S.VIOLATION_FLAGS:
        cols.append(F.when(_is_rep_response(t), F.coalesce(F.col(f).cast("int"), F.lit(0)))
                    .otherwise(off).cast("long").alias(f))
    anyv = F.greatest(*[F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in S.VIOLATION_FLAGS])
    cols.append(F.when(_is_rep_response(t), anyv).otherwise(off).cast("long").alias("any_violation"))
    keep = [c for c in turns.columns if c not in S.ALL_FLAGS and c != "cells"]
    return turns.select(*keep, *cols)


def turn_table(turns: DataFrame) -> DataFrame:
    """P8/P14/P16 + W2: one row per (conversation, turn) with masked flags,
    passage length and the cumulative any-violation ground truth."""
    base = flag_ints(turns, masked=True)
    t = F.col("turn_index")
    length = (F.col("passage_length") if "passage_length" in base.columns
              else F.length(F.coalesce(F.col("passage"), F.lit(""))).cast("long"))
    cum = cumulative_max(base, "any_violation")
    return (cum.select(
        "request_id", "conversation_type", "turn_index",
        speaker(t).alias("speaker"), "n_turns",
        length.alias("passage_length"),
        *S.ALL_FLAGS, "any_violation",
        F.when(_is_rep_response(t), F.col("cum_any_violation")).cast("long")
         .alias("cumulative_any_violation")))


#: Per-turn fields of a detector cell in the turn table, and their source column.
CELL_FIELDS = {"prediction": "pred"} | {f: f for f in S.PER_TURN_FIELDS[1:]}


def with_predictions(turns: DataFrame, det: DataFrame) -> DataFrame:
    """The turn table with one column per detector key and field, 36 in all,
    filled on the turns that are eligible for the key's objective, else null.
    One aggregation per turn (at most three cells each), joined to its turn."""
    out = []
    for k in S.DETECTION_KEYS:
        objective, stance = k.split("__")
        own = (F.col("objective") == objective) & (F.col("stance") == stance) & eligible(objective, "turn_index")
        out += [F.max(F.when(own, F.col(src))).alias(f"{k}__{f}") for f, src in CELL_FIELDS.items()]
    cells = det.groupBy("request_id", "turn_index").agg(*out)
    return turns.join(cells, ["request_id", "turn_index"], "left")


def turns_from_lists(wide: DataFrame, parse: Callable[[Column, str], Column]) -> DataFrame:
    """P8 over the wide form: the per-turn JSON lists of every conversation as
    one row per turn, values on eligible turns only. ``parse`` reads a list cell
    (P7); lists are walked together by position, so a conversation's turns are
    one generator and no shuffle runs."""
    names = [f"{k}__{f}" for k in S.DETECTION_KEYS for f in S.PER_TURN_FIELDS]
    types = {"prediction": "string", "p_detected": "double", "p_not_detected": "double"}
    lists = wide.select("request_id", *[parse(F.col(n), types.get(n.split("__")[2], "bigint")).alias(n) for n in names])
    rows = lists.select("request_id", F.posexplode(F.arrays_zip(*names)).alias("turn_index", "c"))
    t = F.col("turn_index").cast("long")
    cells = []
    for n in names:
        objective, _, field = n.split("__")
        value = normalize_prediction(F.col(f"c.{n}")) if field == "prediction" else F.col(f"c.{n}")
        cells.append(F.when(eligible(objective, t), value).alias(n))
    return rows.select("request_id", t.alias("turn_index"), *cells)


def _blocked(df: DataFrame) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col("turn_index") / RUNNING_BLOCK))


def running_totals(turns: DataFrame, flags: tuple[str, ...] | None = None) -> DataFrame:
    """Inclusive running totals per flag (and any) along turn order.

    Two-level so a hot conversation never forms one window partition:
    block totals → prefix over blocks (n/B rows per conversation) → running
    sum within (conversation, block) partitions of at most B rows.
    """
    base = flag_ints(turns)
    names = list(flags or (S.ALL_FLAGS + ("any_violation",)))
    b = _blocked(base.select("request_id", "turn_index", *names))
    blk = b.groupBy("request_id", "_blk").agg(*[F.sum(n).alias(n) for n in names])
    w_blk = Window.partitionBy("request_id").orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = blk.select("request_id", "_blk", *[
        F.coalesce(F.sum(n).over(w_blk), F.lit(0)).alias(f"_off_{n}") for n in names])
    w_in = Window.partitionBy("request_id", "_blk").orderBy("turn_index").rowsBetween(
        Window.unboundedPreceding, 0)
    inner = b.select("request_id", "turn_index", "_blk", *[
        F.sum(n).over(w_in).alias(f"_in_{n}") for n in names])
    return inner.join(offsets, ["request_id", "_blk"]).select(
        "request_id", "turn_index",
        *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).cast("long").alias(f"running_total_{n}")
          for n in names])


def cumulative_max(df: DataFrame, col: str) -> DataFrame:
    """W2 helper: ``cum_<col>`` = 1 iff ``col`` was 1 at or before this turn,
    block-wise like :func:`running_totals`."""
    b = _blocked(df)
    v = F.coalesce(F.col(col), F.lit(0))
    blk = b.groupBy("request_id", "_blk").agg(F.max(v).alias("_bmax"))
    w_blk = Window.partitionBy("request_id").orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = blk.select("request_id", "_blk",
                         F.coalesce(F.max("_bmax").over(w_blk), F.lit(0)).alias("_boff"))
    w_in = Window.partitionBy("request_id", "_blk").orderBy("turn_index").rowsBetween(
        Window.unboundedPreceding, 0)
    return (b.withColumn("_in", F.max(v).over(w_in))
            .join(offsets, ["request_id", "_blk"])
            .withColumn(f"cum_{col}", F.greatest("_in", "_boff"))
            .drop("_blk", "_in", "_boff"))


def conversation_flag_facts(turns: DataFrame) -> DataFrame:
    """§2.4 A1, A3–A6: one partial-aggregated group-by on request_id."""
    f = flag_ints(turns)
    t = F.col("turn_index")
    # midpoint = turn index of caller turn number ⌊n_caller/2⌋ (0-based);
    # caller turns are the odd indices of a contiguous conversation.
    n_caller = F.floor(F.col("n_turns") / 2)
    midpoint = 2 * F.floor(n_caller / 2) + 1
    aggs = [
        F.first("n_turns").alias("n_turns"),
        F.count_if(_is_caller(t)).alias("n_caller_turns"),
        F.count_if(~_is_caller(t)).alias("n_rep_turns_total"),
    ]
    for c in S.ALL_FLAGS + ("any_violation",):
        aggs.append(F.sum(c).alias(f"total_{c}"))
    for c in S.VIOLATION_FLAGS:
        aggs.append(F.min(F.when(F.col(c) == 1, t)).alias(f"first_violation_turn__{c}"))
    aggs.append(F.min(F.when(F.col("any_violation") == 1, t)).alias("first_violation_turn__any"))
    for c in S.CALLER_FLAGS:
        aggs.append(F.min(F.when(F.col(c) == 1, t)).alias(f"first_occurrence_turn__{c}"))
        aggs.append(F.sum(F.when((n_caller > 0) & (t < midpoint), F.col(c)).otherwise(0))
                    .alias(f"early_count_{c}"))
        aggs.append(F.sum(F.when((n_caller > 0) & (t >= midpoint), F.col(c)).otherwise(0))
                    .alias(f"late_count_{c}"))
    out = f.groupBy("request_id", "conversation_type").agg(*aggs)
    return out.withColumn("n_rep_response_turns",
                          F.greatest(F.col("n_rep_turns_total") - 1, F.lit(0)))


def every_key(conversations: DataFrame, stances: bool = True) -> DataFrame:
    """Conversations × objectives (× stances), generated per row."""
    out = conversations.select("*", F.explode(F.array(*[F.lit(o) for o in S.OBJECTIVES])).alias("objective"))
    if stances:
        out = out.select("*", F.explode(F.array(*[F.lit(x) for x in S.STANCES])).alias("stance"))
    return out


def detection_facts(detections: DataFrame, conv_facts: DataFrame) -> DataFrame:
    """§2.4 A7, A8, A10, A11 at grain (request_id, objective, stance).

    Every conversation has a row for every key, also without a cell. Only
    eligible cells count. first/last prediction turn, n_fired and the
    margin come from one group-by; lead and persistence are arithmetic on
    that row (eligible turns from fp on follow from n_turns by parity).
    """
    d = detections.filter(eligible(F.col("objective"), F.col("turn_index")))
    t = F.col("turn_index")
    margin = F.when(F.col("p_detected").isNotNull() & F.col("p_not_detected").isNotNull(),
                    F.col("p_detected") - F.col("p_not_detected"))
    k = d.groupBy("request_id", "objective", "stance").agg(
        F.min(F.when(F.col("pred") == 1, t)).alias("first_prediction_turn"),
        F.max(F.when(F.col("pred") == 1, t)).alias("last_prediction_turn"),
        F.count_if(F.col("pred") == 1).alias("n_fired"),
        F.count("pred").alias("n_predicted"),
        F.count(F.lit(1)).alias("n_eligible"),
        F.avg(margin).alias("mean_confidence_margin"),
    )
    cf = every_key(conv_facts.select("request_id", "conversation_type", "n_turns", "first_violation_turn__any"))
    fp = F.col("first_prediction_turn")
    return (cf.join(k, ["request_id", "objective", "stance"], "left")
            .fillna(0, ["n_fired", "n_predicted", "n_eligible"])
            .withColumn("lead", F.col("first_violation_turn__any") - fp)
            .withColumn("persistence_rate",
                        F.col("n_fired") / n_eligible_from(F.col("objective"), fp, F.col("n_turns"))))


def with_pre_at_post(det_core: DataFrame, turns: DataFrame) -> DataFrame:
    """Violations before / at / after the first prediction, per type × key;
    all null without a prediction. Only turns carrying a violation take part
    in the join (all-zero turns add nothing to the sums)."""
    t = F.col("turn_index")
    fp = F.col("first_prediction_turn")
    v = (flag_ints(turns).select("request_id", "turn_index", *S.VIOLATION_FLAGS)
         .filter(F.greatest(*[F.col(c) for c in S.VIOLATION_FLAGS]) > 0))
    pap = []
    for vt in S.VIOLATION_FLAGS:
        pap += [F.sum(F.when(t < fp, F.col(vt)).otherwise(0)).alias(f"violations_pre__{vt}"),
                F.sum(F.when(t == fp, F.col(vt)).otherwise(0)).alias(f"violations_at__{vt}"),
                F.sum(F.when(t > fp, F.col(vt)).otherwise(0)).alias(f"violations_post__{vt}")]
    counts = (det_core.select("request_id", "objective", "stance", "first_prediction_turn")
              .filter(fp.isNotNull()).join(v, "request_id")
              .groupBy("request_id", "objective", "stance").agg(*pap))
    out = det_core.join(counts, ["request_id", "objective", "stance"], "left")
    zero = [F.when(fp.isNotNull(), F.coalesce(F.col(c), F.lit(0))).alias(c)
            for vt in S.VIOLATION_FLAGS
            for c in (f"violations_pre__{vt}", f"violations_at__{vt}", f"violations_post__{vt}")]
    keep = [c for c in out.columns if not c.startswith("violations_")]
    return out.select(*keep, *zero)


def combined_first(det_facts: DataFrame) -> DataFrame:
    """Earliest first prediction of either objective per stance, and its lead."""
    return (det_facts.groupBy("request_id", "stance")
            .agg(F.min("first_prediction_turn").alias("first_prediction_turn"),
                 F.first("first_violation_turn__any").alias("first_violation_turn__any"))
            .withColumn("lead", F.col("first_violation_turn__any") - F.col("first_prediction_turn")))


def stance_concordance(detections: DataFrame, conversations: DataFrame) -> DataFrame:
    """Eligible turns where all stances agree (null counts as not fired);
    a row of zeros for a conversation without such turns."""
    d = detections.filter(eligible(F.col("objective"), F.col("turn_index")))
    b = F.when(F.col("pred") == 1, 1).otherwise(0)
    per_turn = d.groupBy("request_id", "objective", "turn_index").agg(
        (F.min(b) == F.max(b)).alias("agree"))
    counts = per_turn.groupBy("request_id", "objective").agg(
        F.count_if("agree").alias("stance_concordant_turns"),
        F.count_if(~F.col("agree")).alias("stance_discordant_turns"))
    return (every_key(conversations.select("request_id"), stances=False)
            .join(counts, ["request_id", "objective"], "left").fillna(0))


def stance_firsts(detections: DataFrame) -> DataFrame:
    """Per (conversation, stance): first SE fire, first and last PV fire —
    one aggregation feeding the scenario scores (A23/J9) and flow edges."""
    d = detections.filter(eligible(F.col("objective"), F.col("turn_index")))
    t = F.col("turn_index")
    fired = F.col("pred") == 1
    se = F.col("objective") == "social_engineering"
    pv = F.col("objective") == "policy_violation"
    return d.groupBy("request_id", "stance").agg(
        F.min(F.when(se & fired, t)).alias("se_first"),
        F.min(F.when(pv & fired, t)).alias("pv_first"),
        F.max(F.when(pv & fired, t)).alias("pv_last"))
