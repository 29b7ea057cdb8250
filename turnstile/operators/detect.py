"""Detection stage (SURVEY J2, J7, W3, W7, P10, P11, P21, P28, A14–A16,
A34–A36, D1): planning, request fan-out, transcript prefixes, decoding of
candidate tokens, and per-run roll-ups over the long ``detections`` table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..session import ship_package
from ..functions.columns import eligible, normalize_prediction

# Stance order the detector walks within a turn (the detection stage's own
# order, which differs from the analysis order; fixed value).
CALL_ORDER = ("high_precision", "high_recall", "balanced")


def stance_dim(spark: SparkSession, stances: tuple[str, ...] = S.STANCES) -> DataFrame:
    """Speaker → objective → stance rows (6); a fixed-size dimension."""
    rows = [(sp, obj, st, i) for sp, obj in S.OBJECTIVE_OF_SPEAKER.items()
            for i, st in enumerate(stances)]
    return spark.createDataFrame(rows, "speaker string, objective string, stance string, stance_ord int")


def detector_requests(turns: DataFrame, stances: DataFrame) -> DataFrame:
    """Every turn ≥ 1 × the stances of the objective bound to its speaker.
    The stance dimension is a handful of rows, so it is broadcast."""
    t = turns.filter(F.col("turn_index") >= 1).select("request_id", "turn_index", "speaker")
    return t.join(F.broadcast(stances), "speaker").select(
        "request_id", "turn_index", "speaker", "objective", "stance",
        F.concat_ws("__", "objective", "stance").alias("detection_key"))


PREFIX_BLOCK = 256              # turns of a transcript block


def _lines(turns: DataFrame, block: int) -> DataFrame:
    label = F.when(F.col("turn_index") % 2 == 1, F.lit("Caller")).otherwise(F.lit("Representative"))
    return turns.select("request_id", "turn_index", F.floor(F.col("turn_index") / block).alias("_block"),
                        F.concat(label, F.lit(": "), F.coalesce(F.col("passage"), F.lit(""))).alias("_line"))


def prefix_offsets(turns: DataFrame, block: int = PREFIX_BLOCK) -> DataFrame:
    """W3 as an index: ``(request_id, turn_index, begin, end)``, the characters
    of the whole transcript that a turn's line takes; the transcript through a
    turn is what lies before its ``end``. Lengths only: sums per block, running
    sums over blocks, then within a block, so no window is longer than a block
    or a conversation's number of blocks."""
    rows = _lines(turns, block).select("request_id", "turn_index", "_block", (F.length("_line") + 2).alias("_size"))
    before = Window.partitionBy("request_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("request_id", "_block").agg(F.sum("_size").alias("_sum")).select(
        "request_id", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("request_id", "_block").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_base") + F.sum("_size").over(inner) - 2
    return rows.join(blocks, ["request_id", "_block"]).select(
        "request_id", "turn_index", "_size", end.alias("end")).select(
        "request_id", "turn_index", (F.col("end") - F.col("_size") + 2).alias("begin"), "end")


def transcript_prefix(turns: DataFrame, block: int = PREFIX_BLOCK) -> DataFrame:
    """Transcript through each turn, ``Representative: …`` / ``Caller: …``
    lines joined by a blank line.

    A turn's text is that of the blocks before its own and the lines up to it
    within its block. Each block's text goes once to every later block of its
    conversation, so tasks hold a block's lines or one transcript, never the
    transcripts of a conversation. Output is O(n²) characters per conversation
    by definition; a consumer that can slice takes ``prefix_offsets``."""
    lines = _lines(turns, block)
    w = Window.partitionBy("request_id", "_block").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.select("request_id", "turn_index", "_block", F.array_join(F.collect_list("_line").over(w), "\n\n").alias("_own"))
    ends = lines.groupBy("request_id").agg(F.max("_block").alias("_last")).where(F.col("_last") > 0)
    texts = lines.join(ends.select("request_id"), "request_id", "left_semi").groupBy("request_id", "_block").agg(
        F.array_sort(F.collect_list(F.struct("turn_index", "_line"))).alias("_rows")).select(
        "request_id", F.col("_block").alias("_from"), F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n\n").alias("_text"))
    sent = texts.join(ends, "request_id").where(F.col("_from") < F.col("_last")).select(
        "request_id", "_from", "_text", F.explode(F.sequence(F.col("_from") + 1, F.col("_last"))).alias("_block"))
    heads = sent.groupBy("request_id", "_block").agg(
        F.array_sort(F.collect_list(F.struct("_from", "_text"))).alias("_parts")).select(
        "request_id", "_block", F.array_join(F.transform("_parts", lambda r: r["_text"]), "\n\n").alias("_head"))
    return own.join(heads, ["request_id", "_block"], "left").select(
        "request_id", "turn_index", F.concat_ws("\n\n", "_head", "_own").alias("transcript"))


def candidates_from_cells(det: DataFrame) -> DataFrame:
    """Candidate token lists for the fixture cells (what the scorer would
    return): Y/N with ln(p), an off-vocabulary token, and no Y/N for E cells."""
    e = F.col("code") == "E"
    cand = F.array(
        F.struct(F.lit("maybe").alias("token"), F.log(F.lit(0.002)).alias("logprob")),
        F.struct(F.when(e, F.lit("No")).otherwise(F.lit("N")).alias("token"),
                 F.log(F.col("p_not_detected")).alias("logprob")),
        F.struct(F.when(e, F.lit("Yes")).otherwise(F.lit("Y")).alias("token"),
                 F.log(F.col("p_detected")).alias("logprob")),
    )
    return det.select("request_id", "turn_index", "objective", "stance", "code",
                      F.when(F.col("code") != "X", cand).alias("candidates"))


def decode_top10(df: DataFrame, col: str = "candidates", top_n: int = 10) -> DataFrame:
    """P28 + W7: sort candidates by logprob desc (ties keep input order), keep
    the top ``top_n`` with prob = bround(exp(logprob), 3); the first exact
    'Y'/'N' decides the prediction, else 'E'; p_Y / p_N come from the token
    lookup (last duplicate wins), default 0.0. A null list (failed call) → 'X'."""
    # natural struct order (−logprob, position) = logprob desc, ties in input
    # order; sort_array compiles natively (no interpreted comparator lambda)
    keyed = F.transform(F.col(col), lambda x, i: F.struct(
        (-x["logprob"]).alias("nlp"), i.alias("pos"), x["token"].alias("token"),
        x["logprob"].alias("logprob")))
    ordered = F.sort_array(keyed, asc=True)
    top = F.slice(ordered, 1, top_n)
    top10 = F.transform(top, lambda x: F.struct(
        x["token"].alias("token"), F.bround(F.exp(x["logprob"]), 3).alias("prob")))
    failed = F.col(col).isNull()
    # materialise top10 once as a column; the three derived fields read it by
    # name (re-using the Column object would re-evaluate the sort per field)
    out = df.drop("prediction", "p_detected", "p_not_detected").withColumn(
        "top10", F.when(~failed, top10))
    t10 = F.col("top10")
    yn = F.filter(t10, lambda x: x["token"].isin("Y", "N"))

    def lookup(tok: str) -> Column:
        hits = F.filter(t10, lambda x: x["token"] == tok)
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["prob"], F.lit(0.0))

    return out.select("*",
                      F.when(failed, F.lit("X"))
                       .otherwise(F.coalesce(F.try_element_at(yn, F.lit(1))["token"], F.lit("E")))
                       .alias("prediction"),
                      F.when(~failed, lookup("Y")).alias("p_detected"),
                      F.when(~failed, lookup("N")).alias("p_not_detected"))


def normalize_predictions(det: DataFrame, code_col: str = "code") -> DataFrame:
    """P10 over a raw code column."""
    return det.withColumn("pred", normalize_prediction(F.col(code_col)))


def prediction_violations(det: DataFrame) -> DataFrame:
    """Eligible cells must hold 0/1, ineligible cells must be null;
    one row per offending cell with a reason (strict mode raises on any)."""
    el = eligible(F.col("objective"), F.col("turn_index"))
    p = F.col("pred")
    reason = (F.when(el & p.isNull(), F.concat(F.lit("eligible turn without a 0/1 prediction: code "),
                                                F.coalesce(F.col("code"), F.lit("null"))))
               .when(~el & p.isNotNull(), F.lit("prediction on an ineligible turn")))
    return det.select("request_id", "turn_index", "objective", "stance", "code", "pred",
                      reason.alias("reason")).filter(F.col("reason").isNotNull())


def run_columns_aggs() -> list:
    """Aggregates for the run columns of the wide export (one group-by with the lists)."""
    code = F.col("code")
    order = F.array_position(F.array(*[F.lit(s) for s in CALL_ORDER]), F.col("stance"))
    msg = F.when(code == "X", F.concat(
        F.lit("call failed at turn "), F.col("turn_index").cast("string"), F.lit(" ("),
        F.col("objective"), F.lit("__"), F.col("stance"), F.lit(")")))
    return [
        F.count(code).alias("n_applicable"), F.count_if(code == "X").alias("detection_error_count"),
        F.count_if(code == "E").alias("detection_no_valid_count"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("detection_total_latency_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("detection_total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("detection_total_output_tokens"),
        F.coalesce(F.max_by(msg, F.when(msg.isNotNull(), F.struct(F.col("turn_index"), order))),
                   F.lit("")).alias("detection_last_error"),
    ]


def _json_text(value: Column) -> Column:
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def pair_list(top10: Column) -> Column:
    """A top-10 list as JSON text of ``[token, probability]`` pairs."""
    pair = F.transform(top10, lambda x: F.concat(
        F.lit("["), _json_text(x["token"]), F.lit(", "), x["prob"].cast("string"), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(pair, ", "), F.lit("]"))


def status_from_counts(n_applicable: Column, n_x: Column) -> Column:
    return (F.when(n_applicable == 0, F.lit(S.STATUS_SUCCESS))
             .when(n_x == 0, F.lit(S.STATUS_SUCCESS))
             .when(n_x == n_applicable, F.lit(S.STATUS_ERROR))
             .otherwise(F.lit(S.STATUS_PARTIAL)))


def _for_all(per: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Per-conversation rows for every one of ``conversations``, with nulls for
    one without a cell; as they are if no conversations are given."""
    if conversations is None:
        return per
    return conversations.select("request_id").join(per, "request_id", "left")


def run_status(det: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Success (nothing applicable, or no X) / error (all X) / partial."""
    g = _for_all(det.groupBy("request_id").agg(F.count("code").alias("n_applicable"),
                                               F.count_if(F.col("code") == "X").alias("n_x")), conversations).fillna(0)
    return g.withColumn("detection_status", status_from_counts(F.col("n_applicable"), F.col("n_x")))


def run_totals(det: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Latency and token totals over all cells, nulls ignored."""
    return _for_all(det.groupBy("request_id").agg(
        F.sum("latency_ms").alias("detection_total_latency_ms"),
        F.sum("input_tokens").alias("detection_total_input_tokens"),
        F.sum("output_tokens").alias("detection_total_output_tokens")), conversations).fillna(0)


def error_message(det: DataFrame) -> Column:
    """Message recorded for a failed call (fixture rule)."""
    return F.when(F.col("code") == "X", F.concat(
        F.lit("call failed at turn "), F.col("turn_index").cast("string"), F.lit(" ("),
        F.col("objective"), F.lit("__"), F.col("stance"), F.lit(")")))


def error_counts(det: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Counts of E and X and the last error message in call order
    (turn, then the detector's stance order); '' if none."""
    order = F.array_position(F.array(*[F.lit(s) for s in CALL_ORDER]), F.col("stance"))
    seq = F.struct(F.col("turn_index"), order)
    msg = error_message(det)
    return _for_all(det.groupBy("request_id").agg(
        F.count_if(F.col("code") == "X").alias("detection_error_count"),
        F.count_if(F.col("code") == "E").alias("detection_no_valid_count"),
        F.max_by(msg, F.when(msg.isNotNull(), seq)).alias("detection_last_error")), conversations).fillna(0).fillna("")


def stance_index(det: DataFrame) -> DataFrame:
    """(conversation, objective) → sorted set of stances with a positive
    code ('Y', or the legacy 'S')."""
    return (det.filter(F.col("code").isin("Y", "S"))
            .groupBy("request_id", "objective")
            .agg(F.array_join(F.array_sort(F.collect_set("stance")), ",").alias("fired_stances")))


def postrun_summary(det: DataFrame) -> DataFrame:
    """Per key n_Y/N/E/X, calls, Y-rate over resolved, mean p_Y on Y and on
    N, mean latency and tokens; always 6 rows."""
    d = det.filter(F.col("code").isNotNull())
    c = F.col("code")
    g = d.groupBy(F.concat_ws("__", "objective", "stance").alias("key")).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(c == "Y").alias("n_Y"), F.count_if(c == "N").alias("n_N"),
        F.count_if(c == "E").alias("n_E"), F.count_if(c == "X").alias("n_X"),
        F.avg(F.when(c == "Y", F.col("p_detected"))).alias("mean_p_Y_on_Y"),
        F.avg(F.when(c == "N", F.col("p_detected"))).alias("mean_p_Y_on_N"),
        F.avg("latency_ms").alias("mean_lat_ms"),
        F.avg("input_tokens").alias("mean_in_tok"),
        F.avg("output_tokens").alias("mean_out_tok"))
    g = g.withColumn("Y_rate", F.try_divide(F.col("n_Y").cast("double"),
                                            F.nullif(F.col("n_Y") + F.col("n_N"), F.lit(0))))
    grid = det.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(k) for k in S.DETECTION_KEYS])).alias("key"))
    out = grid.join(g, "key", "left")
    return out.select("key", *[F.coalesce(x, F.lit(0)).alias(x)
                               for x in ("n_calls", "n_Y", "n_N", "n_E", "n_X")],
                      "Y_rate", "mean_p_Y_on_Y", "mean_p_Y_on_N", "mean_lat_ms",
                      "mean_in_tok", "mean_out_tok")


def calls_failed(det: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversations with at least one X, and the total."""
    x = det.filter(F.col("code") == "X").select("request_id").distinct() \
        .agg(F.count(F.lit(1)).alias("n_with_failed_call"))
    n = conversations.agg(F.count(F.lit(1)).alias("n_conversations"))
    return _two_scalars(x, n)


def _two_scalars(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two single-row aggregates side by side (zip of one-row frames)."""
    a1 = a.withColumn("_k", F.lit(1))
    b1 = b.withColumn("_k", F.lit(1))
    return a1.join(b1, "_k").drop("_k")


def run_summary(planned: DataFrame, det: DataFrame, status: DataFrame) -> DataFrame:
    """One global row — planned, success/partial/error, calls, Y/N/E/X."""
    c = F.col("code")
    calls = det.filter(c.isNotNull()).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(c == "Y").alias("n_y"),
        F.count_if(c == "N").alias("n_n"), F.count_if(c == "E").alias("n_e"),
        F.count_if(c == "X").alias("n_x"))
    st = status.agg(
        F.count_if(F.col("detection_status") == S.STATUS_SUCCESS).alias("n_success"),
        F.count_if(F.col("detection_status") == S.STATUS_PARTIAL).alias("n_partial"),
        F.count_if(F.col("detection_status") == S.STATUS_ERROR).alias("n_error"))
    pl = planned.agg(F.count(F.lit(1)).alias("n_planned"))
    return _two_scalars(_two_scalars(pl, st), calls)


def detection_plan(gen_rows: DataFrame, done: DataFrame, store: DataFrame,
                   ordinal: str = "ordinal", max_requests: int | None = None) -> DataFrame:
    """J2 + O4: generation rows not already successful and with a stored
    conversation, in file order; ``max_requests`` caps the work (a prefix)."""
    ok = done.filter(F.col("detection_status") == S.STATUS_SUCCESS).select("request_id")
    plan = (gen_rows.join(ok, "request_id", "left_anti")
            .join(store.select("request_id").distinct(), "request_id", "left_semi"))
    if max_requests is not None:
        plan = plan.orderBy(ordinal).limit(max_requests)
    return plan


# ---------------------------------------------------------------- D1 scorer
ScorerFn = Callable[[pd.DataFrame], pd.DataFrame]

SCORE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("turn_index", T.LongType()),
    T.StructField("objective", T.StringType()),
    T.StructField("stance", T.StringType()),
    T.StructField("candidates", S.TOKEN_PROB),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("error", T.StringType()),
])

# FIXED VALUES of the shipped lexical scorer: cue words per objective and the
# per-stance offset added to the cue share (the stance's leniency).
CUE_WORDS = {
    "social_engineering": ("urgent", "password", "verify", "account", "manager", "immediately"),
    "policy_violation": ("here is", "i have updated", "your code", "confirmed", "reset"),
}
STANCE_BIAS = {"high_precision": -0.15, "balanced": 0.0, "high_recall": 0.15}

CUSTOM_STANCE = "__custom__"
OBJECTIVE_PROMPTS = {
    "social_engineering": "Decide whether the caller's last turn manipulates the representative.",
    "policy_violation": "Decide whether the representative's last turn breaks the call policy.",
}
STANCE_INSTRUCTIONS = {
    "high_precision": "Answer Y only when you are certain.",
    "balanced": "Weigh both kinds of error alike.",
    "high_recall": "Answer Y whenever it is plausible.",
}


def system_prompts(stances: Iterable[str] = S.STANCES, custom_text: str = "") -> dict[tuple[str, str], str]:
    """System prompt of every (objective, stance); the custom stance carries the
    user's own text."""
    told = STANCE_INSTRUCTIONS | {CUSTOM_STANCE: custom_text.strip()}
    return {(o, s): f"{text}\n\n{told.get(s, '')}\n\nAnswer Y or N." for o, text in OBJECTIVE_PROMPTS.items() for s in stances}


def lexical_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for the detector: P(Y) from the share of cue
    words in the whole transcript, shifted by stance. Pure function of its
    input, so batch and stream scoring agree."""
    import numpy as np

    place, texts = pd.factorize(batch["transcript"], use_na_sentinel=False)      # a turn's stances share its transcript
    objective, share = batch["objective"].to_numpy(), np.zeros(len(batch))
    for obj, cues in CUE_WORDS.items():
        rows = np.flatnonzero(objective == obj)
        own, back = np.unique(place[rows], return_inverse=True)
        said = [texts[k].lower() for k in own]
        hits = np.array([sum(t.count(c) for c in cues) for t in said], "int64")
        words = np.array([t.count(" ") + 1 for t in said], "int64")
        share[rows] = np.minimum(1.0, 20.0 * hits / words)[back]
    bias = batch["stance"].map(STANCE_BIAS).fillna(0.0).to_numpy()
    p_y = np.clip(0.05 + 0.9 * share + bias, 0.001, 0.999)
    cands = [[("Y", float(np.log(p))), ("N", float(np.log(1.0 - p)))] for p in p_y]
    n_chars = np.array([len(t) for t in texts], "int64")[place]
    return pd.DataFrame({
        "request_id": batch["request_id"], "turn_index": batch["turn_index"],
        "objective": batch["objective"], "stance": batch["stance"],
        "candidates": cands,
        "latency_ms": (80 + n_chars % 721).astype("int64"),
        "input_tokens": (n_chars // 4 + 50).astype("int64"),
        "output_tokens": np.ones(len(batch), dtype="int64"),
    })


REQUEST_KEY = ["request_id", "turn_index", "objective", "stance"]


def call_scorer(scorer: ScorerFn, requests: pd.DataFrame, attempts: int = 3) -> pd.DataFrame:
    """Score a batch of requests. If the batch call raises, its halves are
    called, and so on down to single requests, which are called up to
    ``attempts`` times; one that still fails keeps null candidates (read as
    ``X``) and its own message, and harms no other row."""
    names = [f.name for f in SCORE_SCHEMA.fields]
    if not len(requests):
        return pd.DataFrame({n: [] for n in names})
    try:
        return scorer(requests).assign(error=None)[names]
    except Exception:  # noqa: BLE001 - find the failing requests below
        pass
    parts, failed = [], {}

    def score(lo: int, hi: int) -> None:
        piece, message = requests.iloc[lo:hi].reset_index(drop=True), ""
        for _ in range(attempts if hi - lo == 1 else 1):
            try:
                parts.append(scorer(piece).assign(error=None)[names])
                return
            except Exception as e:  # noqa: BLE001 - a failed call is data
                message = f"{type(e).__name__}: {e}"
        if hi - lo == 1:
            failed[lo] = message
        else:
            halve(lo, hi)

    def halve(lo: int, hi: int) -> None:
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid, hi)):
            if b > a:
                score(a, b)

    halve(0, len(requests))
    if failed:
        parts.append(requests.iloc[list(failed)][REQUEST_KEY].assign(
            candidates=None, latency_ms=None, input_tokens=None, output_tokens=None, error=list(failed.values()))[names])
    return pd.concat([p.astype(object) for p in parts], ignore_index=True)


def score_batch(requests: DataFrame, scorer: ScorerFn = lexical_scorer, concurrency: int | None = None,
                attempts: int = 3, custom_text: str = "") -> DataFrame:
    """Score (transcript, objective, stance) requests with a user scorer via
    Arrow batches. The scorer gets the whole transcript and the system prompt of
    the request's objective and stance. ``concurrency`` bounds the number of
    scoring tasks (the reference's thread pool)."""
    if concurrency:
        requests = requests.repartition(concurrency, "request_id")
    prompts = system_prompts((*S.STANCES, CUSTOM_STANCE), custom_text)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield call_scorer(scorer, b.assign(system_prompt=[
                prompts.get(k, "") for k in zip(b["objective"], b["stance"])]), attempts)

    ship_package(requests.sparkSession)
    scored = requests.select(*REQUEST_KEY, "transcript").mapInPandas(run, SCORE_SCHEMA)
    return decode_top10(scored)


def expand_requests(turns: pd.DataFrame, stances: list[str], prompts: dict[tuple[str, str], str]) -> pd.DataFrame:
    """The (objective, stance) requests of scored turns: one row per stance."""
    req = turns.loc[turns.index.repeat(len(stances))].reset_index(drop=True)
    req["stance"] = stances * len(turns)
    req["objective"] = ["social_engineering" if t % 2 == 1 else "policy_violation" for t in req["turn_index"].tolist()]
    req["system_prompt"] = [prompts.get(k, "") for k in zip(req["objective"], req["stance"])]
    return req


def score_turns(transcripts: DataFrame, stances: tuple[str, ...] = S.STANCES, scorer: ScorerFn = lexical_scorer,
                concurrency: int | None = None, attempts: int = 3, custom_text: str = "") -> DataFrame:
    """D1 without the request join: one row per scored turn (turn ≥ 1) with its
    transcript crosses the Arrow boundary once; the (objective, stance)
    requests of that turn are expanded inside the batch, so a transcript is
    never copied per stance in the shuffle or the transfer."""
    t = transcripts.filter(F.col("turn_index") >= 1).select("request_id", "turn_index", "transcript")
    if concurrency:
        t = t.repartition(concurrency, "request_id")
    chosen, prompts = list(stances), system_prompts(stances, custom_text)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield call_scorer(scorer, expand_requests(b, chosen, prompts), attempts)

    ship_package(transcripts.sparkSession)
    return decode_top10(t.mapInPandas(run, SCORE_SCHEMA))
