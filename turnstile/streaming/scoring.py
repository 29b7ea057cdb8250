"""Structured Streaming jobs.

T1  live per-turn scoring: turns arrive as files; ``transformWithState`` keyed
    by conversation keeps each turn once and the next turn to speak
    (``state.TurnOrder``) and sends each turn's transcript on, which is scored
    in batches that span conversations. Each turn is emitted once, in order: duplicates of
    a turn are dropped, gaps wait in state until filled, for however long that
    takes, and a timer can report them.
T2  resumable detection: a file-source stream with a checkpoint; each
    micro-batch scores its new conversations (D1) and lands in a partition of
    its run and batch; a new run first scores again the conversations that
    still hold a failed call. The current result is the latest row per key
    (S11), so a replayed batch changes nothing.
T3  progressive run summary: state per conversation holds the last code of
    every call (``state.CallLedger``) and yields changes, so a call that is
    scored again counts once; a batch's changes are one written row, and the
    summary is their sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import detect as D
from ..session import ship_package
from .state import DELTAS, PIECE_CHARS, TURNS, CallLedger, TurnOrder, state_store

TURN_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("turn_index", T.LongType()),
    T.StructField("passage", T.StringType()),
])

OUT_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("turn_index", T.LongType()),
    T.StructField("objective", T.StringType()),
    T.StructField("stance", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("p_detected", T.DoubleType()),
    T.StructField("p_not_detected", T.DoubleType()),
    T.StructField("latency_ms", T.LongType()),
])

CUSTOM = D.CUSTOM_STANCE


def _run(query) -> None:
    """Wait for an availableNow query to consume its input."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def resolve_stances(stances: list[str] | None, custom_text: str = "") -> list[str]:
    """Chosen stances: none → the three presets; the custom stance is dropped
    when no custom text is given; unknown names are skipped."""
    chosen = list(stances) if stances else list(S.STANCES)
    if CUSTOM in chosen and not custom_text.strip():
        chosen = [s for s in chosen if s != CUSTOM]
    allowed = set(S.STANCES) | ({CUSTOM} if custom_text.strip() else set())
    return [s for s in chosen if s in allowed]


def live_events(turn_stream: DataFrame, stances: list[str] | None = None, custom_text: str = "",
                scorer=D.lexical_scorer, attempts: int = 3, gap_after_ms: int | None = None) -> DataFrame:
    """T1 before decoding: scored requests, and (stance null) reports of gaps
    that lasted ``gap_after_ms``. Start it within ``state.state_store``."""
    ship_package(turn_stream.sparkSession)
    chosen = resolve_stances(stances, custom_text)
    prompts, names = D.system_prompts(chosen, custom_text), [f.name for f in D.SCORE_SCHEMA.fields]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            missing = batch["error"].notna()
            if missing.any():
                yield batch[missing].reindex(columns=names).astype(object).where(lambda x: x.notna(), None)
            turns = batch.loc[~missing, ["request_id", "turn_index", "transcript"]]
            piece = turns["transcript"].str.len().cumsum() // PIECE_CHARS
            for _, part in turns.groupby(piece, sort=False):
                yield D.call_scorer(scorer, D.expand_requests(part.reset_index(drop=True), chosen, prompts), attempts)

    turns = turn_stream.groupBy("request_id").transformWithStateInPandas(
        TurnOrder(gap_after_ms), TURNS, "append", "None" if gap_after_ms is None else "ProcessingTime")
    return turns.mapInPandas(score, D.SCORE_SCHEMA)


def live_scoring(turn_stream: DataFrame, stances: list[str] | None = None, custom_text: str = "",
                 scorer=D.lexical_scorer, attempts: int = 3) -> DataFrame:
    """Streaming DataFrame of per-(turn, stance) scores, append mode. The
    processor only emits the scorer's candidates; P28 decodes them with the
    same expressions as the batch path."""
    scored = live_events(turn_stream, stances, custom_text, scorer, attempts)
    return D.decode_top10(scored).select(*[f.name for f in OUT_SCHEMA.fields])


def run_live_scoring(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                     stances: list[str] | None = None, max_files_per_trigger: int | None = None,
                     custom_text: str = "", scorer=D.lexical_scorer) -> DataFrame:
    """Run T1 over all files present (availableNow) into a Parquet sink; returns the sink."""
    reader = spark.readStream.schema(TURN_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    with state_store(spark):
        _run(live_scoring(reader.parquet(source_dir), stances, custom_text, scorer)
             .writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    return spark.read.schema(OUT_SCHEMA).parquet(out_dir)


# ---------------------------------------------------------------- T2
RESULT_KEY = D.REQUEST_KEY
RESULT_SCHEMA = T.StructType([*OUT_SCHEMA.fields, T.StructField("error", T.StringType()),
                              T.StructField("run", T.LongType()), T.StructField("epoch", T.LongType())])


def _results(spark: SparkSession, results_dir: str) -> DataFrame | None:
    """All written results, or None before the first."""
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(results_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def resumable_detection(spark: SparkSession, source_dir: str, results_dir: str, checkpoint: str,
                        max_files_per_trigger: int | None = None, scorer=D.lexical_scorer, attempts: int = 3) -> None:
    """Each new file batch of turns is scored (J7 ⋈ W3 → D1) and written to
    ``results_dir/run=<run>/epoch=<batch>``. A conversation is done when none of
    its calls failed; a new run scores the others again (epoch -1) before it
    reads new files. Conversations must arrive whole within one file (the
    store's unit)."""
    def write(turns: DataFrame, run: int, epoch: int) -> None:
        scored = D.score_turns(D.transcript_prefix(turns), scorer=scorer, attempts=attempts)
        (scored.select(*[f.name for f in OUT_SCHEMA.fields], "error")
         .write.mode("overwrite").parquet(f"{results_dir}/run={run}/epoch={epoch}"))

    before, run = _results(spark, results_dir), 0
    if before is not None:
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        failed = current_results(spark, results_dir).filter("prediction = 'X'").select("request_id").distinct()
        if failed.take(1):
            turns = spark.read.schema(TURN_SCHEMA).parquet(source_dir)
            write(turns.join(failed, "request_id", "left_semi"), run, -1)
    reader = spark.readStream.schema(TURN_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    _run(reader.parquet(source_dir).writeStream.foreachBatch(lambda batch, epoch: write(batch, run, epoch))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_results(spark: SparkSession, results_dir: str) -> DataFrame:
    """S11 view over the runs: the latest row per key (aggregation, so a hot key
    is reduced map-side)."""
    r = spark.read.schema(RESULT_SCHEMA).parquet(results_dir)
    rest = [c for c in r.columns if c not in RESULT_KEY and c not in ("run", "epoch")]
    return (r.groupBy(*RESULT_KEY).agg(F.max_by(F.struct(*rest), F.struct("run", "epoch")).alias("x"))
            .select(*RESULT_KEY, "x.*"))


# ---------------------------------------------------------------- T3
def summary_changes(results: DataFrame) -> DataFrame:
    """Changes of the run summary as results land (``RESULT_SCHEMA``), one
    row per changed conversation and batch. Start it within ``state.state_store``."""
    ship_package(results.sparkSession)
    rows = results.select(*RESULT_KEY, "prediction", "run", "epoch").where(F.col("prediction").isNotNull())
    return rows.groupBy("request_id").transformWithState(CallLedger(), DELTAS, "update", "None")


def run_summary_stream(spark: SparkSession, results_dir: str, checkpoint: str, out_dir: str,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Run T3 over the results of T2 (``results_dir/run=…/epoch=…``) or any
    table with ``RESULT_SCHEMA``: conversations by status, calls, and calls by
    code, of those scored so far. Every batch writes its changes as one row
    under its number, so a replayed batch replaces itself; a later call takes up
    the new files. Returns the sum."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in batch.columns]) \
            .write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")

    reader = spark.readStream.schema(RESULT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    with state_store(spark):
        _run(summary_changes(reader.parquet(results_dir)).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    names = [d.split()[0] for d in DELTAS.split(", ")]
    return spark.read.schema(DELTAS).parquet(out_dir).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
