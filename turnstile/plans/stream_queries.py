"""Streaming catalogue: the streams' results equal the batch scorer's, so they
share its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..session import scratch_path
from ..streaming import scoring as ST
from .explore_queries import SCORE_SQL
from .model import model
from .registry import query


def _turn_files(spark, sf, split_at: int = 3) -> str:
    """The conversations' turns as a file source in two arrivals: turns below
    ``split_at`` first, the rest later (so state carries across batches)."""
    t = model(spark, sf).domain.text_turns.select("request_id", "turn_index", "passage")
    src = scratch_path(spark, "turn_files")
    t.filter(F.col("turn_index") < split_at).write.parquet(src)
    t.filter(F.col("turn_index") >= split_at).write.mode("append").parquet(src)
    return src


@query("stream_scoring", SCORE_SQL)
def stream_scoring(spark, sf):
    src = _turn_files(spark, sf)
    return ST.run_live_scoring(spark, src, scratch_path(spark, "live_out"),
                               scratch_path(spark, "live_ckpt"), max_files_per_trigger=4)


@query("stream_resume", SCORE_SQL)
def stream_resume(spark, sf):
    t = model(spark, sf).domain.text_turns.select("request_id", "turn_index", "passage")
    src = scratch_path(spark, "resume_src")
    # whole conversations per file: the store's unit of arrival
    t.repartition(4, "request_id").write.parquet(src)
    out = scratch_path(spark, "resume_out")
    ST.resumable_detection(spark, src, out, scratch_path(spark, "resume_ckpt"), max_files_per_trigger=2)
    return ST.current_results(spark, out).drop("error")


@query("stream_summary", f"""
WITH r AS ({SCORE_SQL})
SELECT (SELECT count(DISTINCT request_id) FROM r) AS n_success, CAST(0 AS BIGINT) AS n_partial,
  CAST(0 AS BIGINT) AS n_error, count(*) AS n_calls, count(*) FILTER (WHERE prediction = 'Y') AS n_y,
  count(*) FILTER (WHERE prediction = 'N') AS n_n, CAST(0 AS BIGINT) AS n_e, CAST(0 AS BIGINT) AS n_x FROM r""")
def stream_summary(spark, sf):
    """T3 over a run of T2 whose scorer fails for some conversations, and the
    run that scores them again: every call counts once."""
    t = model(spark, sf).domain.text_turns.select("request_id", "turn_index", "passage")
    src, out = scratch_path(spark, "summary_src"), scratch_path(spark, "summary_results")
    t.repartition(4, "request_id").write.parquet(src)
    ck, sums, scored = (scratch_path(spark, n) for n in ("summary_ckpt", "summary_out", "summary_scored"))
    for scorer in (_shaky, D.lexical_scorer):
        ST.resumable_detection(spark, src, out, scored, scorer=scorer, attempts=1)
        total = ST.run_summary_stream(spark, out, ck, sums)
    return total


def _shaky(requests):
    """Fails on conversations whose id ends in 7."""
    if requests["request_id"].str.endswith("7").any():
        raise TimeoutError("no answer")
    return D.lexical_scorer(requests)
