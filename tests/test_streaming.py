"""The stream result equals the batch (D1) result, including
split arrivals, a reversed file, a duplicate file and a gap filled later."""

import tempfile
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from turnstile.operators import detect as D
from turnstile.plans.model import model
from turnstile.streaming import scoring as ST
from turnstile.streaming.state import state_store

COLS = ["request_id", "turn_index", "objective", "stance", "prediction", "p_detected", "p_not_detected",
        "latency_ms"]


def _rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.select(*COLS).collect())


@pytest.fixture(scope="module")
def turns(spark):
    return model(spark, SF001).domain.text_turns.select("request_id", "turn_index", "passage").cache()


@pytest.fixture(scope="module")
def batch(spark, turns):
    t = turns.withColumn("speaker", F.when(F.col("turn_index") % 2 == 1, "caller").otherwise("representative"))
    req = D.detector_requests(t, D.stance_dim(spark))
    tx = D.transcript_prefix(t)
    return _rows(D.score_batch(req.join(tx, ["request_id", "turn_index"])))


def _run(spark, writes):
    d = tempfile.mkdtemp(prefix="stream-")
    for i, df in enumerate(writes):
        df.coalesce(1).write.mode("append").parquet(f"{d}/src")
    return ST.run_live_scoring(spark, f"{d}/src", f"{d}/out", f"{d}/ck", max_files_per_trigger=1)


def test_stream_equals_batch_split_arrivals(spark, turns, batch):
    out = _run(spark, [turns.filter("turn_index < 3"), turns.filter("turn_index >= 3")])
    assert _rows(out) == batch


def test_reversed_duplicate_and_gap(spark, turns, batch):
    late = turns.filter("turn_index >= 2").orderBy(F.col("turn_index").desc())   # reversed, with a gap at 1
    early = turns.filter("turn_index < 2")
    out = _run(spark, [turns.filter("turn_index = 0"), late, early, early])     # gap filled later + duplicate
    assert _rows(out) == batch


def test_resumable_detection_is_idempotent(spark, turns, batch):
    d = tempfile.mkdtemp(prefix="resume-")
    turns.repartition(3, "request_id").write.parquet(f"{d}/src")
    ST.resumable_detection(spark, f"{d}/src", f"{d}/out", f"{d}/ck", max_files_per_trigger=1)
    ST.resumable_detection(spark, f"{d}/src", f"{d}/out", f"{d}/ck")    # resume: nothing new
    assert _rows(ST.current_results(spark, f"{d}/out")) == batch


def test_summary_takes_back_retried_calls(spark, turns, batch, tmp_path):
    turns.repartition(3, "request_id").write.parquet(f"{tmp_path}/src")
    ids = sorted({r[0] for r in batch})
    last = {i: max(r[1] for r in batch if r[0] == i) for i in ids}
    bad, half = ids[0], next(i for i in ids[1:] if last[i] > 1)

    def shaky(b):
        if (b["request_id"] == bad).any() or ((b["request_id"] == half) & (b["turn_index"] == last[half])).any():
            raise TimeoutError("late")
        return D.lexical_scorer(b)

    def summary():
        total = ST.run_summary_stream(spark, f"{tmp_path}/out", f"{tmp_path}/ck", f"{tmp_path}/sum", 1).first().asDict()
        det = ST.current_results(spark, f"{tmp_path}/out").withColumnRenamed("prediction", "code")
        planned = det.select("request_id").distinct()
        truth = D.run_summary(planned, det, D.run_status(det, planned)).first().asDict()
        assert total == {k: v for k, v in truth.items() if k != "n_planned"}
        return total
    ST.resumable_detection(spark, f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck-run", scorer=shaky, attempts=1)
    first = summary()
    assert (first["n_error"], first["n_partial"], first["n_calls"]) == (1, 1, len(batch)) and first["n_x"] > 3
    ST.resumable_detection(spark, f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck-run")
    second = summary()
    assert (second["n_success"], second["n_x"], second["n_calls"]) == (len(ids), 0, len(batch))
    assert summary() == second


def test_live_scoring_reports_a_lasting_gap(spark, tmp_path):
    def arrive(*rows):
        spark.createDataFrame(rows, ST.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")

    def run(done):
        """A running query, stopped when its output is there (timers keep it alive)."""
        events = ST.live_events(spark.readStream.schema(ST.TURN_SCHEMA).parquet(f"{tmp_path}/src"), ["balanced"], gap_after_ms=1)
        with state_store(spark):
            q = (events.writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="200 milliseconds").start())
        try:
            for _ in range(120):
                time.sleep(0.5)
                out = spark.read.schema(D.SCORE_SCHEMA).parquet(f"{tmp_path}/out").collect() if q.lastProgress else []
                if done(out) or not q.isActive:
                    break
        finally:
            q.stop()
        return out
    arrive(("a", 0, "x"), ("a", 1, "y"), ("a", 3, "z"), ("b", 0, "x"), ("b", 1, "y"))
    out = run(lambda rows: any(r.stance is None for r in rows))
    assert {(r.request_id, r.turn_index, r.error) for r in out if r.stance is None} == {("a", 2, "turn 2 is missing")}
    arrive(("a", 2, "late"))
    out = run(lambda rows: sum(r.stance is not None for r in rows) == 4)
    assert sorted((r.request_id, r.turn_index) for r in out if r.stance is not None) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_a_long_conversation_writes_only_its_new_turns(spark, tmp_path):
    n = 5000

    def last_words(b):
        out = D.lexical_scorer(b.assign(transcript=b["transcript"].str[-20:]))
        out["input_tokens"] = b["transcript"].str.len()
        return out
    rows = [("long", t, f"passage {t}") for t in range(n)]
    lengths = []
    for i, part in enumerate((rows[:n - 10], rows[n - 10:])):
        spark.createDataFrame(part, ST.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        events = ST.live_events(spark.readStream.schema(ST.TURN_SCHEMA).parquet(f"{tmp_path}/src"), ["balanced"], scorer=last_words)
        with state_store(spark):
            q = (events.select("turn_index", "input_tokens").writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
            q.awaitTermination()
        progress = [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.stateOperators]
        lengths.append(max(progress))
    got = {r.turn_index: r.input_tokens for r in spark.read.schema("turn_index long, input_tokens long").parquet(f"{tmp_path}/out").collect()}
    assert len(got) == n - 1
    lines = [len(f"{'Caller' if t % 2 else 'Representative'}: passage {t}") for t in range(n)]
    assert all(got[t] == sum(lines[:t + 1]) + 2 * t for t in (1, 77, n - 11, n - 1))
    assert lengths[0] >= n - 10 and lengths[1] < 20      # the second batch writes ten turns and the offset


def test_stance_resolution():
    assert ST.resolve_stances(None) == ["high_precision", "balanced", "high_recall"]
    assert ST.resolve_stances(["__custom__", "balanced"]) == ["balanced"]
    assert ST.resolve_stances(["__custom__"], "be strict") == ["__custom__"]
    assert ST.resolve_stances(["made_up", "balanced"]) == ["balanced"]


def test_decode_rules(spark):
    df = spark.createDataFrame([
        (1, [("maybe", -0.1), ("N", -1.0), ("Y", -0.5)]),
        (2, [("Yes", -0.1), ("No", -0.2)]),
        (3, None),
        (4, [("N", -0.3), ("Y", -0.3)]),        # tie: input order wins
    ], "id int, candidates array<struct<token:string, logprob:double>>")
    got = {r.id: (r.prediction, r.p_detected, r.p_not_detected) for r in D.decode_top10(df).collect()}
    assert got[1] == ("Y", 0.607, 0.368)
    assert got[2] == ("E", 0.0, 0.0)
    assert got[3] == ("X", None, None)
    assert got[4][0] == "N"


def test_one_failing_call_is_one_x_with_its_message(spark):
    def scorer(b):
        if (b["transcript"].str.contains("boom") & (b["stance"] == "balanced")).any():
            raise ValueError("no answer")
        return D.lexical_scorer(b)
    df = spark.createDataFrame([("a", 1, "Caller: fine"), ("b", 1, "Caller: boom")], "request_id string, turn_index long, transcript string")
    got = {(r.request_id, r.stance): (r.prediction, r.error) for r in D.score_turns(df, scorer=scorer).collect()}
    assert got["b", "balanced"] == ("X", "ValueError: no answer")
    assert len(got) == 6 and sum(p == "X" for p, _ in got.values()) == 1


def test_failing_requests_are_found_by_halves():
    sizes = []

    def scorer(b):
        sizes.append(len(b))
        if b["request_id"].isin(["c300", "c301"]).any():
            raise ValueError("no answer")
        return D.lexical_scorer(b)
    requests = pd.DataFrame([(f"c{i}", 1, "Caller: fine", "social_engineering", "balanced") for i in range(1000)],
                            columns=["request_id", "turn_index", "transcript", "objective", "stance"])
    got = D.call_scorer(scorer, requests, attempts=2)
    assert len(sizes) < 50 and sum(n == 1 for n in sizes) <= 6
    assert set(got["request_id"]) == set(requests["request_id"]) and len(got) == 1000
    failed = got[got["candidates"].isna()]
    assert sorted(failed["request_id"]) == ["c300", "c301"] and set(failed["error"]) == {"ValueError: no answer"}


def test_live_scoring_calls_the_scorer_on_many_conversations(spark, tmp_path):
    rows = [(f"c{i}", t, f"passage {t}") for i in range(200) for t in range(3)]
    spark.createDataFrame(rows, ST.TURN_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/src")

    def scorer(b):
        return D.lexical_scorer(b).assign(output_tokens=b["request_id"].nunique())
    events = ST.live_events(spark.readStream.schema(ST.TURN_SCHEMA).parquet(f"{tmp_path}/src"), ["balanced"], scorer=scorer)
    with state_store(spark):
        events.select("output_tokens").writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = [r.output_tokens for r in spark.read.schema("output_tokens long").parquet(f"{tmp_path}/out").collect()]
    assert len(got) == 400 and min(got) > 1


def test_ledger_writes_the_calls_of_near_turns_together(spark, tmp_path):
    def land(run, turns, code):
        rows = [("a", t, "o", s, code, 0.5, 0.5, 1, None) for t in turns for s in "xyz"]
        spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ST.RESULT_SCHEMA[:9])) \
            .coalesce(1).write.parquet(f"{tmp_path}/out/run={run}/epoch=0")

    def totals():
        with state_store(spark):
            q = (ST.summary_changes(spark.readStream.schema(ST.RESULT_SCHEMA).parquet(f"{tmp_path}/out")).writeStream
                 .outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect()))
                 .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
            q.awaitTermination()
        return max(p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.stateOperators)
    seen = []
    land(0, range(1, 41), "X")
    assert totals() < 10                                   # 120 calls of 40 turns, and the counts
    land(1, range(20, 41), "Y")
    totals()
    total = {c: sum(r[c] for r in seen) for c in ("n_calls", "n_x", "n_y", "n_error", "n_partial")}
    assert total == {"n_calls": 120, "n_x": 57, "n_y": 63, "n_error": 0, "n_partial": 1}


def test_scorer_gets_prompt_custom_text_and_whole_transcript(spark, tmp_path):
    def scorer(b):
        out = D.lexical_scorer(b)
        out["candidates"] = [[("Y" if "be strict" in p and "urgent" in t else "N", -0.1)]
                             for p, t in zip(b["system_prompt"], b["transcript"])]
        return out
    rows = [("a", 0, "urgent matter"), ("a", 1, "hello"), ("a", 2, "bye")]
    spark.createDataFrame(rows, ST.TURN_SCHEMA).write.parquet(f"{tmp_path}/src")
    got = ST.run_live_scoring(spark, f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck", ["__custom__", "balanced"],
                              custom_text="be strict", scorer=scorer).collect()
    assert {(r.turn_index, r.stance, r.prediction) for r in got} == {
        (1, "__custom__", "Y"), (2, "__custom__", "Y"), (1, "balanced", "N"), (2, "balanced", "N")}


def test_scorer_reads_text_before_blank_lines(spark):
    df = spark.createDataFrame([("a", 1, "Caller: urgent urgent\n\nurgent"), ("b", 1, "Caller: x x\n\nx")],
                               "request_id string, turn_index long, transcript string")
    got = {r.request_id: r.p_detected for r in D.score_turns(df, stances=("balanced",)).collect()}
    assert got["a"] > 0.9 and got["b"] < 0.1


def test_failed_conversations_are_scored_again(spark, turns, batch, tmp_path):
    turns.repartition(2, "request_id").write.parquet(f"{tmp_path}/src")
    bad = turns.select("request_id").distinct().orderBy("request_id").first()[0]

    def broken(b):
        if (b["request_id"] == bad).any():
            raise TimeoutError("late")
        return D.lexical_scorer(b)
    ST.resumable_detection(spark, f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck", scorer=broken, attempts=1)
    first = ST.current_results(spark, f"{tmp_path}/out")
    assert {r.request_id for r in first.filter("prediction = 'X'").collect()} == {bad}
    ST.resumable_detection(spark, f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ck")
    assert _rows(ST.current_results(spark, f"{tmp_path}/out")) == batch
