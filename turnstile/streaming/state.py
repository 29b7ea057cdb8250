"""Stateful processors of the streaming jobs (T1, T3), kept in RocksDB state.

Each keeps its state in parts, so that a batch writes only what it changes: a
turn, a call's code, a counter; never a conversation's whole history.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PIECE_CHARS = 1 << 22          # characters of transcripts held at once
#: What T1 sends on: a turn with its transcript, or the report of a missing turn.
TURNS = "request_id string, turn_index long, transcript string, error string"
TURN_COLUMNS = [c.split()[0] for c in TURNS.split(", ")]


@contextmanager
def state_store(spark: SparkSession):
    """RocksDB state for the queries started within; the session's own setting
    is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class TurnOrder(StatefulProcessor):
    """One conversation. Map state holds each turn's passage once, value
    state the next turn to speak. Turns leave in order, each once, with the
    transcript up to them; a turn that is ahead waits in the map, and
    duplicates are dropped. With
    ``gap_after_ms`` a timer starts when turns wait behind a missing one, and
    its end yields a row without transcript that names the missing turn; the
    conversation goes on when that turn comes, however late."""

    def __init__(self, gap_after_ms: int | None = None):
        self.gap_after_ms = gap_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "passage string")
        self.offset = handle.getValueState("offset", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.offset.get()[0] if self.offset.exists() else 0
        known = {k[0]: v[0] for k, v in self.turns.iterator()}
        for batch in rows:
            for t, p in zip(batch["turn_index"].tolist(), batch["passage"].tolist()):
                t = int(t)
                if t >= 0 and t not in known:
                    known[t] = "" if p is None else p
                    self.turns.updateValue((t,), (known[t],))
        upto = start
        while upto in known:
            upto += 1
        if upto > start:
            self.offset.update((upto,))
        self._watch(any(t >= upto for t in known), timerValues)
        if upto > start:
            yield from self._transcripts(key[0], known, start, upto)

    def _transcripts(self, request_id: str, known: dict[int, str], start: int, upto: int) -> Iterator[pd.DataFrame]:
        lines = [f"{'Caller' if t % 2 else 'Representative'}: {known[t]}" for t in range(upto)]
        text, held, size = "\n\n".join(lines[:start]), [], 0
        for t in range(start, upto):
            text = text + "\n\n" + lines[t] if t else lines[t]
            if t:
                held.append((request_id, t, text, None))
                size += len(text)
            if held and (size > PIECE_CHARS or t == upto - 1):       # a bounded number of characters at once
                yield pd.DataFrame(held, columns=TURN_COLUMNS)
                held, size = [], 0

    def _watch(self, waiting: bool, timerValues) -> None:
        if self.gap_after_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_after_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        missing = self.offset.get()[0] if self.offset.exists() else 0
        yield pd.DataFrame([(key[0], missing, None, f"turn {missing} is missing")], columns=TURN_COLUMNS)

    def close(self) -> None:
        pass


BLOCK = 16                     # turns whose calls are kept together
CODES = ("Y", "N", "E", "X")
#: Changes of the run summary: calls by code, conversations by status.
DELTAS = ", ".join(f"{c} long" for c in ("n_success", "n_partial", "n_error", "n_calls",
                                         *(f"n_{c.lower()}" for c in CODES)))


def status_of(calls: int, failed: int) -> str:
    return "success" if not failed else "error" if failed == calls else "partial"


class CallLedger(StatefulProcessor):
    """One conversation. Map state holds, by blocks of ``BLOCK`` turns, the
    last code of each call with the run and batch it came from, value state the
    counts of calls and failures; a batch reads and writes the blocks it changes.
    Yields the change of the summary: a call scored again takes its old code
    back, and its conversation's old status; older results change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "block long", "calls array<struct<turn: long, objective: string, "
                                        "stance: string, code: string, run: long, epoch: long>>")
        self.counts = handle.getValueState("counts", "calls long, failed long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict[int, dict[tuple, tuple]] = {}
        for r in rows:
            call, entry = (r.turn_index, r.objective, r.stance), (r.prediction, r.run, r.epoch)
            block = newest.setdefault(r.turn_index // BLOCK, {})
            if call not in block or entry[1:] > block[call][1:]:
                block[call] = entry
        seen = self.counts.exists()
        calls, failed = self.counts.get() if seen else (0, 0)
        change = dict.fromkeys([d.split()[0] for d in DELTAS.split(", ")], 0)
        if seen:
            change[f"n_{status_of(calls, failed)}"] -= 1
        for number, block in newest.items():
            before = self.calls.getValue((number,)) if seen else None
            held = {tuple(c[:3]): tuple(c[3:]) for c in before[0]} if before is not None else {}
            newer = {c: e for c, e in block.items() if c not in held or held[c][1:] < e[1:]}
            for call, entry in newer.items():
                if call in held:
                    old = held[call][0]
                    change[f"n_{old.lower()}"] -= 1
                    change["n_calls"] -= 1
                    calls, failed = calls - 1, failed - (old == "X")
                change[f"n_{entry[0].lower()}"] += 1
                change["n_calls"] += 1
                calls, failed = calls + 1, failed + (entry[0] == "X")
            if newer:
                self.calls.updateValue((number,), ([(*c, *e) for c, e in (held | newer).items()],))
        self.counts.update((calls, failed))
        change[f"n_{status_of(calls, failed)}"] += 1
        if any(change.values()):
            yield Row(**change)

    def close(self) -> None:
        pass
