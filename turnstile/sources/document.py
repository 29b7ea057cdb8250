"""Splittable reader of keyed JSON documents.

A store may be one JSON document of any size: ``{"conversations": {id: record}}``,
a bare map ``{id: record}``, or a list of records. Nothing in such a file marks
where a split could start, so the document is read as text split at ``}`` (Spark's
own line reader deals byte ranges to tasks), and the state at the start of every
split is found first:

1. Each split is scanned for quotes and brackets under both assumptions, that it
   starts inside a string or outside, which gives a small summary: change of
   depth, lowest depth, string state at the end, where the record container
   opens.
2. The summaries of a file, one row a split, are composed in order; now every
   split's start is known.
3. Splits are scanned again and cut into members of the container. A member that
   crosses splits leaves one piece in each, and the pieces are joined.

Every member carries its byte position in the file, the order in which updates
count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package

SEPARATOR = "}"
_CONTAINER = re.compile(rb'"conversations"\s*:\s*(.)', re.DOTALL)
_OPEN, _CLOSE = (123, 91), (125, 93)
_SPLIT = ["file", "block", "length"]


class StoreError(ValueError):
    """A document that is not a conversation store."""


# ------------------------------------------------------------------ scanning
def string_marks(raw: np.ndarray) -> np.ndarray:
    """Positions of the quotes that open or close a string. A quote after an odd
    run of backslashes is part of its string; a chunk never starts amid a run,
    since the byte before it is the separator."""
    quotes = np.flatnonzero(raw == 34)
    slash = raw == 92
    if not len(quotes) or not slash.any():
        return quotes
    plain = np.flatnonzero(~slash)
    before = np.searchsorted(plain, quotes) - 1              # last byte before the quote that is no backslash
    last = np.where(before >= 0, plain[np.maximum(before, 0)], -1)
    return quotes[(quotes - 1 - last) % 2 == 0]


def brackets(raw: np.ndarray, marks: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions outside strings of brackets and commas, and the change of depth
    at each (0 for a comma)."""
    at = np.flatnonzero((raw == 123) | (raw == 125) | (raw == 91) | (raw == 93) | (raw == 44))
    outside = (np.searchsorted(marks, at) % 2 == 1) == inside
    at = at[outside]
    kind = raw[at]
    return at, np.where(kind == 44, 0, np.where((kind == 123) | (kind == 91), 1, -1))


class _Guess:
    """Summary of a split under one assumption on its start."""

    def __init__(self, inside: bool):
        self.inside = inside                                 # state at the end of what was seen
        self.delta = self.low = 0
        self.found = self.pos = self.opener = self.low_after = None

    def feed(self, data: bytes, raw: np.ndarray, marks: np.ndarray, base: int) -> None:
        at, change = brackets(raw, marks, self.inside)
        depth = self.delta + np.cumsum(change)
        if len(depth):
            self.low = min(self.low, int(depth.min()))
            if self.found is not None:
                self.low_after = min(self.low_after, int(depth.min()))
        for m in _CONTAINER.finditer(data):
            n = int(np.searchsorted(marks, m.start()))
            if n == len(marks) or marks[n] != m.start() or (n % 2 == 1) != self.inside:
                continue                                     # within a string
            k = int(np.searchsorted(at, m.start()))
            here = int(depth[k - 1]) if k else self.delta
            if self.found is None or here < self.found:
                opens = m.start(1)
                after = depth[int(np.searchsorted(at, opens)):]
                self.found, self.pos, self.opener = here, base + opens, data[opens]
                self.low_after = int(after.min()) if len(after) else here
        if len(depth):
            self.delta = int(depth[-1])
        self.inside = self.inside != (len(marks) % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes]]:
    """Bytes of each split in a batch, in order, separators put back."""
    files = batch.column("file").dictionary_encode()
    key = np.stack([files.indices.to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)])
    cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        text = batch.column("value").slice(a, b - a).cast(pa.binary()).to_pylist()
        row = tuple(batch.column(c)[a].as_py() for c in (*_SPLIT, "size"))
        yield row, SEPARATOR.encode().join(text) + SEPARATOR.encode()


_SUMMARY = ("file string, block long, length long, size long, n_bytes long, first int, "
            + ", ".join(f"inside{s} boolean, delta{s} long, low{s} long, found{s} long, pos{s} long, opener{s} int, "
                        f"low_after{s} long" for s in (0, 1)))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _SUMMARY.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [types[f.split()[1]] for f in _SUMMARY.split(", ")]

    def row() -> pa.RecordBatch:
        values = [*split, n, first]
        for g in guesses:
            values += [g.inside, g.delta, g.low, g.found, g.pos, g.opener, g.low_after]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, fields)], names)

    split = None
    for batch in batches:
        for key, data in _runs(batch):
            if key != split:
                if split is not None:
                    yield row()
                split, guesses, n, first = key, (_Guess(False), _Guess(True)), 0, None
            raw = np.frombuffer(data, np.uint8)
            marks = string_marks(raw)
            for g in guesses:
                g.feed(data, raw, marks, n)
            if first is None and (head := data.lstrip()):
                first = head[0]
            n += len(data)
    if split is not None:
        yield row()


_START = ("file string, block long, length long, base long, inside boolean, depth long, level long, state int, "
          "opens long, is_list boolean, error string")


def _compose(rows: pd.DataFrame, strict: bool) -> pd.DataFrame:
    """Starts of one file's splits from their summaries, in order."""
    rows = rows.sort_values("block")
    inside, depth, base = False, 0, 0
    root = next((int(f) for f in rows["first"] if not pd.isna(f)), 0)
    starts, wrapped = [], None
    for r in rows.to_dict("records"):
        g = {k: r[f"{k}{int(inside)}"] for k in ("inside", "delta", "low", "found", "pos", "opener", "low_after")}
        here = not pd.isna(g["found"]) and depth + int(g["found"]) == 1 and wrapped is None and root == 123
        starts.append([r["file"], r["block"], r["length"], base, inside, depth, int(r["low0" if not inside else "low1"]), g, here])
        if here:
            wrapped = int(g["opener"])
        inside, depth, base = bool(g["inside"]), depth + int(g["delta"]), base + int(r["n_bytes"])
    error = None
    size = int(rows["size"].iloc[0])
    # the last chunk has a separator put back which the file may not have
    if inside or depth not in {size: (0,), size + 1: (-1,)}.get(base, (0, -1)):
        error = "not a whole JSON document"
    elif root not in _OPEN:
        error = "neither a map nor a list"
    elif wrapped is not None and wrapped not in _OPEN:
        error = "'conversations' is neither a map nor a list"
    elif wrapped is None and strict:
        error = "store has no 'conversations' key"
    level = 2 if wrapped is not None else 1
    is_list = (wrapped if wrapped is not None else root) == 91
    state, out = 0, []
    for file, block, length, at, was, d, low, g, here in starts:
        opens = -1
        begin = state
        if state == 0:
            if wrapped is None:
                opens, state = -2, 1                         # at the file's first bracket
            elif here:
                opens, state = int(g["pos"]), 1
                if d + int(g["low_after"]) < level:
                    state = 2
        if begin == 1 and d + low < level:
            state = 2
        out.append((file, block, length, at, was, d, level, begin, opens, is_list, error))
    return pd.DataFrame(out, columns=[f.split()[0] for f in _START.split(", ")])


_PIECE = "file string, position long, opens boolean, closes boolean, is_list boolean, text string"


class _Cutter:
    """Cuts one split into members of the container, batch by batch."""

    def __init__(self, start: dict):
        self.s = start
        self.inside, self.depth, self.n = start["inside"], start["depth"], 0
        self.on = start["state"] == 1                        # within the container
        self.done = start["state"] == 2
        self.held: list[bytes] = []
        self.begin, self.cut = start["base"], False          # piece in hand: its position, and whether it starts a member

    def feed(self, data: bytes) -> Iterator[tuple]:
        raw = np.frombuffer(data, np.uint8)
        marks = string_marks(raw)
        at, change = brackets(raw, marks, self.inside)
        depth = self.depth + np.cumsum(change)
        level, a = self.s["level"], 0
        if not self.done:
            k = 0
            if not self.on and self.s["opens"] != -1:
                k = self._opening(at, change)
                if k:
                    a = int(at[k - 1]) + 1
                    self.on, self.begin, self.cut = True, self.s["base"] + self.n + a, True
            if self.on:
                rest, ranks = depth[k:], np.arange(k, len(at))
                ends = ranks[rest < level]
                stop = int(ends[0]) if len(ends) else None
                commas = ranks[(rest == level) & (change[k:] == 0)]
                if stop is not None:
                    commas = commas[commas < stop]
                for p in at[commas].tolist() + ([int(at[stop])] if stop is not None else []):
                    yield self._piece(data[a:p], True)
                    a = p + 1
                    self.begin, self.cut = self.s["base"] + self.n + a, True
                if stop is not None:
                    self.on, self.done = False, True
                else:
                    self.held.append(data[a:])
        if len(depth):
            self.depth = int(depth[-1])
        self.inside = self.inside != (len(marks) % 2 == 1)
        self.n += len(data)

    def _opening(self, at: np.ndarray, change: np.ndarray) -> int:
        """Number of brackets up to and with the one that opens the container; 0
        if it is not in this batch."""
        if self.s["opens"] == -2:
            first = np.flatnonzero(change == 1)
            return int(first[0]) + 1 if len(first) and self.depth == 0 else 0
        k = int(np.searchsorted(at, self.s["opens"] - self.n))
        return k + 1 if k < len(at) and at[k] == self.s["opens"] - self.n else 0

    def _piece(self, tail: bytes, closes: bool) -> tuple:
        text = b"".join([*self.held, tail])
        self.held = []
        return self.s["file"], self.begin, self.cut, closes, self.s["is_list"], text

    def end(self) -> Iterator[tuple]:
        if self.on:
            yield self._piece(b"", False)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PIECE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
    start_names = [f.split()[0] for f in _START.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], names)

    key, cutter = None, None
    for batch in batches:
        rows: list[tuple] = []
        at = 0
        for split, data in _runs(batch):
            if split != key:
                if cutter is not None:
                    rows += cutter.end()
                start = {c: batch.column(c)[at].as_py() for c in start_names}
                key, cutter = split, _Cutter(start)
            rows += cutter.feed(data)
            at += _rows_of(batch, at)
        if rows:
            yield emit(rows)
    if cutter is not None and (rows := list(cutter.end())):
        yield emit(rows)


def _rows_of(batch: pa.RecordBatch, at: int) -> int:
    """Rows of the split that starts at row ``at``."""
    block = batch.column("block").to_numpy(zero_copy_only=False)[at:]
    files = batch.column("file").slice(at).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    other = np.flatnonzero((block != block[0]) | (files != files[0]))
    return int(other[0]) if len(other) else len(block)


# ------------------------------------------------------------------ the reader
def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_members(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """``(file, position, is_list, text)``: every member of the documents'
    record containers as JSON text, ``"id": record`` of a map or ``record`` of a
    list, with its byte position.

    ``strict`` asks for the ``conversations`` key; otherwise a document without
    it is itself the map or list of records. A document that is cut off, or is
    neither, raises ``StoreError`` before any member is read. Other keys beside
    ``conversations``, at any depth, are passed over. Members of equal ids all
    come out, in order of position."""
    ship_package(spark)
    chunks = spark.read.option("lineSep", SEPARATOR).text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"))
    # one small row a split; a file's splits are composed in order
    starts = written(chunks.mapInArrow(_summaries, _SUMMARY).groupBy("file").applyInPandas(
        lambda rows: _compose(rows, strict), _START), "document-starts")
    bad = starts.where(F.col("error").isNotNull()).select("file", "error").distinct().limit(3).collect()
    if bad:
        raise StoreError("; ".join(f"{r.error}: {r.file}" for r in bad))
    # as many rows as the scan has splits, which the driver lists anyway
    known = F.broadcast(starts.withColumnsRenamed({c: f"_{c}" for c in _SPLIT}))
    placed = chunks.join(known, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
                         & (F.col("length") == F.col("_length")), "left")
    checked = F.when(F.col("_file").isNull(), F.raise_error(F.lit("splits changed between two scans"))).otherwise(
        F.col("base")).alias("base")
    placed = placed.select("value", *_SPLIT, "size", checked, "inside", "depth", "level", "state", "opens", "is_list",
                           "error")
    pieces = written(placed.mapInArrow(_members, _PIECE), "document-pieces")
    whole = pieces.where("opens and closes").select("file", "position", "is_list", "text")
    return whole.unionByName(_joined(pieces.where("not (opens and closes)"))).where(F.col("text").rlike(r"\S"))


def _joined(parts: DataFrame) -> DataFrame:
    """Members that cross splits: at most two pieces a split are put together."""
    order = Window.partitionBy("file").orderBy("position")
    owners = parts.select("file", "position", "opens").withColumn(
        "_owner", F.last(F.when(F.col("opens"), F.col("position")), ignorenulls=True).over(order)).drop("opens")
    return parts.join(owners, ["file", "position"]).groupBy("file", "_owner", "is_list").agg(
        F.array_sort(F.collect_list(F.struct("position", "text"))).alias("p")).select(
        "file", F.col("_owner").alias("position"), "is_list",
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def parse_members(members: DataFrame, record: T.StructType) -> DataFrame:
    """``(file, position, key, r)``: members parsed with the record schema; the
    key of a list's member is null. Text that is no JSON raises."""
    kind = T.MapType(T.StringType(), record)
    as_map = F.from_json(F.concat(F.lit("{"), F.when(F.col("is_list"), F.lit('"":')).otherwise(F.lit("")),
                                  F.col("text"), F.lit("}")), kind)
    # outer: no filter on the parsed map is derived, which could run ahead of others
    rows = members.select("file", "position", "is_list", F.explode_outer(as_map).alias("key", "r"))
    broken = F.raise_error(F.concat(F.lit("malformed record in "), F.col("file"), F.lit(" at byte "),
                                    F.col("position").cast("string")))
    return rows.select("file", "position", F.when(~F.col("is_list"), F.col("key")).alias("key"),
                       F.when(F.col("key").isNull(), broken).otherwise(F.col("r")).alias("r"))


def discover(spark: SparkSession, path: str, names: tuple[str, ...] = ("threat", "benign")) -> list[str]:
    """Stores at ``path``: of a folder the files ``<name>_conversations.json`` in
    the order of ``names``, then any other ``*_conversations.json`` by name; of a
    file named so, itself and those of its siblings that are in ``names``; of a
    missing path, what its folder has. Listed by Spark, so any store it reads
    will do; file contents are not read."""
    def files(folder: str, pattern: str = "*_conversations.json") -> dict[str, str]:
        try:
            rows = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder or ".")
                    .select("path").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r.path.rsplit("/", 1)[1]: r.path for r in rows}

    folder, _, last = path.rstrip("/").rpartition("/")
    wanted = [f"{n}_conversations.json" for n in names]
    if last.endswith(".json"):
        itself = list(files(folder, last).values())
        if itself:
            beside = files(folder) if last in wanted else {}
            return itself + [beside[w] for w in wanted if w in beside and w != last]
        here = files(folder)
    else:
        here = files(path) or files(folder)
    return [here[w] for w in wanted if w in here] + [here[n] for n in sorted(here) if n not in wanted]
