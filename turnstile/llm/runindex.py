"""Exact substring dedup with run-length compressed Burrows-Wheeler indexes.

Every 100-byte window is assigned to the smallest hash among its 20-byte
grams. Equal windows pick the same gram at the same place, so windows can only
repeat inside the group of one such anchor, and a run of windows that share an
anchor is one snippet. A snippet that occurred before as a whole is removed
without looking at it. Where an anchor has several different snippets, their
texts are brought together and indexed: suffix array, Burrows-Wheeler
transform, its runs, and common-prefix lengths sampled at the run ends only.
Streaming along the text, the lengths between two samples follow by
counting down, which gives every position's match with its neighbour; matches
of 100 bytes bound the sets of equal windows, and all but the first of a set
are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, spread, stash

LENGTH = 100                   # bytes of a repeat
GRAM = 20                      # bytes of an anchor
PIECE = 1 << 22                # bytes of text looked at together
POSITION_BITS = 24             # a piece's positions, kept below the hash while taking minima
INDEX_BYTES = 1 << 20          # text of one index; one anchor group may be larger
HOT_SNIPPETS = 20_000          # different snippets of one anchor beyond which windows are hashed one by one

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every position, by doubling."""
    level = _mix(data.astype(np.uint64) + np.uint64(1))
    out, done, width, factor = None, 0, 1, _BASE
    rest = size
    while rest:
        if rest & 1:
            part = level[done:]
            if out is None:
                out = part.copy()
            else:
                n = min(len(out), len(part))
                power = np.uint64(pow(int(_BASE), width, 1 << 64))
                out = out[:n] * power + part[:n]
            done += width
        rest >>= 1
        if rest:
            level = level[:-width] * factor + level[width:] if len(level) > width else level[:0]
            width *= 2
            factor = np.uint64(pow(int(factor), 2, 1 << 64))
    return _mix(out[: max(0, len(data) - size + 1)])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width, level = 1, x
    while width * 2 <= size:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    gap = size - width
    return np.minimum(level[: len(level) - gap], level[gap:]) if gap else level


def snippets(data: np.ndarray, begins: np.ndarray, stops: np.ndarray):
    """Snippets of texts laid end to end: text number, first byte of the first
    window (in ``data``), windows, anchor hash, anchor offset."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(np.uint64), none
    grams = gram_hashes(data, GRAM)
    low = np.uint64((1 << POSITION_BITS) - 1)
    best = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    spot = (best & low).astype(np.int64)
    owner = np.repeat(np.arange(len(begins)), stops - begins)[: len(spot)]
    good = np.arange(len(spot)) + LENGTH <= stops[owner]
    at = np.flatnonzero(good)
    if not len(at):
        return none, none, none, none.view(np.uint64), none
    change = (spot[at[1:]] != spot[at[:-1]]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return owner[start], start, count, grams[spot[start]], spot[start] - start


def _pieces(batch: pa.RecordBatch):
    """Runs of whole rows of about PIECE bytes; a longer text is cut into pieces
    that overlap by LENGTH - 1 bytes, so that every window lies in one of them.
    Yields row numbers, offsets of the pieces in their rows, bytes, bounds."""
    column = batch.column("text").cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = row + 1
        while end < len(column) and offsets[end + 1] - offsets[row] <= PIECE:
            end += 1
        lo, hi = int(offsets[row]), int(offsets[end])
        if end - row > 1 or hi - lo <= 2 * PIECE:
            yield np.arange(row, end), np.zeros(end - row, np.int64), data[lo:hi], offsets[row:end] - lo, offsets[row + 1:end + 1] - lo
        else:
            for a in range(lo, hi, PIECE):
                b = min(a + PIECE + LENGTH - 1, hi)
                yield np.array([row]), np.array([a - lo]), data[a:b], np.array([0]), np.array([b - a])
        row = end


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest
    for batch in batches:
        for rows, shift, data, begins, stops in _pieces(batch):
            owner, start, count, anchor, lead = snippets(data, begins, stops)
            if not len(start):
                continue
            blob = data.tobytes()
            whole = [xxh3_64_intdigest(blob[a:a + n + LENGTH - 1], o)
                     for a, n, o in zip(start.tolist(), count.tolist(), lead.tolist())]
            take = pa.array(rows[owner])
            keys, ties = batch.column("doc_id").take(pa.array(rows)).to_pylist(), batch.column("text_hash").take(pa.array(rows)).to_pylist()
            by = sorted(range(len(keys)), key=lambda k: (keys[k] is not None, keys[k], ties[k]))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            anchor, snip = anchor.view(np.int64), np.array(whole, np.uint64).view(np.int64)
            order = np.lexsort((start, rank[owner], snip, anchor))
            known = np.zeros(len(start), bool)               # the same snippet came before in this very batch
            known[order[1:]] = (anchor[order[1:]] == anchor[order[:-1]]) & (snip[order[1:]] == snip[order[:-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(snip), batch.column("doc_id").take(take), batch.column("text_hash").take(take),
                 pa.array((start - begins[owner] + shift[owner]).astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(known)],
                names=["anchor", "snip", "doc_id", "text_hash", "start", "n", "known"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, snippet and place: those whose snippet came before
    (``again``), and the first rows of the snippets of an anchor that has
    several. Rows known to repeat pass through. Only one row is carried from
    batch to batch."""
    last: tuple[int, int] | None = None
    pending: pa.RecordBatch | None = None
    for batch in batches:
        known = batch.column("known")
        batch = batch.drop_columns(["known"])
        if known.true_count:
            rows = batch.filter(known)
            yield rows.append_column("again", pa.array(np.ones(rows.num_rows, bool)))
            batch = batch.filter(pa.compute.invert(known))
        anchor, snip = batch.column("anchor").to_numpy(), batch.column("snip").to_numpy()
        if not len(anchor):
            continue
        prev_a = np.concatenate([[last[0] if last else 0], anchor[:-1]])
        prev_s = np.concatenate([[last[1] if last else 0], snip[:-1]])
        new_a = anchor != prev_a
        if last is None:
            new_a[0] = True
        new_s = new_a | (snip != prev_s)
        group = np.cumsum(new_a)
        kinds = np.bincount(group, new_s, group[-1] + 1).astype(np.int64)
        if not new_a[0]:
            kinds[0] += 1 if pending is not None else 2     # what the group had before this batch
        several = kinds[group] > 1
        if pending is not None and not new_a[0] and kinds[0] > 1:
            yield pending.append_column("again", pa.array([False]))
        out = np.flatnonzero(~new_s | several)
        if len(out):
            rows = batch.take(pa.array(out))
            yield rows.append_column("again", pa.array(~new_s[out]))
        if kinds[group[-1]] > 1:
            pending = None
        elif group[-1] > 0 or pending is None:
            tail = np.flatnonzero(new_s)
            pending = batch.slice(int(tail[-1]), 1) if len(tail) else pending
        last = int(anchor[-1]), int(snip[-1])


def suffix_array(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sorted suffixes of strings laid end to end; a suffix ends with its
    string, and equal suffixes are ordered by place."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.concatenate([data.astype(np.int64) + 1, np.zeros(7, np.int64)])
    place = np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):                                      # the first seven bytes at once, nine bits each
        key = (key << 9) | np.where(place + k < stop, wide[k:n + k], 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    start = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    alone = np.diff(np.append(start, n)) == 1
    active = order[~alone[np.cumsum(new) - 1]]
    step = 7
    while len(active):
        ahead = active + step
        over = ahead >= stop[active]
        follow = np.where(over, active, n + rank[np.minimum(ahead, n - 1)])
        floor = rank[active]
        by = np.lexsort((follow, floor))
        active, follow, floor = active[by], follow[by], floor[by]
        head = np.concatenate([[True], np.diff(floor) != 0])
        new = head | np.concatenate([[True], np.diff(follow) != 0])
        start, parent = np.flatnonzero(new), np.flatnonzero(head)
        group = np.cumsum(new) - 1
        rank[active] = floor + start[group] - parent[np.cumsum(head) - 1]
        alone = np.diff(np.append(start, len(active))) == 1
        active = active[~alone[group]]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = place
    return out


class RunIndex:
    """Run-length Burrows-Wheeler index of strings laid end to end."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.stop = np.repeat(np.cumsum(sizes), sizes)
        self.begin = np.cumsum(sizes) - sizes
        self.order = suffix_array(self.data, self.stop)
        if not len(self.data):
            self.run_rows = self.run_bytes = self.samples = self.order
            return
        before = self.data[self.order - 1].astype(np.int32)
        opening = np.zeros(len(self.data), bool)
        opening[self.begin[sizes > 0]] = True
        before[opening[self.order]] = -1                    # the end of the string before: never part of a run
        change = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] < 0)])
        self.run_rows = np.flatnonzero(change)              # run starts; the ends lie just before them
        self.run_bytes = before[self.run_rows]
        self.samples = self._common(self.run_rows)

    def _common(self, rows: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes on both sides of the given run ends."""
        out = np.zeros(len(rows), np.int64)
        live = np.flatnonzero(rows > 0)
        a, b = self.order[rows[live] - 1], self.order[rows[live]]
        room = np.minimum(self.stop[a] - a, self.stop[b] - b)
        done = np.zeros(len(live), np.int64)
        todo = np.arange(len(live))
        span = np.arange(16)
        top = len(self.data) - 1
        while len(todo):
            p, q = (a[todo] + done[todo])[:, None] + span, (b[todo] + done[todo])[:, None] + span
            same = self.data[np.minimum(p, top)] == self.data[np.minimum(q, top)]
            run = np.where(same.all(1), 16, same.argmin(1))
            done[todo] = np.minimum(done[todo] + run, room[todo])
            todo = todo[(run == 16) & (done[todo] < room[todo])]
        out[live] = done
        return out

    def matching_statistics(self) -> np.ndarray:
        """Length of the match of every position with its neighbour in suffix
        order, streamed along the text from the run samples."""
        at = np.full(len(self.data), -1, np.int64)
        at[self.order[self.run_rows]] = self.samples
        place = np.arange(len(self.data))
        source = np.maximum.accumulate(np.where(at >= 0, place, 0))
        return np.maximum(at[source] - (place - source), 0)

    def repeated(self, length: int) -> np.ndarray:
        """Positions whose next ``length`` bytes also start at an earlier position."""
        if not len(self.data):
            return np.zeros(0, np.int64)
        match = self.matching_statistics()[self.order]
        starts = np.flatnonzero(match < length)             # sets of equal windows
        first = np.minimum.reduceat(self.order, starts)
        group = np.cumsum(match < length) - 1
        return np.sort(self.order[self.order != first[group]])


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers."""
    head = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1])) if len(at) else np.zeros(0, np.int64)
    return at[head], np.diff(np.append(head, len(at)))


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets sorted by anchor and place: windows that came before."""
    def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = RunIndex(batch.column("content").to_pylist())
        at = index.repeated(LENGTH)
        owner = np.searchsorted(index.begin, at, "right") - 1
        start, size = _runs(at + owner)                      # a gap between strings
        owner = np.searchsorted(index.begin + np.arange(len(index.begin)), start, "right") - 1
        start = start - owner - index.begin[owner]
        base = batch.column("start").to_numpy()[owner]
        take = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("text_hash").take(take),
             pa.array((base + start).astype(np.int32)), pa.array(size.astype(np.int32))],
            names=["doc_id", "text_hash", "start", "n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("content").nbytes
        if size < INDEX_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchor = table.column("anchor").to_numpy()
        change = np.flatnonzero(anchor[1:] != anchor[:-1])
        if not len(change):                                  # one group: bounded by HOT_SNIPPETS
            continue
        cut = int(change[-1]) + 1
        yield marks(table.slice(0, cut).combine_chunks().to_batches()[0])
        held = table.slice(cut).combine_chunks().to_batches()
        size = sum(b.column("content").nbytes for b in held)
    if held:
        yield marks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted snippets of each text."""
    for batch in batches:
        lists, texts = batch.column("wanted"), batch.column("text").cast(pa.binary()).to_pylist()
        rows = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        starts, counts = rows.field("start").to_numpy(), rows.field("n").to_numpy()
        content = [texts[o][a:a + n + LENGTH - 1] for o, a, n in zip(owner.tolist(), starts.tolist(), counts.tolist())]
        take = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [rows.field("anchor"), batch.column("doc_id").take(take), batch.column("text_hash").take(take), rows.field("start"),
             rows.field("n"), rows.field("hot"), pa.array(content, pa.binary())],
            names=["anchor", "doc_id", "text_hash", "start", "n", "hot", "content"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of the snippets of a very common anchor."""
    from xxhash import xxh3_128_digest
    for batch in batches:
        content, starts, counts = batch.column("content").to_pylist(), batch.column("start").to_pylist(), batch.column("n").to_pylist()
        for lo in range(0, len(content), 1000):
            hi = min(lo + 1000, len(content))
            owner = np.repeat(np.arange(lo, hi), counts[lo:hi])
            place = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[lo:hi], counts[lo:hi])])
            keys = [xxh3_128_digest(content[i][j:j + LENGTH]) for i in range(lo, hi) for j in range(counts[i])]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("doc_id").take(take), batch.column("text_hash").take(take),
                 pa.array(place.astype(np.int32))], names=["window", "doc_id", "text_hash", "start"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the marked windows of each text and take their bytes out."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        marks = batch.column("marks").to_pylist()
        for k in range(batch.num_rows):
            text = batch.column("text")[k]
            blob = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans: list[list[int]] = []
            for a, b in sorted((m["start"], m["start"] + m["n"] + LENGTH - 1) for m in marks[k] or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(blob[at:a])
                at = b
            kept.update(blob[at:])
            for column, v in zip(out, (len(blob), sum(b - a for a, b in spans), spans, kept.hexdigest())):
                column.append([{"start": a, "end": b} for a, b in v] if column is out[2] else v)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
             pa.array(out[2], span), pa.array(out[3])],
            names=["doc_id", "text_hash", "n_bytes", "n_removed", "removed", "kept_sha256"])


def mark_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``start, n``: runs of window starts whose 100
    bytes also start earlier. ``docs(doc_id, text_hash, text)`` has one row per
    (doc_id, text_hash); the order is doc_id (null first), hash, position."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    where = ["doc_id", "text_hash", "start"]
    rows = in_arrow(docs, _anchors, f"anchor long, snip long, doc_id {kind}, text_hash long, start int, n short, known boolean")
    # what a task already knows to repeat is spread evenly: copies do not heap up at their anchors
    key = F.when(F.col("known"), F.xxhash64(*where)).otherwise(F.col("anchor"))
    dealt = rows.repartition(spread(docs), key).sortWithinPartitions("known", "anchor", "snip", *where)
    found = stash(in_arrow(dealt, _repeated, f"anchor long, snip long, doc_id {kind}, text_hash long, start int, n short, "
                           "again boolean").drop("snip"), "repeats")
    again = found.where("again").select(*where, F.col("n").cast("int"))
    first = found.where("not again")
    hot = first.groupBy("anchor").count().where(F.col("count") > HOT_SNIPPETS).select("anchor", F.lit(True).alias("hot"))
    hot = stash(hot, "repeats-hot")
    any_hot = bool(hot.take(1))
    marked = first.join(hot, "anchor", "left") if any_hot else first.withColumn("hot", F.lit(False))
    wanted = marked.groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(F.collect_list(
        F.struct("anchor", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))   # of one text
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_i"]) & (docs["text_hash"] == wanted["_h"]))
    content = in_arrow(texts.select("doc_id", "text_hash", "text", "wanted"), _contents,
                       f"anchor long, doc_id {kind}, text_hash long, start int, n short, hot boolean, content binary")
    content = stash(content, "repeats-content")
    plain = content.where("not hot").drop("hot", "n").repartition(spread(docs), "anchor").sortWithinPartitions("anchor", *where)
    out = again.unionByName(in_arrow(plain, _marker, f"doc_id {kind}, text_hash long, start int, n int"))
    if any_hot:
        windows = in_arrow(content.where("hot").select(*where, "n", "content"), _windows,
                           f"window binary, doc_id {kind}, text_hash long, start int")
        place = F.struct(*where)
        low = windows.groupBy("window").agg(F.min(place).alias("low"))
        out = out.unionByName(windows.join(low, "window").where(place != F.col("low")).select(*where, F.lit(1).alias("n")))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``n_bytes, n_removed, removed`` (array of
    start, end in bytes) and ``kept_sha256``.

    Null text is empty; texts under 100 bytes lose nothing; of rows equal in id
    and text, one is the first and every other loses all of a text of 100 bytes
    or more; null ids come first; an empty table gives none; further columns
    are ignored. Snippets that only repeat as a whole never leave their task; an
    anchor with very many different snippets is resolved window by window in a
    grouped minimum, so no task holds an unbounded group's texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    copies = keyed.groupBy("doc_id", "text_hash").count().where("count > 1").select(
        F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("count").alias("_n"))
    copies = stash(copies, "copies")
    many = bool(copies.take(1))
    base = keyed.dropDuplicates(["doc_id", "text_hash"]) if many else keyed
    marks = mark_repeats(base).groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(
        F.collect_list(F.struct("start", "n")).alias("marks"))                # of one text
    joined = base.join(marks, base["doc_id"].eqNullSafe(marks["_i"]) & (base["text_hash"] == marks["_h"]), "left")
    out = in_arrow(joined.select("doc_id", "text_hash", "text", "marks"), _removed,
                   f"doc_id {kind}, text_hash long, n_bytes long, n_removed long, "
                   "removed array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    if not many:
        return out
    numbered = out.join(copies, out["doc_id"].eqNullSafe(copies["_i"]) & (out["text_hash"] == copies["_h"]), "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1)).cast("long"))))
    later = (F.col("_copy") > 1) & (F.col("n_bytes") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return numbered.select(
        "doc_id", "text_hash", "n_bytes", F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, whole).otherwise(F.col("removed")).alias("removed"),
        F.when(later, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def contract(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
