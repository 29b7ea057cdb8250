"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range. Since the fraction is the same for all documents, the sketch of a union
is the union of the sketches, and the share of one sketch found in another
estimates containment, also between a paragraph and a book. Short texts, which
the fraction would leave with few hashes or none, keep their ``FLOOR`` smallest
ones besides; a sketch tells from its own content up to which value it is
whole, and two sketches are compared below the lesser of the two values.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from .common import in_arrow, spread, stash

SHINGLE = 5                    # words
FRACTION = 8                   # one hash of so many is kept
FLOOR = 32
SEED = 42
PIECE = 1 << 20                # bytes hashed at once
BASE = 0x9E3779B97F4A7C15      # odd, so powers of it are invertible modulo 2^64
_ALL = (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def limit(fraction: int = FRACTION) -> int:
    """Largest hash below the fixed fraction."""
    return (1 << 64) // fraction - 1


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1)
        _POWERS[:] = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, _mix(h ^ (ends - starts).astype(np.uint64) ^ np.uint64(SEED))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every word, in order. Texts are hashed
    together in pieces; a text longer than a piece is cut between words."""
    owners, hashes = [], []
    pending, held, first = [], 0, 0

    def flush(upto: int) -> None:
        nonlocal pending, held, first
        starts, h = _word_hashes(b"\n".join(pending))
        begins = np.cumsum([0] + [len(p) + 1 for p in pending[:-1]])
        owners.append(first + np.searchsorted(begins, starts, "right") - 1)
        hashes.append(h)
        pending, held, first = [], 0, upto

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if held and held + len(data) > PIECE:
            flush(i)
        while len(data) > PIECE:                       # only a text by itself gets here
            cut = max(data.rfind(b, 0, PIECE) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut < 0:
                after = [c for c in (data.find(b, PIECE) for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if c >= 0]
                cut = min(after, default=len(data))
            pending, held, first = [data[:cut]], cut, i
            data = data[cut + 1:]
            flush(i)
        pending.append(data)
        held += len(data) + 1
    if pending:
        flush(len(texts))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every shingle: ``size`` words in a row, or
    all words of a text with fewer."""
    owner, words = words_of(texts)
    counts = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        step = np.uint64(0xD6E8FEB86659FD93)
        mixed = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            mixed = mixed * step + words[k:k + len(mixed)]
        whole = owner[:len(mixed)] == owner[size - 1:] if len(mixed) else np.zeros(0, bool)
        out_owner, out = [owner[:len(mixed)][whole]], [mixed[whole]]
        begins = np.cumsum(counts) - counts
        for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
            h = np.zeros(1, np.uint64)
            for w in words[begins[i]:begins[i] + counts[i]]:
                h = h * step + w
            out_owner.append(np.array([i]))
            out.append(h ^ np.uint64(counts[i]))
    return np.concatenate(out_owner), _mix(np.concatenate(out))


def sketches(texts: list[str], size: int = SHINGLE, fraction: int = FRACTION, floor: int = FLOOR) -> list[np.ndarray]:
    """The sketch (sorted distinct uint64 hashes) of every text."""
    owner, hashes = shingles(texts, size)
    counts = np.bincount(owner, minlength=len(texts))
    low = hashes <= np.uint64(limit(fraction))
    # texts of few shingles are kept whole here and cut to the floor below
    keep = low | (counts[owner] <= 4 * fraction * floor)
    owner, hashes, low = owner[keep], hashes[keep], low[keep]
    order = np.lexsort((hashes, owner))
    owner, hashes, low = owner[order], hashes[order], low[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes, low = owner[new], hashes[new], low[new]
    stops = np.searchsorted(owner, np.arange(len(texts) + 1))
    under = np.concatenate([[0], np.cumsum(low)])
    out = []
    for i, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist())):
        n = int(under[b] - under[a])
        if n < floor and counts[i] > 4 * fraction * floor:      # many shingles, few distinct or few low
            own = np.unique(shingles([texts[i]], size)[1])
            out.append(own[:max(n, floor)])
        else:
            out.append(hashes[a:min(b, a + max(n, floor))])
    return out


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """Sketch of the union of two documents' shingles."""
    both = np.union1d(a, b)
    return both[:max(int(np.searchsorted(both, np.uint64(limit(fraction)), "right")), floor)]


def reach(sketch: np.ndarray, fraction: int = FRACTION, floor: int = FLOOR) -> int:
    """Value up to which the sketch holds every hash of its document."""
    if len(sketch) < floor:
        return _ALL
    return max(limit(fraction), int(sketch[-1]))


def compare(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION, floor: int = FLOOR) -> tuple[float, float]:
    """Estimated containment of ``a`` in ``b``, and resemblance of the two.

    Both are exact while both sketches are whole. Two documents without words
    are equal (1, 1). Where the common range holds no hash of ``a``, as for a
    few words against a book without them, the estimate is 0."""
    if not len(a) and not len(b):
        return 1.0, 1.0
    top = np.uint64(min(reach(a, fraction, floor), reach(b, fraction, floor)))
    a, b = a[:np.searchsorted(a, top, "right")], b[:np.searchsorted(b, top, "right")]
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return (shared / len(a) if len(a) else 0.0), (shared / max(1, len(a) + len(b) - shared))


def to_text(sketch: np.ndarray) -> str:
    """Sorted hashes, 16 hex digits each; empty without words."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def _runs(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts with bounded length together (or one text)."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def fingerprint(docs: DataFrame, fraction: int = FRACTION, size: int = SHINGLE, floor: int = FLOOR) -> DataFrame:
    """``docs(text, ...)`` with ``fingerprint``, the sketch of every whole text
    as text (null text: empty). No shuffle. Rows, also repeated ones, stay; an
    input column named ``fingerprint`` is replaced."""
    names = [c for c in docs.columns if c.lower() != "fingerprint"]
    packed = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a, b in _runs(texts):
                prints = [to_text(s) for s in sketches(texts[a:b], size, fraction, floor)]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), pa.array(prints, pa.string())],
                                                 ["_row", "fingerprint"])
    schema = StructType([packed.schema["_row"], StructField("fingerprint", StringType())])
    return in_arrow(packed, run, schema).select("_row.*", "fingerprint")


# ------------------------------------------------------------- neighbours in order of id
def _key(doc_id, h):
    """Order of documents: by id, null last, equal ids by a hash of the text."""
    return (doc_id is None, doc_id if doc_id is not None else 0, h)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt to tasks as ranges of ascending id, rows
    sorted, each range followed by a copy of the next range's first row (marked
    ``_ahead``; after the last range: the first row of all).

    Only ids and hashes are sorted to find the ranges, one bound a task goes to
    the driver, and every text is shuffled once. Rows that are equal in id and
    text stay together, one after the other."""
    n = spread(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    ids = rows.select("doc_id", "_h").repartitionByRange(n, F.col("doc_id").asc_nulls_last(), F.col("_h"))
    firsts = stash(ids.withColumn("_part", F.spark_partition_id()).groupBy("_part").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_h")).alias("low")), "sketch-bounds")
    bounds = sorted(_key(r["low"]["doc_id"], r["low"]["_h"]) for r in firsts.collect())   # one row a task
    place = {b: i for i, b in enumerate(bounds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(i, h) for i, h in zip(batch.column("doc_id").to_pylist(), batch.column("_h").to_pylist())]
            yield batch.append_column("_bucket", pa.array([bisect_right(bounds, k) - 1 for k in keys], pa.int32())
                                      ).append_column("_ahead", pa.array([False] * len(keys)))
            also = [i for i, k in enumerate(keys) if k in place]
            if also:
                copies = batch.take(pa.array(also))
                before = [(place[keys[i]] - 1) % len(bounds) for i in also]
                yield copies.append_column("_bucket", pa.array(before, pa.int32())
                                           ).append_column("_ahead", pa.array([True] * len(also)))
    schema = StructType([*rows.schema.fields, StructField("_bucket", IntegerType()), StructField("_ahead", BooleanType())])
    return (in_arrow(rows, run, schema).repartitionById(n, F.col("_bucket"))
            .sortWithinPartitions("_bucket", "_ahead", F.col("doc_id").asc_nulls_last(), "_h"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (id, text, next text), a bounded number of characters each."""
    out, held, last = [], 0, None
    for batch in batches:
        for bucket, ahead, doc_id, text in zip(*(batch.column(c).to_pylist()
                                                 for c in ("_bucket", "_ahead", "doc_id", "text"))):
            if last is not None and last[0] == bucket:
                out.append((last[1], last[2], text))
                held += len(last[2]) + len(text)
            last = None if ahead else (bucket, doc_id, text)
            if held > 1 << 21:
                yield out
                out, held = [], 0
    if out:
        yield out


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Every document's sketch beside that of an edited text and of the next
    document by ascending id (after the last: the first).

    The edited text replaces the last quarter of the code points, rounded down,
    by the first as many of the next document (all, if it has fewer).
    ``near_*`` is the containment of the document's sketch in the other,
    ``resemblance_*`` the Jaccard estimate. Null text counts as empty; a null id
    comes last; rows with equal ids follow in an order fixed by their texts; a
    table of one row is its own neighbour, an empty one gives no rows. Columns
    besides ``doc_id`` and ``text`` are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pairs(batches):
            texts = [t for _, t, _ in rows]
            edited = []
            for _, t, following in rows:
                q = len(t) // 4
                edited.append(t[:len(t) - q] + following[:q])
            # a row's next text is usually the next row's own
            later = [f for i, (_, _, f) in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] != f]
            every = sketches(texts + edited + later)
            own, changed, rest = every[:len(rows)], every[len(rows):2 * len(rows)], iter(every[2 * len(rows):])
            after = [next(rest) if i + 1 == len(rows) or rows[i + 1][1] != f else own[i + 1]
                     for i, (_, _, f) in enumerate(rows)]
            near = [compare(a, b) for a, b in zip(own, changed)]
            far = [compare(a, b) for a, b in zip(own, after)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in rows], arrow_id), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                 pa.array([to_text(s) for s in own]), pa.array([to_text(s) for s in changed]),
                 *[pa.array([p[k] for p in side], pa.float64()) for k in (0, 1) for side in (near, far)]],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                 "near_next", "resemblance_edited", "resemblance_next"])
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    return in_arrow(in_order(docs), run, f"doc_id {id_type.simpleString()}, n_chars long, edited_sha256 string, "
                    "fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
                    "resemblance_edited double, resemblance_next double")


def contract(docs: DataFrame) -> DataFrame:
    return neighbour_likeness(docs)
