"""SimHash near-duplicates with pivot distance tables.

Texts become 64-bit fingerprints (bitwise majority over the hashes of their
word shingles). Distinct fingerprints are dealt to buckets so that any two
within the distance meet: with more blocks of bits than differing bits some
blocks agree, and each choice of agreeing blocks is one bucket key. Inside a
bucket the distances to reference fingerprints are compared: by the triangle
inequality two fingerprints whose distances to any one pivot differ by more
than the bound cannot be close, so such pairs are discarded, and only the
survivors are verified bit by bit. A bucket reports a star per connected group,
never all pairs, and components over the stars give the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, in_arrow, spread, stash

SHINGLE = 4
MAX_BITS = 4
SEED = 42
N_BLOCKS = 7                   # blocks of bits; a bucket key joins N_BLOCKS - MAX_BITS of them
N_PIVOTS = 16
LARGE = 4096                   # a larger bucket is divided by further bits
BATCH_ROWS = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints (uint64) of whole texts."""
    from xxhash import xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(xxh64_intdigest(joined, seed))
            counts[i] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        hashes += [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())]
        counts[i] = len(words) - shingle + 1
    out = np.zeros(len(texts), np.uint64)
    have = np.flatnonzero(counts)
    if not len(have):
        return out
    all_hashes = np.array(hashes, np.uint64)
    stops = np.cumsum(counts[have])
    # texts are summed in runs, so the unpacked bits stay small whatever a text's length
    run = 1 << 16
    for i, stop, n in zip(have.tolist(), stops.tolist(), counts[have].tolist()):
        ones = np.zeros(64, np.int64)
        for a in range(stop - n, stop, run):
            bits = np.unpackbits(all_hashes[a:min(a + run, stop)].view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += bits.sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, fixed by a hash."""
    return np.array([int(hashlib.md5(f"pivot {i}".encode()).hexdigest()[:16], 16) for i in range(n)], np.uint64)


def distance_table(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(prints[:, None] ^ refs[None]).astype(np.int8)


def masks(n_blocks: int, equal: int, bits: list[int] | None = None) -> list[int]:
    """Bit masks of every choice of ``equal`` out of ``n_blocks`` blocks of ``bits``."""
    bits = list(range(64)) if bits is None else bits
    blocks = [sum(1 << b for b in part) for part in np.array_split(np.array(bits), n_blocks) for part in [part.tolist()]]
    return [sum(c) for c in combinations(blocks, equal)]


def links(prints: np.ndarray, table: np.ndarray, bound: int, shared: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stars ``(members, smallest member)`` of the groups within a bucket of
    distinct fingerprints that agree on the bits ``shared``."""
    free = [b for b in range(64) if not shared >> b & 1]
    if len(prints) > LARGE and len(free) > 12:
        out = []
        n_blocks = bound + 2
        for mask in masks(n_blocks, n_blocks - bound, free):
            key = prints & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    out += links(prints[part], table[part], bound, shared | mask)
        return out
    stars = []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        group, todo, rest = [rest[0]], [rest[0]], rest[1:]
        while todo and len(rest):
            u = todo.pop()
            near = np.abs(table[rest] - table[u]).max(1) <= bound           # survivors of the pivot test
            near[near] = np.bitwise_count(prints[rest[near]] ^ prints[u]) <= bound
            hit = rest[near]
            group += hit.tolist()
            todo += hit.tolist()
            rest = rest[~near]
        if len(group) > 1:
            stars.append(np.array(group))
    return [(prints[g], np.repeat(prints[g].view(np.int64).min(), len(g)).view(np.uint64)) for g in stars]


def _fingerprinter(names: list[str], shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(lo, BATCH_ROWS)
                found = fingerprints([t or "" for t in piece.column("text").to_pylist()], shingle, seed)
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [pa.array(found.view(np.int64))],
                                                 names=names + ["print"])
    return run


def _linker(bound: int, keys: list[int]):
    mask_of = np.array(keys, np.uint64)
    refs = pivots()

    def edges(part: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by bucket; all buckets are whole."""
        if len(part) < 2:
            return
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:, 0] != part[:-1, 0])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(part)))
        prints = part[:, 1].astype(np.int64).view(np.uint64)
        table = None
        members, leaders = [], []
        two = starts[sizes == 2]
        if len(two):                                        # most shared buckets: all at once
            a, b = prints[two], prints[two + 1]
            ok = np.abs(distance_table(a, refs) - distance_table(b, refs)).max(1) <= bound
            ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= bound
            members.append(a[ok])
            leaders.append(b[ok])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = prints[s:s + n]
            table = distance_table(own, refs)
            for m, l in links(own, table, bound, int(mask_of[part[s, 0]])):
                members.append(m)
                leaders.append(l)
        if members:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(members).view(np.int64)), pa.array(np.concatenate(leaders).view(np.int64))],
                names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)
        for batch in batches:
            rows = np.stack([batch.column("combo").to_numpy().astype(np.int64), batch.column("print").to_numpy()], 1)
            held = np.concatenate([held, rows])
            key = held[:, 1].view(np.uint64) & mask_of[held[:, 0]]
            change = np.flatnonzero((key[1:] != key[:-1]) | (held[1:, 0] != held[:-1, 0]))
            if len(change):                                 # the last bucket may go on in the next batch
                cut = int(change[-1]) + 1
                yield from edges(held[:cut], key[:cut])
                held = held[cut:]
        yield from edges(held, held[:, 1].copy().view(np.uint64) & mask_of[held[:, 0]] if len(held) else held[:, 0])
    return run


def classes(prints: DataFrame, bound: int = MAX_BITS) -> DataFrame:
    """``prints(print)`` distinct longs: ``(node, label)`` for every fingerprint
    that has another within ``bound`` bits."""
    n_blocks = N_BLOCKS if bound == MAX_BITS else bound + 3
    keys = masks(n_blocks, n_blocks - bound)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    key = F.col("print").bitwiseAND(F.element_at(F.array(*[F.lit(k).cast("long") for k in signed]), F.col("combo") + 1))
    dealt = (prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(len(keys) - 1))).alias("combo"))
             .repartition(spread(prints), "combo", key).sortWithinPartitions("combo", key))
    edges = in_arrow(dealt.select("combo", "print"), _linker(bound, keys), "a long, b long")
    return components(edges, "simhash-links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bound: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``fingerprint`` (16 hex
    digits), ``component`` (a long that names the class) and ``component_id``
    (its smallest doc_id).

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows share a class; a class whose ids are all null has a null component_id;
    an empty table gives none; further columns are ignored. Equal fingerprints
    are one node whatever their number, so a large group of copies costs no more
    than one; the join back to the documents is split by AQE for a hot one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = stash(in_arrow(rows, _fingerprinter(["doc_id", "text_hash"], shingle, seed),
                           f"doc_id {kind}, text_hash long, print long"), "simhash")
    nodes = found.groupBy("print").agg(F.min("doc_id").alias("_low"))
    labels = classes(nodes.select("print"), bound)
    named = nodes.join(labels, nodes["print"] == labels["node"], "left").select(
        "print", "_low", F.coalesce("label", "print").alias("component"))
    low = named.groupBy("component").agg(F.min("_low").alias("component_id"))
    known = named.join(low, "component").select("print", "component", "component_id")
    return found.join(known, "print").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bound: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every class: the smallest doc_id (nulls last),
    then the smallest text hash; of repeated equal rows one stays. Every input
    column keeps its name and value."""
    found = near_duplicates(docs, shingle, bound)
    first = found.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))).alias("k"))
    keys = first.select(F.col("k.i").alias("_i"), F.col("k.h").alias("_h"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"),
                       F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    return (rows.join(keys, rows["_id"].eqNullSafe(keys["_i"]) & (rows["_hash"] == keys["_h"]), "leftsemi")
            .dropDuplicates(["_id", "_hash"]).select("_doc.*"))


def contract(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
