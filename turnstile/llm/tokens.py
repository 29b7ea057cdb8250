"""Token ids in Parquet list columns, with chosen encodings and page indexes.

Documents are range-partitioned by id, encoded inside the tasks, and written by
Spark's own Parquet writer (so a lost task is simply written again): token
lists dictionary-encoded, the sorted bookkeeping columns delta-encoded, small
pages and row groups, page indexes on. A reader can then fetch counts and
offsets without touching the token pages, or only the pages of an id range.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import in_arrow, spread

END_ID = 0
CACHE_PIECES = 600_000        # memory bound of a worker's piece cache; beyond it only the last texts' pieces stay
JOIN_CHARS = 1 << 18          # unseen pieces are encoded together in strings of this length
SLICE_BYTES = 5 << 20         # texts cut and put together at once

#: A byte-level BPE with the usual pre-tokenizer always starts a new piece at a
#: space before a visible character, so text can be cut there and encoded
#: chunk by chunk with the same ids. Texts with any other space are cut by _CUT.
_CUT = re.compile(r" (?=[!-~\w])")
_ODD = " (?:[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + r"]|\z)"        # Python's \s, for RE2

#: Inside a chunk, pieces also end between letters, digits, ASCII punctuation
#: and single line feeds before something visible; not after an apostrophe, which
#: may begin a contraction. Letters are those that every Unicode version knows.
#: A match with a space in front begins a chunk; what is not known stays whole.
_KINDS = {"l": "A-Za-zÀ-ÖØ-öø-ɏ", "p": r"!-&(-/:-@\[-`{-~", "d": "0-9"}
_FINE = re.compile("|".join(x.format(**_KINDS) for x in (
    r" ?[{l}]++(?=[{p}{d}' \n]|\Z)", r" ?[{p}]++(?=[{l}{d} \n]|\Z)", r" ?[{d}]++(?=[{l}{p}' \n]|\Z)",
    r"\n(?=[{l}{p}{d}'])", r"\n+(?=\n[{l}{p}{d}'])", r" ?[^ ]+")))
_BLANK = re.compile(r"\s")
_SPACED = re.compile(r" \S")
_USUAL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",                 # delta encodings
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.block.size": str(32 << 20),                     # row group bytes
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _lists(ids: bytes, sizes: list[int]) -> pa.ListArray:
    stops = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))


class ChunkEncoder:
    """Encodes texts with a tokenizer file, each distinct piece of a chunk once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.lengths = np.zeros(size, np.int64)              # bytes of each token
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(added[i].content.encode()) if i in added else len(token)
        self.marks = [t.content for t in added.values()]     # found before any cutting, so their chunks stay whole
        state = json.loads(self.tokenizer.to_str())
        self.fine = state["normalizer"] is None and _USUAL.items() <= (state["pre_tokenizer"] or {}).items()
        self.cache: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32).tobytes() for e in found]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of unseen pieces. Those that begin with a space and a visible
        character are encoded joined, others without blanks joined by line
        feeds, and cut again by the tokens' byte lengths; the rest one by one."""
        spaced, bare, alone = [], [], []
        for p in pieces:
            (spaced if _SPACED.match(p) else alone if not p or _BLANK.search(p) or not self._cuttable(p) else bare).append(p)
        self.cache.update(zip(alone, self._plain(alone)))
        for kind, before in ((spaced, ""), (bare, "\n")):
            part: list[str] = []
            size = 0
            for k, piece in enumerate(kind):
                part.append(piece)
                size += len(piece) + 1
                if size >= JOIN_CHARS or k == len(kind) - 1:
                    self._cut_again(part, before)
                    part, size = [], 0

    def _cut_again(self, part: list[str], before: str) -> None:
        blob = self._plain([before + before.join(part)])[0]
        ends = np.concatenate([[0], np.cumsum(self.lengths[np.frombuffer(blob, np.int32)])])
        wanted = np.cumsum([len(p.encode()) + len(before) for p in part])
        opens = np.concatenate([[0], wanted[:-1]]) + len(before)
        starts, stops = np.searchsorted(ends, opens, "right") - 1, np.searchsorted(ends, wanted, "right") - 1
        if not (np.array_equal(ends[stops], wanted) and np.array_equal(ends[starts], opens)):
            raise ValueError("this tokenizer does not start a piece at a space")
        self.cache.update(zip(part, map(blob.__getitem__, map(slice, (4 * starts).tolist(), (4 * stops).tolist()))))

    def _cuttable(self, chunk: str) -> bool:
        return self.fine and not any(m in chunk for m in self.marks)

    def _pieces(self, chunks: pa.Array, heads: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces of distinct chunks (the space before a chunk stands in its
        first piece) and then of distinct heads; the place of each chunk, then
        each head, among them, and the pieces of each by place."""
        whole = pc.match_substring(chunks, " ")
        for mark in self.marks:
            whole = pc.or_(whole, pc.match_substring(chunks, mark))
        whole = whole.to_numpy(zero_copy_only=False) if self.fine else np.ones(len(chunks), bool)
        cut = chunks.filter(pa.array(~whole))
        pieces = _FINE.findall("".join([" " + c for c in cut.to_numpy(zero_copy_only=False)]))
        first = pc.starts_with(pa.array(pieces, pa.string()), " ").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first)
        if len(starts) != len(cut):
            raise ValueError("a chunk was lost in cutting")
        sizes = np.diff(starts, append=len(pieces)).tolist()
        others = [[" " + c] for c in chunks.filter(pa.array(whole)).to_pylist()]
        others += [_FINE.findall(h) if " " not in h and self._cuttable(h) else [h] for h in heads.to_pylist()]
        for found in others:
            pieces += found
            sizes.append(len(found))
        place = np.concatenate([np.where(whole, len(cut) + np.cumsum(whole) - 1, np.cumsum(~whole) - 1),
                                len(chunks) + np.arange(len(heads))])
        return pieces, place, np.array(sizes, np.int64)

    def _ids(self, pieces: list[str]) -> pa.Array:
        """Ids of every piece, as lists."""
        rows = pa.array(pieces, pa.string()).dictionary_encode()
        names = rows.dictionary.to_numpy(zero_copy_only=False).tolist()
        unseen = [p for p in names if p not in self.cache]
        self._learn(unseen)
        found = list(map(self.cache.__getitem__, names))
        if len(self.cache) > CACHE_PIECES:
            self.cache = dict(zip(names, found))
        return _lists(b"".join(found), [len(b) // 4 for b in found]).take(rows.indices)

    def encode_column(self, texts: pa.Array, tail: bytes = b"") -> tuple[pa.Array, np.ndarray]:
        """int32 ids of all texts in a row, ``tail`` after each, and the ids per text."""
        if not len(texts):
            return pa.array([], pa.int32()), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, _ODD)
        parts = pc.split_pattern(texts, " ")
        if pc.any(odd).as_py():
            other = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], parts.type)
            mask = odd.to_numpy(zero_copy_only=False)
            place = np.where(mask, np.cumsum(mask) - 1 + len(mask), np.arange(len(mask)))
            parts = pa.concat_arrays([parts, other]).take(pa.array(place))
        sizes = pc.list_value_length(parts).to_numpy().astype(np.int64)
        stops = np.cumsum(sizes)
        heads = stops - sizes                                # stand before the first cut
        flat = parts.flatten()
        inner = np.ones(len(flat), bool)
        inner[heads] = False
        rests = flat.filter(pa.array(inner)).dictionary_encode()
        firsts = flat.take(pa.array(heads)).dictionary_encode()
        del parts, flat                                      # as large as the texts
        pieces, place, sizes = self._pieces(rests.dictionary, firsts.dictionary)
        ids = self._ids(pieces)
        stop = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])[np.cumsum(sizes)]
        units = _lists(ids.flatten().to_numpy().tobytes() + tail, [*np.diff(stop, prepend=0), len(tail) // 4])
        codes = np.empty(len(inner), np.int32)
        codes[inner] = place[rests.indices.to_numpy()]
        codes[heads] = place[firsts.indices.to_numpy() + len(rests.dictionary)]
        codes = np.insert(codes, stops, len(units) - 1)
        found = units.take(pa.array(codes))
        counts = np.add.reduceat(pc.list_value_length(found).to_numpy().astype(np.int64), heads + np.arange(len(heads)))
        return found.flatten(), counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of every text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        stops = np.cumsum(counts)
        ids = ids.to_numpy()
        return [ids[a:b].tobytes() for a, b in zip((stops - counts).tolist(), stops.tolist())]


@lru_cache(maxsize=1)
def _shared_encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, kept from task to task."""
    return ChunkEncoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + SLICE_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = _shared_encoder(path)
        first = 0
        tail = np.array([end_id], np.int32).tobytes()
        for batch in batches:
            for piece in _slices(batch):
                ids, counts = encoder.encode_column(piece.column("text").fill_null(""), tail)
                stops = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), part, np.int32)), piece.column("doc_id"),
                     pa.array(first + stops[:-1]), pa.array(counts), lists],
                    names=["part", "doc_id", "first", "n_tokens", "tokens"])
                first += int(stops[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 options: dict[str, str] | None = None) -> None:
    """Write ``docs(doc_id, text)`` as a token table under ``path``.

    Null text counts as empty and yields the end id alone; equal ids and
    repeated rows keep one row each (ordered by text hash); null ids come
    first; an empty table writes an empty table; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
            .withColumn("_i", F.monotonically_increasing_id()))   # lets equal keys spread over tasks
    ordered = (rows.repartitionByRange(spread(docs), "doc_id", "_h", "_i")
               .sortWithinPartitions("doc_id", "_h", "_i").select("doc_id", "text"))
    encoded = in_arrow(
        ordered, _encoder(tokenizer or vocabulary_path(), end_id),
        f"part int, doc_id {kind}, first long, n_tokens long, tokens array<int>")
    encoded.write.options(**WRITE_OPTIONS | (options or {})).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` without reading a token page: the partitions'
    totals (one number each) give the global offsets."""
    rows = spark.read.parquet(path).select("part", "doc_id", "first", "n_tokens")
    sums = sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    table = spark.createDataFrame(bases, "part int, _base long")
    return rows.join(F.broadcast(table), "part").select(      # one row per written partition
        "doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "part", "first")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Token lists, for an id range if given: the filter reaches the page index."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return rows.select("part", "doc_id", "first", "n_tokens", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        stops = lists.offsets.to_numpy()
        sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("part", "doc_id", "first")]
            + [pa.array(np.diff(stops).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["part", "doc_id", "first", "n_tokens", "ids_crc32"])


def contract(docs: DataFrame) -> DataFrame:
    """Digest rows of ``op6``, all taken from the written files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    bases = read_metadata(spark, path).groupBy("part").agg(
        F.min(F.col("start") - F.col("first")).alias("_base"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sums = in_arrow(
        read_tokens(spark, path), _checksums, f"part int, doc_id {kind}, first long, n_tokens long, ids_crc32 long")
    return sums.join(F.broadcast(bases), "part").select(       # one row per written partition
        "doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
