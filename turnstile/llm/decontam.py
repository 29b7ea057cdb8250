"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages and described by TF-IDF over the
benchmark's vocabulary (its words are the only ones that can match an item;
all others count towards a passage's length as unknown words; word counts come
from all documents). A randomised SVD of the passage matrix gives the latent
axes: one distributed pass over every passage of every document multiplies a
thin random matrix by the matrix and its transpose. Passages near an item by latent
cosine are candidates, and so are those that hold a run of ``GRAM`` words of an
item, so that no copy depends on weights or axes; each is verified word by
word: the longest common subsequence with the item must cover most of it, and
so must the one with its answer. Without a given answer the item's last sentence counts as one, and a
document that holds nearly all of the item is a match without it too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import in_arrow, stash

CHUNK = 1 << 10                # vector rows summed at once: they stay in the processor's cache
COSINES = 1 << 17              # cosines handled at once
BYTES = 1 << 20                # of text cut into words at once, or one text
WORDS = 1 << 17                # words handled at once, or one document
CELL = 16                      # words; a passage is two neighbouring cells
RANK = 96                      # latent axes
EXTRA = 16                     # further columns of the random matrix
STOP_BASE, STOP_SHARE = 50, 0.05   # words in more cells than base + share of all are stop words
GRAM = 4                       # words of a run that makes a candidate by itself (a shorter item: all its words)
MIN_COSINE = 0.45              # for items of a passage's length; less for shorter ones, see below
MIN_LCS = 0.6                  # share of an item's words found in order
MIN_ANSWER = 0.5               # the same for its answer
MIN_WHOLE = 0.8                # share of an item's words that needs no answer, if none is given beside the text
LONG = 4 * CELL                # words; longer items are searched by overlapping pieces of a passage's length
ITEM_BLOCK = 2000              # items (of long ones, pieces) searched together: bounds vocabulary and broadcast
SEED = 42

_SPACED = bytes(32 if chr(c) in "\t\n\x0b\x0c\r.,;:!?\"'()[]{}|*#$%&<>=" else c for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def answer_of(text: str, answer: str | None = None) -> list[bytes]:
    """The given answer, or else the words of the item's last sentence."""
    if answer:
        return words(answer)
    for part in reversed(re.split(r"[.!?\n]+", text)):
        found = words(part)
        if found:
            return found
    return []


def lcs(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has one bit per place
    of each word in the first sequence (bit-parallel)."""
    state = full = (1 << length) - 1
    for w in other:
        m = masks.get(w)
        if m:
            hit = state & m
            state = ((state + hit) | (state - hit)) & full
    return length - state.bit_count()


def place_masks(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


def bounded(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with a bounded size together (or one)."""
    stops = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(stops, stops[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _numbered(vocabulary: dict[bytes, int]):
    """The numbers of the ``words`` of every text, -1 outside the vocabulary.
    Arrow looks up the words of many texts at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pc.SetLookupOptions(pa.array(list(vocabulary), pa.large_binary()))
        number = np.array([*vocabulary.values(), -1], np.int32)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for lo, hi in bounded(sizes.astype(np.int64) + CELL, BYTES):
                piece = batch.slice(lo, hi - lo)
                texts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()]
                raw = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_SPACED), np.uint8)
                inside = raw != 32
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                starts, ends = edge[::2] + 1, edge[1::2] + 1
                found = pa.Array.from_buffers(pa.large_binary(), len(starts), [
                    None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(raw[inside])])
                ids = number[pc.index_in(found, options=known).fill_null(len(vocabulary)).to_numpy()]
                begins = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])        # of the texts
                stops = np.searchsorted(starts, begins).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_hash"), pa.ListArray.from_arrays(pa.array(stops), pa.array(ids))],
                    names=["doc_id", "text_hash", "ids"])
    return run


def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All word numbers of a batch, their cells, the first cell of each document
    and the number of cells (a document without words has one, empty)."""
    lists = batch.column("ids")
    stops = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy(zero_copy_only=False)[stops[0]:stops[-1]]
    sizes = np.diff(stops)
    n_cells = np.maximum(1, -(-sizes // CELL))
    first = np.cumsum(n_cells) - n_cells
    begin = np.cumsum(sizes) - sizes
    own = np.repeat(first, sizes) + (np.arange(len(ids)) - np.repeat(begin, sizes)) // CELL
    return ids, own, first, n_cells


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of cells with each word, and of all cells (word -1)."""
    for batch in batches:
        total, counts = 0, np.zeros(0, np.int64)
        for lo in range(0, batch.num_rows, 256):
            ids, own, _, n_cells = cells(batch.slice(lo, 256))
            known = ids >= 0
            pairs = np.sort(own[known] * (1 << 32) + ids[known])
            held = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] & 0xFFFFFFFF, minlength=len(counts))
            held[:len(counts)] += counts
            total, counts = total + n_cells.sum(), held
        word = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(word, -1).astype(np.int32)), pa.array(np.append(counts[word], total).astype(np.int64))],
            names=["word", "n"])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring documents with a bounded number of words together (or one)."""
    for lo, hi in bounded(np.diff(batch.column("ids").offsets.to_numpy()) + CELL, WORDS):
        yield batch.slice(lo, hi - lo)


def row_sums(vectors: np.ndarray, row: np.ndarray, group: np.ndarray, total: int) -> np.ndarray:
    """Sum of ``vectors[row]`` of every group; ``group`` ascends. The k-th rows
    of many groups are added at once, those of a large group by themselves."""
    out = np.zeros((total, vectors.shape[1]), vectors.dtype)
    size = np.bincount(group, minlength=total)
    begin = np.cumsum(size) - size
    falling = np.argsort(-size, kind="stable")
    large = int((size > 64).sum())
    for g in falling[:large].tolist():
        for a in range(begin[g], begin[g] + size[g], CHUNK):
            out[g] += vectors[row[a:min(a + CHUNK, begin[g] + size[g])]].sum(0)
    falling = falling[large:int((size > 0).sum())]
    for a in range(0, len(falling), CHUNK):
        own = falling[a:a + CHUNK]
        start, live = begin[own], np.cumsum(np.bincount(size[own])[::-1])[::-1]      # live[k]: groups of k rows or more
        sums = vectors[row[start]]
        for k in range(1, len(live) - 1):
            sums[:live[k + 1]] += vectors[row[start[:live[k + 1]] + k]]
        out[own] = sums
    return out


def passages(batch: pa.RecordBatch, vectors: np.ndarray, idf: np.ndarray, unknown: float):
    """Vector sums of all passages (``vectors`` are weighted by idf), their full
    lengths, the words with weight and their cells, and the cell numbers: a
    passage is a cell and the next one of its document."""
    ids, own, first, n_cells = cells(batch)
    total = int(n_cells.sum())
    heavy = (ids >= 0) & (idf[ids] > 0)                      # stop words have no weight
    word, cell = ids[heavy], own[heavy]
    # one number per (cell, word) with its count
    pairs, count = np.unique(cell * (1 << 32) + word, return_counts=True)
    square = np.bincount(pairs >> 32, (count * idf[pairs & 0xFFFFFFFF]) ** 2, total) + unknown ** 2 * np.bincount(own[ids < 0], minlength=total)
    sums = row_sums(vectors, word, cell, total)
    last = first + n_cells - 1                               # cells that have no next one
    joined, lengths = sums.copy(), square.copy()
    joined[:-1] += sums[1:]
    lengths[:-1] += square[1:]
    joined[last], lengths[last] = sums[last], square[last]
    return joined, np.sqrt(lengths), (word, cell, first, n_cells, ids, own)


def _multiplied(matrix: np.ndarray, idf: np.ndarray, unknown: float):
    """Rows of transpose(A) A ``matrix``, summed over the task."""
    small = np.uint16 if len(matrix) <= 1 << 16 else np.int64     # 16 bits are sorted by counting
    scaled = (matrix * idf[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(matrix.shape, np.float64)
        for batch in batches:
            for piece in slices(batch):
                joined, _, (word, cell, first, *_) = passages(piece, scaled, idf, unknown)
                # a word of cell c is in the passages that begin at c and at c - 1
                back = joined.copy()
                back[1:] += joined[:-1]
                back[first] = joined[first]
                order = np.argsort(word.astype(small), kind="stable")
                held, group = np.unique(word[order], return_inverse=True)
                total[held] += row_sums(back, cell[order], group, len(held))
        total *= idf[:, None]
        rows = np.flatnonzero(np.abs(total).sum(1))
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows.astype(np.int32)), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(rows) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[rows].ravel()))],
                names=["word", "row"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        width = len(batch.column("row")[0]) if batch.num_rows else 0
        rows = batch.column("row").flatten().to_numpy().reshape(-1, width) if width else []
        for w, r in zip(batch.column("word").to_pylist(), rows):
            sums[w] = sums[w] + r if w in sums else r
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))],
                                         names=["word", "row"])


def _gram_times(ids: DataFrame, matrix: np.ndarray, idf: np.ndarray, unknown: float) -> np.ndarray:
    """transpose(A) A matrix over the whole corpus. Each task sends at most one
    row per vocabulary word; the driver gets the vocabulary's rows."""
    parts = in_arrow(ids, _multiplied(matrix, idf, unknown), "word int, row array<double>")
    summed = in_arrow(parts.repartition(16, "word"), _added, "word int, row array<double>")
    out = np.zeros(matrix.shape)
    for r in summed.collect():
        out[r["word"]] = r["row"]
    return out


def latent_axes(ids: DataFrame, idf: np.ndarray, unknown: float, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """The leading right singular vectors of the passage matrix A from one pass:
    with an orthonormal random matrix W and Y = transpose(A) A W, the Nyström
    form Y (transpose(W) Y)^-1 transpose(Y) approximates transpose(A) A, and the
    singular vectors of its square root are the axes."""
    size = len(idf)
    width = min(rank + EXTRA, size)
    start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))
    image = _gram_times(ids, start, idf, unknown)
    shift = 1e-6 * max(np.linalg.norm(image), 1e-12)          # keeps the small factor definite
    image = image + shift * start
    small = start.T @ image
    root = np.linalg.cholesky((small + small.T) / 2 + 1e-9 * shift * np.eye(width))
    half = np.linalg.solve(root, image.T).T
    vectors, values, _ = np.linalg.svd(half, full_matrices=False)
    return vectors[:, : min(rank, int((values ** 2 > 2 * shift).sum()))]


def weights(n: int, held: np.ndarray, items: list[tuple[int, list[int], list[int]]], min_lcs: float) -> tuple[np.ndarray, float, list[bool]]:
    """idf of the words, the weight of an unknown word, and which items are thin.
    Stop words have no weight. An item is thin if a match could consist of its
    stop words alone (as those of an item that a large part of the corpus
    holds): all its words keep their weight."""
    idf = np.log((2.0 + n) / (1.0 + held))
    unknown = float(np.median(idf))
    stop = held > STOP_BASE + STOP_SHARE * n
    thin = [len(ids) - int(stop[ids].sum()) <= (1 - min_lcs) * len(ids) for _, ids, _ in items]
    for (_, ids, _), own in zip(items, thin):
        if own:
            stop[ids] = False
    idf[stop] = 0.0
    return idf, unknown, thin


def gram_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    ids = ids.astype(np.uint64)
    n = max(0, len(ids) - size + 1)
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = (key + ids[k:k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key * np.uint64(0xBF58476D1CE4E5B9)


def gram_index(items: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run length: a table of the keys' first 18 bits, the sorted keys,
    where each key's items begin, and the items."""
    held: dict[int, list[np.ndarray]] = {}
    for q, (_, ids, _) in enumerate(items):
        size = min(GRAM, len(ids))
        own = np.unique(gram_keys(np.array(ids), size))
        held.setdefault(size, []).append(np.stack([own, np.full(len(own), q, np.uint64)]))
    out = []
    for size, parts in held.items():
        keys, owner = np.concatenate(parts, axis=1)
        order = np.argsort(keys, kind="stable")
        keys, begin = np.unique(keys[order], return_index=True)
        table = np.zeros(1 << 18, bool)
        table[keys >> np.uint64(46)] = True
        out.append((size, table, keys, np.append(begin, len(order)), owner[order].astype(np.int64)))
    return out


def gram_hits(index, ids: np.ndarray, own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and items of all runs of words that stand in an item."""
    at, query = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, table, keys, begin, owner in index:
        key = gram_keys(ids, size)
        place = np.flatnonzero(table[key >> np.uint64(46)])
        spot = np.minimum(np.searchsorted(keys, key[place]), len(keys) - 1)
        same = keys[spot] == key[place]
        place, spot = place[same], spot[same]
        one = np.searchsorted(first, own[place], "right") == np.searchsorted(first, own[place + size - 1], "right")
        place, spot = place[one], spot[one]                  # within one document
        n = begin[spot + 1] - begin[spot]
        at.append(np.repeat(own[place], n))
        query.append(owner[np.repeat(begin[spot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
    return np.concatenate(at), np.concatenate(query)


def pieces(ids: list[int]) -> list[list[int]]:
    """The item, or passages of a long one that overlap by a cell and cover it."""
    if len(ids) <= LONG:
        return [ids]
    return [ids[b:b + 2 * CELL] for b in [*range(0, len(ids) - 2 * CELL, CELL), len(ids) - 2 * CELL]]


def _searcher(axes: np.ndarray, idf: np.ndarray, unknown: float, items: list[tuple[int, list[int], list[int]]],
              thin: list[bool], given: list[bool], min_cosine: float, min_lcs: float, min_answer: float):
    holders: list[list[int]] = [[] for _ in idf]             # the items in which a word with weight stands
    heavy = np.zeros(len(items))                             # words with weight in an item
    most = max(int(np.bincount(ids).max()) for _, ids, _ in items)
    times = np.zeros((len(idf), len(items)), np.min_scalar_type(most))   # how often a word stands in an item
    cut, owner = [], []                                      # the queries and their items
    for q, (_, ids, _) in enumerate(items):
        own = np.array(ids)[idf[ids] > 0]
        for w in np.unique(own).tolist():
            holders[w].append(q)
        word, n = np.unique(ids, return_counts=True)
        times[word, q] = n
        heavy[q] = len(own)
        for piece in pieces(ids):
            cut.append(piece)
            owner.append(q)
    held_by = np.array([len(h) for h in holders])
    holder_begin, holder = np.cumsum(held_by) - held_by, np.array([q for h in holders for q in h], np.int64)
    owner = np.array(owner)
    latent, whole = np.zeros((len(cut), axes.shape[1])), np.zeros(len(cut))
    for k, piece in enumerate(cut):
        word, n = np.unique(piece, return_counts=True)
        latent[k] = (n * idf[word]) @ axes[word]
        whole[k] = np.linalg.norm(n * idf[word])
    share_kept = np.linalg.norm(latent, axis=1) / np.maximum(whole, 1e-12)
    latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    scaled = (axes * idf[:, None]).astype(np.float32)
    known = [(item, place_masks(ids), len(ids), place_masks(answer), len(answer), 2.0 if own else MIN_WHOLE)
             for (item, ids, answer), own in zip(items, given)]
    sizes = np.array([len(ids) for _, ids, _ in items])
    # a short item is only a part of the passage that holds it: its cosine is about the root of its share
    lengths_cut = np.array([len(piece) for piece in cut])
    bounds = min_cosine * np.minimum(1.0, np.sqrt(lengths_cut / (2 * CELL)))
    # and still less if its words weigh less than the unknown ones beside it
    beside = unknown ** 2 * np.maximum(0, 2 * CELL - lengths_cut)
    light = min_cosine * whole / np.maximum(np.sqrt(whole ** 2 + beside), 1e-12)
    bounds = np.where(np.array(thin)[owner], np.minimum(bounds, light), bounds).astype(np.float32)
    full_bounds = (bounds * share_kept).astype(np.float32)   # the same against the passage's full length
    reach = -(-sizes // CELL)                                # cells of an item's length
    # words with weight that a match needs at least
    needed = min_lcs * sizes - (sizes - heavy)
    runs = gram_index(items)
    firsts = np.searchsorted(owner, np.arange(len(items)))   # each item's first query
    around = int(reach.max()) + 2                            # cells that a candidate may look at on either side
    step = max(COSINES // len(cut), around)                  # passages compared at once
    small = np.uint16 if len(idf) <= 1 << 16 else np.int64   # 16 bits are sorted by counting

    def held_words(word: np.ndarray, cell: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Row c: how many words of cells lo to lo + c - 1 stand in each item."""
        a, b = np.searchsorted(cell, [lo, hi])
        n = held_by[word[a:b]]
        spot = np.repeat(holder_begin[word[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = np.repeat((cell[a:b] - lo) * len(items), n) + holder[spot]
        out = np.zeros((hi - lo + 1, len(items)), np.int32)
        np.cumsum(np.bincount(key, minlength=(hi - lo) * len(items)).reshape(hi - lo, -1), axis=0, out=out[1:])
        return out

    def covered(ids: np.ndarray, left: np.ndarray, right: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Words of an item that stand among words left to right - 1 at all."""
        known = ids >= 0
        word = ids[known]
        order = np.argsort(word.astype(small), kind="stable")
        before = np.full(len(word), -1)                      # where the word stood last
        again = word[order[1:]] == word[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        place = np.concatenate([[0], np.cumsum(known)])
        left, right = place[left], place[right]
        out = np.zeros(len(query), np.int64)
        for a, b in bounded(right - left, WORDS):
            n = right[a:b] - left[a:b]
            spot = np.repeat(left[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            of = np.repeat(np.arange(b - a), n)
            new = before[spot] < left[a:b][of]               # not again
            spot, of = spot[new], of[new]
            out[a:b] = np.bincount(of, times[word[spot], query[a:b][of]], b - a)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                joined, lengths, (word, cell, first, n_cells, ids, own) = passages(piece, scaled, idf, unknown)
                norms = np.linalg.norm(joined, axis=1)
                some = norms > 0                             # a passage without weight is no candidate
                norms[~some] = 1.0
                more_at, more_query = gram_hits(runs, ids, own, first)
                order = np.argsort(more_at, kind="stable")
                more_at, more_query = more_at[order], more_query[order]
                doc_of = np.repeat(np.arange(len(first)), n_cells)
                n_words = np.diff(piece.column("ids").offsets.to_numpy())
                begins = np.cumsum(n_words) - n_words
                kept = []
                for lo in range(0, len(joined), step):
                    hi = min(lo + step, len(joined))
                    cosines = (joined[lo:hi] / norms[lo:hi, None]) @ latent.T
                    flat = np.flatnonzero(cosines >= bounds)
                    at, query = flat // len(cut), flat % len(cut)
                    near = some[lo + at] & (cosines.ravel()[flat] * norms[lo + at] >= full_bounds[query] * lengths[lo + at])
                    a, b = np.searchsorted(more_at, [lo, hi])
                    at = np.concatenate([lo + at[near], more_at[a:b]])
                    query = np.concatenate([owner[query[near]], more_query[a:b]])
                    if not len(at):
                        continue
                    # how often an item's words stand in the cells around a candidate: an upper bound of the subsequence
                    doc = doc_of[at]
                    left = np.maximum(at - reach[query], first[doc])
                    right = np.minimum(at + 2 + reach[query], first[doc] + n_cells[doc])
                    low, high = max(0, lo - around), min(len(joined), hi + around)
                    held = held_words(word, cell, low, high)
                    enough_held = held[right - low, query] - held[left - low, query] >= needed[query]
                    both = np.unique(at[enough_held] * len(items) + query[enough_held])
                    if len(both):
                        at, query = both // len(items), both % len(items)
                        cosine = np.maximum.reduceat(cosines[at - lo], firsts, axis=1)[np.arange(len(at)), query]
                        kept.append((at, query, cosine))
                if not kept:
                    continue
                at, query, cosine = (np.concatenate(c) for c in zip(*kept))
                doc = doc_of[at]
                begin = begins[doc] + CELL * (at - first[doc])
                left = np.maximum(begins[doc], begin - sizes[query])
                right = np.minimum(begins[doc] + n_words[doc], begin + 2 * CELL + sizes[query])
                likely = covered(ids, left, right, query) >= min_lcs * sizes[query]      # else too few of the item's words at all
                out: dict[tuple[int, int], tuple[float, float]] = {}
                for q, d, c, a, b, may in zip(query.tolist(), doc.tolist(), cosine.tolist(), left.tolist(), right.tolist(), likely.tolist()):
                    item, masks, length, answer, answer_length, enough = known[q]
                    if out.get((d, item), (0.0, 0.0))[0] == 1.0:
                        out[d, item] = 1.0, max(out[d, item][1], c)   # the whole item is found already
                        continue
                    if not may:
                        continue
                    region = ids[a:b].tolist()
                    share = lcs(masks, length, region) / length
                    if share >= min_lcs and (not answer_length or share >= enough or lcs(answer, answer_length, region) >= min_answer * answer_length):
                        old = out.get((d, item), (0.0, 0.0))
                        out[d, item] = max(old[0], share), max(old[1], c)
                if out:
                    take = pa.array([d for d, _ in out])
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id").take(take), piece.column("text_hash").take(take),
                         pa.array([i for _, i in out], pa.int64()), pa.array([s for s, _ in out.values()], pa.float64()),
                         pa.array([c for _, c in out.values()], pa.float64())],
                        names=["doc_id", "text_hash", "item_id", "lcs", "cosine"])
    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, min_cosine: float = MIN_COSINE,
                 min_lcs: float = MIN_LCS, min_answer: float = MIN_ANSWER) -> DataFrame:
    """``doc_id, text_hash, item_id, lcs, cosine`` of every verified match of an
    item of ``benchmark(item_id, text[, answer])`` in ``docs(doc_id, text)``.

    Null and empty texts match nothing, on either side; repeated rows match
    alike (one row per row); an empty table gives none; further columns are
    ignored. ``item_id`` may have any type, be null or repeat: it only names the
    items, and a document that holds an item without a name holds an item. Items are the stated query set and are taken in blocks of about
    ``ITEM_BLOCK`` items or pieces of long ones, so vocabulary, broadcast model and driver stay bounded for
    any benchmark; all passages of all documents are searched.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    has_answer = "answer" in benchmark.columns
    name = benchmark.schema["item_id"].dataType
    rows = benchmark.where("text is not null").select(
        "item_id", "text", F.col("answer") if has_answer else F.lit(None).cast("string").alias("answer"))
    schema = f"doc_id {kind}, text_hash long, item_id long, lcs double, cosine double"          # items by number
    found = spark.createDataFrame([], f"doc_id {kind}, text_hash long, item_id {name.simpleString()}, lcs double, cosine double")
    size = F.size(F.split("text", r"\s+"))
    count = rows.agg(F.sum(F.when(size > LONG, F.ceil(size / CELL)).otherwise(1)).alias("n")).first()["n"] or 0   # queries
    n_blocks = -(-count // ITEM_BLOCK)
    for block in range(n_blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()   # one block of items
        vocabulary: dict[bytes, int] = {}
        items, given, names = [], [], []                     # given: the answer is beside the text
        for r in sorted(own, key=lambda r: (r["item_id"] is None, str(r["item_id"]), r["text"])):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(r["text"])]
            answer = [vocabulary.setdefault(w, len(vocabulary)) for w in answer_of(r["text"], r["answer"])]
            if ids:
                items.append((len(names), ids, answer))
                names.append((len(names), r["item_id"]))
                given.append(bool(r["answer"]))
        if not items:
            continue
        ids = stash(in_arrow(keyed, _numbered(vocabulary), f"doc_id {kind}, text_hash long, ids array<int>"), "passages")
        seen = {r["word"]: r["n"] for r in in_arrow(ids.select("ids"), _frequencies, "word int, n long")
                .groupBy("word").agg(F.sum("n").alias("n")).collect()}                          # the vocabulary's counts
        n = seen.pop(-1, 0)
        held = np.array([seen.get(w, 0) for w in range(len(vocabulary))])
        idf, unknown, thin = weights(n, held, items, min_lcs)
        axes = latent_axes(ids.select("ids"), idf, unknown, rank)
        hits = in_arrow(ids, _searcher(axes, idf, unknown, items, thin, given, min_cosine, min_lcs, min_answer), schema)
        known = spark.createDataFrame(names, StructType([StructField("_number", LongType()), StructField("_name", name)]))
        found = found.unionByName(hits.join(F.broadcast(known), hits["item_id"] == known["_number"]).select(  # one block's items
            "doc_id", "text_hash", F.col("_name").alias("item_id"), "lcs", "cosine"))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item was found."""
    hits = stash(find_matches(docs, benchmark).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct(), "leaks")
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_i"]) & (F.xxhash64(docs["text"]) == hits["_h"]), "leftanti")


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: whether and which items were found."""
    hits = find_matches(docs.select("doc_id", "text"), benchmark)
    per = stash(hits.groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("lcs").alias("best_lcs")), "leaks")   # items of one text
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_k"))
    joined = keyed.join(per, keyed["doc_id"].eqNullSafe(per["_i"]) & (keyed["_k"] == per["_h"]), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                         F.coalesce("items", F.array().cast(per.schema["items"].dataType)).alias("items"),
                         F.coalesce("best_lcs", F.lit(0.0)).alias("best_lcs"))
