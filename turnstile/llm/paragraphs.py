"""Paragraph near-duplicates by MinHash banding.

A paragraph is a line of five words or more, or a run of neighbouring shorter
lines that has as many. Each distinct paragraph gets a MinHash signature over its
five-word shingles, cut into bands whose number and height are tuned so that a
pair at the threshold is missed with a chosen small probability. Paragraphs
that collide in a band are verified by exact Jaccard similarity: first every
member of a bucket against the bucket's leader, the member that collides most;
then only what is still apart, and only where enough shingles are shared with
other components to allow a link. Components of the verified links are the
classes, and all but the first paragraph of a class are removed.

A passage can also lie inside longer lines or be wrapped over short ones, where
no whole paragraph repeats. Paragraphs are therefore cut once more at points
that only the nearby words decide, and neighbouring pieces that also occur
elsewhere make a run, over line ends too; a run that is long enough is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, in_arrow, spread, stash

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-3                    # chance to miss a pair exactly at the threshold
ROWS_PER_BAND = 3
REMOVE_WORDS = 20              # shorter repeats (headings, licence lines) are classed but stay
CUT_WINDOW = 4                 # a cut is the least of the word pairs so far to either side
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20          # a longer text is a batch of its own

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(threshold: float = THRESHOLD, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """The least number of bands of ``rows`` values that misses a pair at the
    threshold with probability ``miss`` at most."""
    bands = 1
    while (1 - threshold ** rows) ** bands > miss:
        bands += 1
    return bands


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_paragraphs(text: str) -> list[tuple[int, int, list[bytes]]]:
    """First and last line number and words (A-Z lowered) of every paragraph: a
    line with a whole shingle, or neighbouring shorter lines that have one."""
    out, short, first, last = [], [], 0, 0
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")):
        words = line.split()
        if len(words) >= SHINGLE:
            if len(short) >= SHINGLE:
                out.append((first, last, short))
            short = []
            out.append((i, i, words))
        elif words:
            if not short:
                first = i
            short, last = short + words, i
    if len(short) >= SHINGLE:
        out.append((first, last, short))
    return out


def _word_hashes(paras: list[list[bytes]], known: dict[bytes, int]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    for words in paras:
        for w in words:
            if w not in known:
                known[w] = xxh64_intdigest(w, 1)
    return np.fromiter((known[w] for words in paras for w in words), np.uint64, sum(map(len, paras)))


def cut_pieces(paras: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of all paragraphs begin among all words, and their
    hashes. A cut falls before a word whose pair with its predecessor hashes
    below those of the ``CUT_WINDOW`` words to either side, so equal passages are
    cut alike wherever they stand; every piece has a shingle at least."""
    flat = _word_hashes(paras, {})
    sizes = np.array([len(w) for w in paras], np.int64)
    begins = np.cumsum(sizes) - sizes
    pair = flat.copy()
    pair[1:] = mix(flat[:-1] * _STEP + flat[1:])
    top = np.iinfo(np.uint64).max
    pair[begins] = top
    place = np.arange(len(flat)) + np.repeat((np.arange(len(sizes)) + 1) * CUT_WINDOW, sizes)
    wide = np.full(len(flat) + (len(sizes) + 1) * CUT_WINDOW, top, np.uint64)
    wide[place] = pair
    cut = np.ones(len(flat), bool)
    for k in range(1, CUT_WINDOW + 1):
        cut &= (pair < wide[place - k]) & (pair <= wide[place + k])
    within = np.arange(len(flat)) - np.repeat(begins, sizes)
    cut &= (within >= SHINGLE) & (np.repeat(sizes, sizes) - within >= SHINGLE)
    cut[begins] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, len(flat)))
    offset = (np.arange(len(flat)) - np.repeat(starts, lengths)).astype(np.uint64)
    sums = np.add.reduceat(mix(flat + (offset + np.uint64(1)) * _STEP), starts)
    return starts, mix(sums + lengths.astype(np.uint64) * _STEP)


def shingle_hashes(paras: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all paragraphs and where each paragraph begins."""
    sizes = np.array([len(w) for w in paras], np.int64)
    flat = _word_hashes(paras, {})
    total = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total = mix(total * _STEP + flat[k:len(flat) - SHINGLE + 1 + k])
    counts = sizes - SHINGLE + 1
    begins = np.cumsum(sizes) - sizes
    firsts = np.cumsum(counts) - counts
    take = np.repeat(begins - firsts, counts) + np.arange(int(counts.sum()))
    return total[take], firsts


def band_keys(hashes: np.ndarray, firsts: np.ndarray, bands: int, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One key per paragraph and band."""
    keys = np.zeros((len(firsts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(firsts), b + 1, np.uint64)
        for r in range(rows):
            seed = mix(np.array([b * rows + r + 1], np.uint64) * _STEP)
            key = mix(key * _STEP + np.minimum.reduceat(mix(hashes ^ seed), firsts))
        keys[:, b] = key
    return keys


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of rows and bytes of text (or one text)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = min(lo + BATCH_ROWS, max(lo + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _paragraph_ids(paras: list[list[bytes]]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    return np.array([xxh64_intdigest(b" ".join(w), 42) for w in paras], np.uint64).view(np.int64)


def _liner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per paragraph with its pieces (hash, first word, words, number in the document)."""
    for batch in batches:
        for piece in _slices(batch):
            owner, first, last, paras = [], [], [], []
            for o, t in enumerate(piece.column("text").to_pylist()):
                for lo, hi, words in split_paragraphs(t or ""):
                    owner.append(o)
                    first.append(lo)
                    last.append(hi)
                    paras.append(words)
            if not paras:
                continue
            starts, hashes = cut_pieces(paras)
            sizes = np.array([len(w) for w in paras], np.int64)
            begins = np.cumsum(sizes) - sizes
            bounds = np.searchsorted(starts, begins)                 # first piece of each paragraph
            para_of = np.searchsorted(begins, starts, "right") - 1
            owners = np.array(owner)
            firsts = bounds[np.searchsorted(owners, owners)]         # first piece of each document
            number = np.arange(len(starts)) - firsts[para_of]
            pieces = pa.StructArray.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array((starts - begins[para_of]).astype(np.int32)),
                 pa.array(np.diff(np.append(starts, sizes.sum())).astype(np.int32)), pa.array(number.astype(np.int32))],
                names=["piece", "at", "n", "number"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(bounds, len(starts)).astype(np.int32)), pieces)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(take), piece.column("text_hash").take(take), pa.array(first, pa.int32()),
                 pa.array(last, pa.int32()), pa.array(sizes.astype(np.int32)), pa.array(_paragraph_ids(paras)), lists],
                names=["doc_id", "text_hash", "line", "last_line", "n_words", "para", "pieces"])


def _signer(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                paras = [words for t in piece.column("text").to_pylist() for _, _, words in split_paragraphs(t or "")]
                if not paras:
                    continue
                ids, first = np.unique(_paragraph_ids(paras), return_index=True)
                keys = band_keys(*shingle_hashes([paras[i] for i in first.tolist()]), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands),
                                                 pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["para", "bands"])
    return run


def _shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingle hashes of the wanted paragraphs of each text."""
    for batch in batches:
        for piece in _slices(batch):
            wanted = piece.column("lines").to_pylist()
            texts = piece.column("text").to_pylist()
            paras = [words for t, lines in zip(texts, wanted) for own in [set(lines)]
                     for i, _, words in split_paragraphs(t or "") if i in own]
            if not paras:
                continue
            hashes, firsts = shingle_hashes(paras)
            sets = [np.unique(h).view(np.int64) for h in np.split(hashes, firsts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(_paragraph_ids(paras)), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["para", "shingles"])


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those whose key holds another paragraph."""
    held = np.zeros((0, 2), np.int64)

    def shared(rows: np.ndarray) -> np.ndarray:
        same = rows[1:, 0] == rows[:-1, 0]
        return rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(rows) else rows

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["key", "para"])

    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column("key").to_numpy(), batch.column("para").to_numpy()], 1)])
        change = np.flatnonzero(held[1:, 0] != held[:-1, 0])
        cut = int(change[-1]) + 1 if len(change) else 0
        if not cut and len(held) > 2:                    # one key goes on: all but its last row are known to be shared
            yield out(held[:-2])
            held = held[-2:]
            continue
        yield out(shared(held[:cut]))
        held = held[cut:]
    yield out(shared(held))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs(a, b)`` with ``sim`` (exact Jaccard) and ``ok``."""
    left = sets.select(F.col("para").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("para").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    sim = both / (F.size("x") + F.size("y") - both)
    return (pairs.join(left, "a").join(right, "b").select("a", "b", sim.alias("sim"))
            .withColumn("ok", F.col("sim") >= threshold))


def _labelled(members: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    labels = components(edges, name)
    return members.join(labels, members["para"] == labels["node"], "left").withColumn(
        "comp", F.coalesce("label", "para")).drop("node", "label")


def _foreign(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``(para, v)``: shingles of each paragraph that a paragraph of another
    component has too. No link to another component can share more."""
    own = stash(sets.join(rest.select("para", "comp").distinct(), "para").select(
        "para", "comp", F.explode("shingles").alias("s")), "para-shingles")
    ends = own.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("s")
    return own.join(ends, "s").groupBy("para").agg(F.count("*").alias("v"))


def links(buckets: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links ``(a, b)`` that connect every class: ``buckets(key, para)``
    are the colliding paragraphs, ``sets(para, shingles)`` their shingles.

    The leader of a bucket is the member that shares most buckets with most
    others: the original of a group of near copies rather than one of its outer variants.
    After the leaders' round a link can only be missing between two
    components, so it shares no more shingles than either side has in common
    with other components; variants whose edits are their own drop out by
    that bound, before any pair is made.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("c"))
    known = buckets.join(sizes, "key").groupBy("para").agg(F.sum("c").alias("met"))
    leaders = buckets.join(known, "para").groupBy("key").agg(F.max(F.struct("met", "para"))["para"].alias("lead"))
    led = buckets.join(leaders, "key")
    pair = (F.least("lead", "para").alias("a"), F.greatest("lead", "para").alias("b"))
    checked = stash(_verified(led.where("para <> lead").select(*pair).distinct(), sets, threshold), "para-pairs")
    found = checked.where("ok").select("a", "b")
    # what is still apart in a bucket: sizes within the threshold, distances to the leader that
    # differ by no more than a link allows, and enough shingles shared with other components
    members = stash(_labelled(led, found, "para-links"), "para-members")
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    apart = stash(members.join(mixed, "key"), "para-apart")
    slack = 1e-9
    counts = sets.select("para", F.size("shingles").alias("n")).join(_foreign(apart, sets), "para").where(
        F.col("v") >= threshold * F.col("n") - slack)
    rest = stash(apart.join(counts, "para").select("key", "para", "comp", "n", "v", *pair)
                 .join(checked.select("a", "b", "sim"), ["a", "b"], "left")
                 .withColumn("sim", F.coalesce("sim", F.lit(1.0))).select("key", "para", "comp", "n", "v", "sim"), "para-rest")
    x, y = rest.alias("x"), rest.alias("y")
    close = ((F.col("x.para") < F.col("y.para")) & (F.col("x.comp") != F.col("y.comp"))
             & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - slack)
             & (F.least("x.v", "y.v") >= threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - slack)
             & (F.abs(F.col("x.sim") - F.col("y.sim")) <= 1 - threshold + slack))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & close).select(
        F.col("x.para").alias("a"), F.col("y.para").alias("b")).distinct()
    return found.unionByName(_verified(pairs, sets, threshold).where("ok").select("a", "b"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def read_paragraphs(docs: DataFrame) -> DataFrame:
    """One written row per paragraph: ``doc_id``, ``text_hash``, ``line``,
    ``last_line``, ``n_words``, ``para`` (hash of its words), ``pieces``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stash(in_arrow(_keyed(docs), _liner, f"doc_id {kind}, text_hash long, line int, last_line int, n_words int, "
                          "para long, pieces array<struct<piece:long,at:int,n:int,number:int>>"), "paragraphs")


def classify(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, rows: DataFrame | None = None) -> DataFrame:
    """One row per paragraph: ``doc_id``, ``text_hash``,
    ``line``, ``last_line``, ``n_words``, ``class`` (a long), ``class_id`` (doc_id of the class's first
    paragraph), ``class_size`` (paragraphs), ``first``. ``rows`` are the
    paragraphs of ``docs`` where they have been read already.

    Null and empty texts have no paragraphs; rows equal in id and text are one
    document and are judged alike; null ids come first; further columns are ignored. Equal paragraphs are one
    node, so thousands of copies cost no more than one.
    """
    keyed = _keyed(docs)
    bands = tune_bands(threshold, ROWS_PER_BAND, miss)
    rows = read_paragraphs(docs) if rows is None else rows
    place = F.struct("doc_id", "text_hash", "line")
    nodes = rows.groupBy("para").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    signed = in_arrow(keyed.select("text"), _signer(bands), "para long, bands array<long>").groupBy("para").agg(
        F.first("bands").alias("bands"))
    dealt = (signed.select(F.explode("bands").alias("key"), "para").repartition(spread(docs), "key")
             .sortWithinPartitions("key", "para"))
    buckets = stash(in_arrow(dealt, _collisions, "key long, para long"), "para-buckets")
    nodes = stash(nodes, "para-nodes")
    wanted = buckets.select("para").distinct().join(nodes.select("para", "at"), "para")
    lines = wanted.groupBy(F.col("at.doc_id").alias("_i"), F.col("at.text_hash").alias("_h")).agg(
        F.collect_set("at.line").alias("lines"))                    # paragraphs of one text
    texts = keyed.join(lines, keyed["doc_id"].eqNullSafe(lines["_i"]) & (keyed["text_hash"] == lines["_h"]))
    found = in_arrow(texts.select("text", "lines"), _shingler, "para long, shingles array<long>")
    sets = stash(found.dropDuplicates(["para"]), "para-sets")
    labels = components(links(buckets, sets, threshold), "para-classes")
    named = nodes.join(labels, nodes["para"] == labels["node"], "left").select(
        "para", "at", "n", F.coalesce("label", "para").alias("class"))
    whole = named.groupBy("class").agg(F.min("at").alias("low"), F.sum("n").alias("class_size"))
    known = stash(named.join(whole, "class").select("para", "class", "low", "class_size"), "para-known")
    return rows.join(known, "para").select(
        "doc_id", "text_hash", "line", "last_line", "n_words", "class", F.col("low.doc_id").alias("class_id"), "class_size",
        (place == F.col("low")).alias("first"))


def repeated_runs(rows: DataFrame, least_words: int = REMOVE_WORDS) -> DataFrame:
    """Paragraphs (``doc_id``, ``text_hash``, ``line``) with pieces in a repeat:
    ``cut_words`` and ``spans`` (line:first word:end) of the pieces that also
    stand earlier (smaller doc_id, or earlier in the document). A repeat is a run of
    neighbouring pieces of a document, over line ends too, that all occur
    elsewhere and have ``least_words`` words together. ``rows`` are of
    ``read_paragraphs``; equal rows are one document."""
    pieces = rows.select("doc_id", "text_hash", "line", F.inline("pieces"))
    often = pieces.groupBy("piece").agg(F.count("*").alias("c")).where("c > 1").select("piece")
    again = stash(pieces.join(often, "piece").distinct(), "para-again")
    place = F.struct("doc_id", "text_hash", "number")
    ends = again.groupBy("piece").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    found = again.join(ends.select("piece", "low"), "piece").withColumn("later", place != F.col("low"))
    whole = Window.partitionBy("doc_id", "text_hash")                # no more rows than a text has pieces
    runs = found.withColumn("run", F.col("number") - F.row_number().over(whole.orderBy("number")))
    long = runs.withColumn("words", F.sum("n").over(Window.partitionBy("doc_id", "text_hash", "run"))).where(
        F.col("words") >= least_words)
    span = F.struct("at", F.concat_ws(":", "line", "at", F.col("at") + F.col("n")).alias("span"))
    return long.groupBy("doc_id", "text_hash", "line").agg(
        F.sum(F.when(F.col("later"), F.col("n")).otherwise(0)).cast("int").alias("cut_words"),
        F.array_sort(F.collect_list(F.when(F.col("later"), span)))["span"].alias("spans"))


def removals(classified: DataFrame, remove_words: int = REMOVE_WORDS) -> Column:
    """Whether a paragraph goes: not the first of its class and long enough."""
    return ~F.col("first") & (F.col("class_size") > 1) & (F.col("n_words") >= remove_words)


def summarise(docs: DataFrame, classified: DataFrame, runs: DataFrame, remove_words: int = REMOVE_WORDS) -> DataFrame:
    """One row per document: ``n_paragraphs``; ``n_dup``, those that hold a
    repeat of ``remove_words`` words (whole paragraph or run of pieces, first
    occurrences included); ``n_removed``, those that lose words; their
    ``removed_words``; ``removed_lines``, the lines that go as a whole;
    ``removed_spans``, the pieces that go from other paragraphs; the class ids."""
    shared = (F.col("class_size") > 1) & (F.col("n_words") >= remove_words)
    key = ["doc_id", "text_hash", "line"]
    judged = classified.select(*key, "last_line", "n_words", shared.alias("shared"), removals(classified, remove_words).alias("gone"),
                               F.when(F.col("class_size") > 1, F.col("class_id")).alias("class_id"))
    both = judged.unionByName(runs.withColumn("hit", F.lit(True)), allowMissingColumns=True)
    flagged = both.groupBy(*key).agg(*[F.max(c).alias(c) for c in both.columns if c not in key])
    cut = F.coalesce("cut_words", F.lit(0))
    flagged = flagged.withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn(
        "lost", F.when(F.col("gone"), F.col("n_words")).otherwise(cut))
    per = flagged.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_paragraphs"), F.sum((F.col("shared") | F.col("hit")).cast("long")).alias("n_dup"),
        F.sum((F.col("lost") > 0).cast("long")).alias("n_removed"), F.sum("lost").cast("long").alias("removed_words"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("gone"), F.sequence("line", "last_line"))))).alias("removed_lines"),
        F.flatten(F.array_sort(F.collect_list(F.when(~F.col("gone") & (cut > 0), F.struct("line", "spans"))))["spans"]
                  ).alias("removed_spans"),
        F.array_sort(F.collect_set("class_id")).alias("class_ids"))
    per = per.withColumnsRenamed({"doc_id": "_i", "text_hash": "_h"})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_k"))
    joined = keyed.join(per, keyed["doc_id"].eqNullSafe(per["_i"]) & (keyed["_k"] == per["_h"]), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_paragraphs", "n_dup", "n_removed", "removed_words")],
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce("removed_spans", F.array().cast("array<string>")).alias("removed_spans"),
        F.coalesce("class_ids", F.array().cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")).alias("class_ids"))


def contract(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    rows = read_paragraphs(docs)
    return summarise(docs, classify(docs, rows=rows), repeated_runs(rows))
