"""Operators over the whole corpus: sharding, decontamination, near-duplicates,
repeats, mixing, preference pairs."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import EDGE, SF, corpus, oracle, same

from turnstile.llm import decontam, mixing, paragraphs, preference, runindex, sharding, simhash
from turnstile.llm.common import components


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- components ---------------------------------------------------------------

def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5001 + i) for i in range(300)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {r.node: r.label for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


# --- sharding -----------------------------------------------------------------

def ring_brute(keys, n_shards, factor=1.0):
    """Keys inserted one by one in ring order."""
    spots = sharding.ring(n_shards)
    room = sharding.capacities(len(keys), n_shards, factor)
    def position(k):
        return int(hashlib.md5(str("null" if k is None else k).encode()).hexdigest()[:15], 16)
    out, used = {}, Counter()
    for k in sorted(keys, key=lambda k: (position(k) % sharding.CELLS, position(k))):
        cell = position(k) % sharding.CELLS
        i = next((i for i, (c, _) in enumerate(spots) if c >= cell), 0)
        while used[spots[i][1]] >= room[spots[i][1]]:
            i = (i + 1) % len(spots)
        out.setdefault(k, []).append((spots[i][1], used[spots[i][1]]))
        used[spots[i][1]] += 1
    return out


@pytest.mark.parametrize("factor", [1.0, 1.1])
def test_sharding_equals_one_by_one_insertion(spark, factor):
    keys = list(range(700))
    got = sharding.assign_shards(corpus(spark, [(k, "t") for k in keys]), 40, load_factor=factor)
    assert {r.doc_id: [(r.shard, r.slot)] for r in got.collect()} == ring_brute(keys, 40, factor)


def test_sharding_law_and_edges(spark):
    rows = sharding.contract(docs(spark)).collect()
    loads = Counter(r.shard for r in rows)
    assert max(loads.values()) - min(loads.values()) <= 1
    for s in loads:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(loads[s]))
    edge = sharding.contract(corpus(spark, EDGE))
    assert edge.count() == len(EDGE) and edge.where("size = 16 and text_crc32 = 0").count() == 3
    whole = sharding.assign_shards(corpus(spark, EDGE), 3)
    assert whole.columns.count("shard") == 1 and "odd name" in whole.columns
    assert sharding.assign_shards(corpus(spark, []), 3).count() == 0


def test_sharding_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_FACTOR", 1)
    rows = [(7, "same")] * 900 + [(k, "t") for k in range(100, 700)]
    got = sharding.assign_shards(corpus(spark, rows).repartition(5), 8).collect()
    assert len({(r.shard, r.slot) for r in got}) == 1500
    loads = Counter(r.shard for r in got)
    assert set(loads.values()) <= {187, 188}


def test_adding_a_shard_moves_few_rows_when_there_is_slack():
    counts = Counter(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) % sharding.CELLS for k in range(20000))
    def owners(n):
        return {(c, r): s for c, first, s, _ in sharding.fill(counts, n, 1.25) for r in range(first, counts[c])}
    before, after = owners(40), owners(41)
    assert sum(before[k] != after[k] for k in before) / len(before) < 0.2


# --- mixing -------------------------------------------------------------------

def test_mixing_equals_sql(spark):
    assert same(mixing.contract(docs(spark)), oracle(mixing.ORACLE))


def test_mixing_caps_and_edges(spark):
    rows = EDGE + [(100 + i, "one two three four", "tiny") for i in range(3)] + [(200 + i, "w " * 400, None) for i in range(9)]
    planned = mixing.plan_copies(corpus(spark, rows))
    got = planned.collect()
    assert len(got) == len(rows) and planned.columns.count("size") == 1 and planned.columns.count("copies") == 1
    assert all(0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-6 for r in got)
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - sum({r.source: r.source_size for r in got}.values())) < 1e-6 * sum(targets.values())
    assert {r.copies for r in got if r.source == "tiny"} == {3}
    copied = mixing.emit(planned, ["doc_id", "odd name"])
    assert copied.count() == sum(r.copies for r in got)
    assert mixing.contract(corpus(spark, [])).count() == 0
    again = mixing.plan_copies(corpus(spark, rows).repartition(7)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in again) == sorted((str(r.doc_id), r.copies) for r in got)


# --- SimHash ------------------------------------------------------------------

def simhash_brute(rows):
    from xxhash import xxh64_intdigest
    prints = {}
    for i, t in rows:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        grams = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids, low = sorted(prints), {}
    for i in ids:
        if i in low:
            continue
        low[i], todo = i, [i]
        while todo:
            u = todo.pop()
            for v in ids:
                if v not in low and (prints[u] ^ prints[v]).bit_count() <= 4:
                    low[v] = i
                    todo.append(v)
    return {i: (f"{prints[i]:016x}", low[i]) for i in ids}


def test_simhash_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "Two words"), (10_004, "two Words"), (10_005, "a b c d")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.contract(corpus(spark, rows)).collect()}
    assert got == simhash_brute(rows)


def test_simhash_edges_and_one_of_each_class(spark):
    found = simhash.near_duplicates(corpus(spark, EDGE))
    assert found.count() == len(EDGE)
    kept = simhash.keep_one(corpus(spark, EDGE))
    assert kept.columns == corpus(spark, EDGE).columns
    assert kept.count() == found.select("component").distinct().count()
    assert simhash.contract(corpus(spark, [])).count() == 0


def test_large_buckets_are_divided_without_loss(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(1200)], np.uint64)
    prints = np.unique(base[rng.integers(0, 40, 1200)] ^ flips)
    table = simhash.distance_table(prints, simhash.pivots())
    def groups(stars):
        parent = {int(p): int(p) for p in prints}
        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for members, leaders in stars:
            for m, l in zip(members.tolist(), leaders.tolist()):
                a, b = find(int(m)), find(int(l))
                parent[max(a, b)] = min(a, b)
        return {p: find(p) for p in parent}
    whole = groups(simhash.links(prints, table, 4, 0))
    monkeypatch.setattr(simhash, "LARGE", 50)
    assert groups(simhash.links(prints, table, 4, 0)) == whole


def test_pivot_test_never_discards_a_link():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(x) for x in rng.choice(64, 4, replace=False)) for _ in range(500)], np.uint64)
    refs = simhash.pivots()
    gap = np.abs(simhash.distance_table(a, refs) - simhash.distance_table(b, refs)).max(1)
    assert gap.max() <= 4


# --- paragraphs ---------------------------------------------------------------

def paragraph_brute(rows):
    paras = {}
    for i, t in rows:
        for line, _, words in paragraphs.split_paragraphs(t or ""):
            paras[i, line] = (b" ".join(words), {tuple(words[k:k + 5]) for k in range(len(words) - 4)}, len(words))
    ids, low = sorted(paras), {}
    for i in ids:
        if i in low:
            continue
        low[i], todo = i, [i]
        while todo:
            u = todo.pop()
            for v in ids:
                if v not in low and len(paras[u][1] & paras[v][1]) >= 0.8 * len(paras[u][1] | paras[v][1]):
                    low[v] = i
                    todo.append(v)
    return paras, low


def run_brute(rows, least=paragraphs.REMOVE_WORDS):
    """Words lost to repeated runs of pieces and whether a run is there, by (doc_id, line)."""
    pieces, seen = {}, {}
    for i, t in rows:
        for line, _, words in paragraphs.split_paragraphs(t or ""):
            starts = paragraphs.cut_pieces([words])[0].tolist() + [len(words)]
            for a, b in zip(starts, starts[1:]):
                pieces.setdefault(i, []).append((line, tuple(words[a:b])))
    for i in sorted(pieces):
        for k, (_, words) in enumerate(pieces[i]):
            seen.setdefault(words, []).append((i, k))
    lost, hit = Counter(), set()
    for i, own in pieces.items():
        run = []
        for k, (line, words) in enumerate(own + [(None, None)]):
            if words is not None and len(seen[words]) > 1:
                run.append((line, words, seen[words][0] != (i, k)))
                continue
            if sum(len(w) for _, w, _ in run) >= least:
                for at, w, later in run:
                    hit.add((i, at))
                    lost[i, at] += len(w) * later
            run = []
    return lost, hit


def test_paragraph_classes_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 4)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 30)}"
            lines.append(" ".join(words))
            if rng.random() < 0.3:
                lines.append(rng.choice(["All rights reserved.", "A heading of five words", ""]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "short one")]
    paras, low = paragraph_brute(rows)
    size = Counter(low.values())
    got = {r.doc_id: r for r in paragraphs.contract(corpus(spark, rows)).collect()}
    assert len(got) == len(rows)
    lost, hit = run_brute(rows)
    for i, _ in rows:
        own = [k for k in paras if k[0] == i]
        long = {k for k in own if paras[k][2] >= paragraphs.REMOVE_WORDS}
        gone = {k for k in long if low[k] != k}
        assert got[i].n_paragraphs == len(own)
        assert got[i].n_dup == sum((k in long and size[low[k]] > 1) or k in hit for k in own)
        assert got[i].removed_lines == sorted(k[1] for k in gone)
        assert got[i].n_removed == sum(k in gone or lost[k] > 0 for k in own)
        assert got[i].removed_words == sum(paras[k][2] if k in gone else lost[k] for k in own)
        spans = [tuple(map(int, x.split(":"))) for x in got[i].removed_spans]
        assert sum(b - a for _, a, b in spans) == sum(lost[k] for k in own if k not in gone) and spans == sorted(spans)
        assert got[i].class_ids == sorted({low[k][0] for k in own if size[low[k]] > 1})


def test_paragraph_links_in_a_group_of_near_copies(spark):
    """A leader at the rim, variants with own edits, and a second group that shares its edits."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(60)] = f"own{i}x{rng.randrange(99)}"
        if i % 5 == 0:
            words[10:40:6] = [f"shared{k}" for k in range(5)]
        rows.append((i, " ".join(words)))
    paras, low = paragraph_brute(rows)
    got = {r.doc_id: r.class_id for r in paragraphs.classify(corpus(spark, rows)).collect()}
    assert got == {k[0]: v[0] for k, v in low.items()} and 5 < len(set(got.values())) < 150


def test_passages_inside_lines_and_over_lines(spark):
    rng = random.Random(6)
    def fresh(n):
        return [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    passages = [fresh(rng.randint(51, 80)) for _ in range(12)]
    rows, planted = [], {}
    def form(j, words):
        if j == 0:
            return " ".join(fresh(rng.randint(3, 60)) + words + fresh(rng.randint(3, 60)))
        if j == 1:
            return " ".join(fresh(40) + words[:25]) + "\n" + " ".join(words[25:] + fresh(50))
        width = 12 if j == 2 else 3
        return "\n".join(" ".join(words[x:x + width]) for x in range(0, len(words), width))
    for k, words in enumerate(passages):
        for j in ((0, 0, 0) if k % 2 else (0, 1, 0)) + (2, 2, 3, 3):
            planted[len(rows)] = k
            rows.append((len(rows), "\n".join([" ".join(fresh(40)), form(j, words), " ".join(fresh(30))])))
    rows += [(1000 + i, "\n".join([" ".join(fresh(50)), "all rights are reserved here", "see the list below now"])) for i in range(30)]
    got = {r.doc_id: r for r in paragraphs.contract(corpus(spark, rows)).collect()}
    assert np.mean([got[i].n_dup > 0 for i in planted]) > 0.95
    later = [i for i, k in planted.items() if k in [planted[j] for j in range(i) if j in planted]]
    assert np.mean([got[i].n_removed > 0 for i in later]) > 0.75          # other forms are cut at other line ends
    assert not any(got[i].n_dup or got[i].n_removed for i in got if i >= 1000)
    assert all(got[i].removed_words <= len(passages[k]) / 0.8 for i, k in planted.items())  # a whole line may go at 0.8


def test_pieces_are_cut_by_nearby_words():
    rng = random.Random(7)
    words = [f"w{rng.randrange(3000)}".encode() for _ in range(400)]
    whole = set(paragraphs.cut_pieces([words])[0].tolist())
    part = {int(x) + 100 for x in paragraphs.cut_pieces([words[100:300]])[0]}
    inner = set(range(100 + 10, 300 - 10))
    assert whole & inner == part & inner and len(part) > 12
    starts, hashes = paragraphs.cut_pieces([words[:7], words, words])
    assert starts[0] == 0 and starts[1] == 7 and np.diff(starts).min() >= paragraphs.SHINGLE
    assert (hashes[1:1 + len(whole)] == hashes[1 + len(whole):]).all()
    assert len(paragraphs.cut_pieces([[b"a"] * 100])[0]) == 1


def test_paragraph_edges_and_tuning(spark):
    rows = paragraphs.contract(corpus(spark, EDGE))
    assert rows.count() == len(EDGE)
    assert paragraphs.contract(corpus(spark, [])).count() == 0
    assert (1 - 0.8 ** 3) ** paragraphs.tune_bands() <= 1e-3 < (1 - 0.8 ** 3) ** (paragraphs.tune_bands() - 1)


# --- exact repeats ------------------------------------------------------------

def repeats_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for a in range(len(b) - 99):
            if b[a:a + 100] in seen:
                m[a:a + 100] = True
            seen.add(b[a:a + 100])
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out[i] = (len(b), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(120):
        t = rng.choice(base)[rng.randint(0, 150):rng.randint(200, 400)]
        if rng.random() < 0.5:
            p = rng.randint(0, len(t))
            t = t[:p] + rng.choice("xyz") + t[p:]
        if rng.random() < 0.3:
            t += rng.choice(base)[50:rng.randint(60, 300)]
        rows.append((i, "ab" * rng.randint(0, 200) if rng.random() < 0.1 else t))
    return rows + [(500, None), (501, ""), (502, "a" * 1000), (503, "a" * 99)]


@pytest.mark.parametrize("hot, piece", [(20_000, 1 << 22), (3, 256)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(runindex, "HOT_SNIPPETS", hot)
    monkeypatch.setattr(runindex, "PIECE", piece)
    rows = repeat_rows()
    got = {r[0]: tuple(r[1:]) for r in runindex.contract(corpus(spark, rows).repartition(4)).collect()}
    assert got == repeats_brute(rows)


def test_run_index_equals_window_set():
    rng = random.Random(5)
    for t in range(60):
        strings = [bytes(rng.choice(b"ab" if t % 2 else b"abcdefgh") for _ in range(rng.randint(0, 60)))
                   for _ in range(rng.randint(1, 12))]
        strings += strings[:1]
        length, seen, want, at = rng.choice([1, 3, 5, 8]), set(), [], 0
        for s in strings:
            for i in range(len(s) - length + 1):
                if s[i:i + length] in seen:
                    want.append(at + i)
                seen.add(s[i:i + length])
            at += len(s)
        index = runindex.RunIndex(strings)
        assert index.repeated(length).tolist() == want
        assert len(index.run_rows) <= len(index.data)


def test_repeats_edges(spark):
    rows = {(r.doc_id, r.n_bytes): r for r in runindex.contract(corpus(spark, EDGE)).collect()}
    assert runindex.contract(corpus(spark, EDGE)).count() == len(EDGE)
    removed = sorted(r.n_removed for r in runindex.contract(corpus(spark, EDGE)).where("doc_id = 5").collect())
    assert removed[0] == 0 and removed[2] == 15000 and rows[1, 0].n_spans == 0     # of two equal rows one loses all
    assert runindex.contract(corpus(spark, [])).count() == 0


# --- decontamination ----------------------------------------------------------

def leak_brute(rows, items):
    out = set()
    for i, t in rows:
        text = decontam.words(t or "")
        for q, s in items:
            own = decontam.words(s or "")
            if own and any(text[k:k + len(own)] == own for k in range(len(text) - len(own) + 1)):
                out.add((i, q))
    return out


def test_latent_axes_are_fitted_on_every_document(spark, monkeypatch):
    fitted, axes = [], decontam.latent_axes

    def counted(ids, *args):
        fitted.append(ids.count())
        return axes(ids, *args)
    monkeypatch.setattr(decontam, "latent_axes", counted)
    many = spark.range(24_000).selectExpr("id as doc_id", "concat('red fox number ', id % 97, ' ran') as text")
    items = spark.createDataFrame([(1, "seventy red foxes ran over nine green hills today")], "item_id long, text string")
    assert decontam.find_matches(many, items).count() == 0
    assert fitted == [24_000]


def test_word_counts_are_by_cell():
    rng = random.Random(3)
    lists = [[rng.randrange(-1, 40) for _ in range(rng.randrange(60))] for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["ids"])
    want = Counter()
    for ids in lists:
        for lo in range(0, max(1, len(ids)), decontam.CELL):
            want.update({-1, *ids[lo:lo + decontam.CELL]} if ids else {-1})
    got = Counter()
    for b in decontam._frequencies(iter([batch])):
        got.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist())))
    assert got == want


def test_words_are_numbered_whole(monkeypatch):
    rng = random.Random(4)
    signs = ["a", "B", "x", "\u00e9", "\u03a3", "\u0130", "\u00df", "\x1c", "\x85", "\U0001f600", "'", "=", ".", "|", *" \t\n\x0b\x0c\r  "]
    texts = [None, "", " ", ".", *["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(800)], "", None]
    numbers: dict[bytes, int] = {}
    for t in texts[::2]:
        for w in decontam.words(t or ""):
            numbers.setdefault(w, len(numbers))
    want = [[numbers.get(w, -1) for w in decontam.words(t or "")] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts, pa.string())],
                                       names=["doc_id", "text_hash", "text"])
    for size in (decontam.BYTES, 1, 300):
        monkeypatch.setattr(decontam, "BYTES", size)
        assert [ids for b in decontam._numbered(numbers)(iter([batch])) for ids in b.column("ids").to_pylist()] == want


def test_row_sums():
    rng = np.random.default_rng(2)
    for total, n in ((1, 0), (5, 3), (40, 900), (3, 7000), (3000, 9000)):
        group, row, vectors = np.sort(rng.integers(0, total, n)), rng.integers(0, 50, n), rng.standard_normal((50, 4))
        want = np.zeros((total, 4))
        np.add.at(want, group, vectors[row])
        assert np.allclose(decontam.row_sums(vectors, row, group, total), want)


def searched(n_docs, n_words, n_items, n_vocabulary):
    """Numbered documents of the same few words as the items, and the search over them."""
    rng = np.random.default_rng(n_docs)
    draw = lambda n: rng.integers(0, n_vocabulary, (n, 3)).min(1)
    items = [(q, draw(38).tolist(), []) for q in range(n_items)]
    lists = [draw(n_words).tolist() for _ in range(n_docs)]
    lists[3][100:138] = items[5][1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n_docs)), pa.array([0] * n_docs), pa.array(lists, pa.list_(pa.int32()))],
                                       names=["doc_id", "text_hash", "ids"])
    n = n_docs * n_words // decontam.CELL
    idf, unknown, thin = decontam.weights(n, np.where(np.arange(n_vocabulary) < n_vocabulary // 8, n, 0), items, decontam.MIN_LCS)
    axes = np.linalg.qr(rng.standard_normal((n_vocabulary, decontam.RANK)))[0]
    return batch, decontam._searcher(axes, idf, unknown, items, thin, [False] * n_items, decontam.MIN_COSINE, decontam.MIN_LCS, decontam.MIN_ANSWER)


def test_search_of_long_documents_is_bounded_in_memory():
    batch, run = searched(64, 6000, 600, 1500)
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(run(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 60e6            # the cosines of all passages alone: 58 MB, several times
    finally:
        tracemalloc.stop()
    assert (3, 5) in set(zip(found["doc_id"].to_pylist(), found["item_id"].to_pylist()))


def test_decontamination_finds_every_passage(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()]
    clean = [i for i, _ in rows if i not in {a for a, _ in leak_brute(rows, items)}]
    for k, (q, text) in enumerate(items[:8]):           # paraphrases: one word in seven replaced
        words = text.split()
        rows.append((20_000 + k, " ".join("other" if j % 7 == 3 else w for j, w in enumerate(words)) + " and more words follow"))
    found = {(r.doc_id, r.item_id) for r in decontam.find_matches(corpus(spark, rows), benchmark).collect()}
    exact = leak_brute(rows, items)
    assert exact <= found
    assert {(20_000 + k, q) for k, (q, _) in enumerate(items[:8])} <= found
    assert not {i for i, _ in found} & set(clean)


def test_decontamination_edges(spark):
    benchmark = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog. It was late."), (2, None), (3, ""), (None, "x y")],
                                      "item_id long, text string")
    rows = EDGE + [(50, "So the quick brown fox jumps over the lazy dog. It was late."), (51, "the quick brown fox jumps over the lazy dog")]
    got = {r.doc_id: r for r in decontam.contract(corpus(spark, rows), benchmark).collect()}
    assert got[50].items == [1] and not got[4].contaminated
    assert not got[51].contaminated                     # the answer is missing
    assert decontam.contract(corpus(spark, rows), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontam.contract(corpus(spark, []), benchmark).count() == 0
    left = decontam.clean(corpus(spark, rows), benchmark)
    assert left.count() == len(rows) - 1 and left.columns == corpus(spark, rows).columns


@pytest.mark.parametrize("size", [38, 12])
def test_decontamination_of_a_leak_in_a_third_of_the_rows(spark, size):
    rng = random.Random(size)
    item = [f"leak{i}" for i in range(size)]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"w{rng.randint(0, 900)}" for _ in range(30)))], "item_id long, text string")
    text = lambda n: [f"w{min(rng.randint(0, 900), rng.randint(0, 900))}" for _ in range(n)]
    rows = [(i, " ".join(text(60))) for i in range(400)]
    rows += [(1000 + i, " ".join([*text(cut := rng.randint(0, 20)), *item, *text(20 - cut)])) for i in range(200)]
    rows += [(2000, " ".join([*text(9), *["other" if j % 3 == 2 else w for j, w in enumerate(item)], *text(9)]))]   # no run of three
    found = {(r.doc_id, r.item_id) for r in decontam.find_matches(corpus(spark, rows), benchmark).collect()}
    assert {(i, 1) for i, _ in rows if i >= 1000} == found


def test_decontamination_of_long_items(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{min(rng.randint(0, 4000) for _ in range(3))}" for _ in range(n)]
    items = [(q, text(n)) for q, n in enumerate([300, 800, 800, 1500])]
    rows = [(i, " ".join(text(120))) for i in range(150)]
    rows += [(1000 + q, " ".join([*text(37), *own, *text(41)])) for q, own in items]
    rows += [(2000 + q, " ".join([*text(21), *["other" if j % 4 == 3 else w for j, w in enumerate(own)], *text(9)])) for q, own in items]
    benchmark = spark.createDataFrame([(q, " ".join(own)) for q, own in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_matches(corpus(spark, rows), benchmark).collect()}
    assert found == {(i + q, q) for i in (1000, 2000) for q, _ in items}


def test_decontamination_without_the_last_sentence(spark):
    long = "the quick brown fox jumps over the lazy dog and runs through the old forest to the river bank"
    rows = [(1, f"So {long}"), (2, f"So {long}. It was late."), (3, " ".join(long.split()[:13]))]
    benchmark = spark.createDataFrame([(1, f"{long}. It was late.", None), (2, long, "a badger")], "item_id long, text string, answer string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_matches(corpus(spark, rows), benchmark).collect()}
    assert found == {(1, 1), (2, 1)}                    # 13 of 22 words are too few; a given answer must be there


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))], [rng.randint(0, 4) for _ in range(rng.randint(0, 15))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(decontam.place_masks(a), len(a), b) == table[-1][-1]


# --- preference pairs ---------------------------------------------------------

def test_preference_equals_sql(spark):
    got = preference.contract(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert same(got, oracle(preference.ORACLE))


def test_preference_edges(spark):
    schema = "pair_id long, turn long, role string, text string, p int, side int, head string"
    def rows(*r):
        return spark.createDataFrame([(*x, 1, 1, "x") for x in r], schema)
    chosen = rows((1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"),
                  (None, 0, "assistant", "x"), (3, 0, "user", "same"))
    rejected = rows((1, 0, "user", "hi"), (1, 1, "assistant", "bad one"), (2, None, None, None), (2, 0, "user", "a"), (3, 0, "user", "same"))
    got = {r.pair_id: r for r in preference.format_preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, None}
    one = got[1]
    assert one.prompt == "<|user|>\nhi<|end|>\n" and one.rejected == "<|assistant|>\nbad one<|end|>\n"
    (mask,) = one.chosen_mask
    assert one.chosen[mask.start:mask.end] == "good<|end|>\n"
    assert got[2].n_prompt == 1 and got[2].n_chosen == 2 and got[2].n_rejected == 1
    assert got[3].chosen == got[3].rejected == "" and got[None].n_rejected == 0
    assert preference.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def test_preference_runs_without_python(spark):
    got = preference.contract(spark.read.parquet(f"{SF}/conversations.parquet"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
