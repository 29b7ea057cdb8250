"""Prefix trie, whitening and scaled sketches against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from support import EDGE, SF, corpus

from turnstile.llm import sketch, trie, whitening
from turnstile.llm.common import table

ODD = "conv_id long, turn long, role string, text string, depth int, key string, ord long, `odd name` string"


def trie_brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t, role or "", text or ""))
    for c, found in turns.items():
        found.sort(key=lambda e: (e[0] is not None, e[0] or 0, hashlib.sha256(
            f"{len(e[1].encode())}:{e[1]}{e[2]}".encode()).digest()[:16]))
        turns[c] = [e[1:] for e in found]
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + own
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), leaves[k],
                    saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    full = [(*r, 7, "x", 7, "x") for r in rows]
    return sorted(map(tuple, trie.contract(spark.createDataFrame(full, ODD)).collect()), key=str)


def test_trie_equals_oracle(spark):
    turns = table(spark, SF, "conversations")
    got = sorted(map(tuple, trie.contract(turns).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    assert got == sorted(con.sql(trie.ORACLE).fetchall(), key=str)
    assert got == trie_brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_trie_deep_shared_and_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for c in range(50):
        for t in range(rng.choice([0, 1, 3, 8, 9, 12, 20, 40])):
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["u", None, ""]),
                         rng.choice("xxxxxxxxxxabé") if rng.random() < 0.8 else None))
    rows += [(7, 3, "u", "x")] * 5 + [(None, 1, "u", "x"), (200, 1, None, None)]
    truth = trie_brute(rows)
    assert max(r[1] for r in truth) > 16
    assert trie_rows(spark, rows) == truth
    # a prefix with many entries under it is peeled depth by depth, with the same nodes
    monkeypatch.setattr(trie, "GROUP_ENTRIES", 60)
    assert trie_rows(spark, rows) == truth
    assert trie_rows(spark, []) == []


def test_trie_blocks():
    seen = 0
    for block in range(12):
        low, high = trie.bounds_of(block)
        assert low == seen and 0 < high - low <= trie.MOST_BLOCK
        seen = high


def test_trie_block_numbers_meet_their_bounds(spark):
    from pyspark.sql import functions as F
    got = spark.range(1, 5000).select("id", trie.block_of(F.col("id")).alias("b")).collect()
    for r in got:
        low, high = trie.bounds_of(r.b)
        assert low < r.id <= high


# ---------------------------------------------------------------- whitening
VECTORS = "vec_id long, embedding array<float>, x string, component int, `odd name` string"


def test_whitening_equals_dense_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    x = np.floor(256 * np.array([e for _, e in rows], np.float64)).astype(int)
    once = np.unique(x, axis=0)
    n, mean = len(once), once.mean(0)
    values, vectors = np.linalg.eigh((once - mean).T @ (once - mean) / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    total = ((once - mean) ** 2).sum() / n
    got = {(r.vec_id, r.component): r for r in whitening.contract(table(spark, SF, "embeddings")).collect()}
    assert len(got) == 4 * len(rows)
    for (key, _), v in zip(rows, x):
        z = (v - mean) @ vectors / np.sqrt(values)
        for k in range(4):
            r = got[key, k + 1]
            assert r.n == n and r.deviation == int(((n * v - once.sum(0)) ** 2).sum())
            assert abs(r.explained - values[k] / total) < 1e-9 and r.identity_error < 1e-9
            assert abs(abs(r.whitened) - abs(z[k])) < 1e-6
    # one sign per component for all rows
    for k in range(4):
        own = np.array([got[key, k + 1].whitened for key, _ in rows])
        ref = (x - mean) @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(own - ref).max(), np.abs(own + ref).max()) < 1e-6


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (3, [1.0])]
    bad = [(4, None), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [None, 1.0]), (8, [-inf, 1.0])]
    df = spark.createDataFrame([(k, v, "x", 7, "x") for k, v in good + bad], VECTORS)
    out = whitening.contract(df).collect()
    assert len(out) == 2 * len(good) and {r.n for r in out} == {4} and {r.vec_id for r in out} == {1, 2, 3, None}
    x = np.array([[256, 512], [768, -256], [128, 64], [256, 0]])
    assert sorted({r.deviation for r in out}) == sorted(((4 * x - x.sum(0)) ** 2).sum(1).tolist())
    assert abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-12
    for few in ([], [(1, [1.0, 2.0])] * 3, bad, [(1, [])]):
        assert whitening.contract(spark.createDataFrame([(k, v, "x", 7, "x") for k, v in few], VECTORS)).count() == 0
    # entries far past a long: held at its ends, deviations past a long are null
    huge = spark.createDataFrame([(1, [3e38], "x", 7, "x"), (2, [-3e38], "x", 7, "x")], VECTORS)
    assert [r.deviation for r in whitening.contract(huge).collect()] == [None, None]


@pytest.mark.parametrize("dims,rank", [(5, 1), (7, 3), (30, 40), (65, 200)])
def test_factor_and_rotations(dims, rank):
    rng = np.random.default_rng(dims)
    a = rng.normal(size=(dims, rank)) * 10.0 ** rng.uniform(-1, 1, rank)
    m = a @ a.T
    factor = whitening.pivoted_cholesky(m)
    assert factor.shape[1] == min(dims, rank) and np.allclose(factor @ factor.T, m, rtol=1e-10, atol=1e-10 * m.max())
    values, vectors = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:len(values)], rtol=1e-9, atol=1e-11 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(m @ vectors, vectors * values, atol=1e-11 * values[0])


# ---------------------------------------------------------------- sketches
def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        yield k, t, t[:len(t) - q] + following[:q], following


def test_sketch_contract(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in sketch.contract(table(spark, SF, "documents")).collect()}
    assert len(got) == len(rows)
    errors, prints = [], defaultdict(set)
    for k, t, edited, following in neighbours(rows):
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert sketch.from_text(r.fingerprint).tolist() == sketch.sketches([t])[0].tolist()
        assert sketch.from_text(r.edited_fingerprint).tolist() == sketch.sketches([edited])[0].tolist()
        own = shingle_set(t)
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            if len(own) > 100:
                errors.append(near - len(own & shingle_set(other)) / len(own))
        prints[t].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08


def test_sketch_is_the_lowest_fraction_of_all_shingle_hashes():
    rng = random.Random(4)
    texts = ["", " \n", "one", "a b c d", "a b c d e", "word " * 9000, "é" * 3000, "x"]
    texts += [" ".join(str(rng.randint(0, 400)) for _ in range(n)) for n in (20, 300, 900, 3000, 250_000)]
    for t, s in zip(texts, sketch.sketches(texts)):
        owner, every = sketch.shingles([t])
        every = np.unique(every)
        assert len(every) == len(shingle_set(t))
        low = int((every <= sketch.limit()).sum())
        assert s.tolist() == every[:max(low, sketch.FLOOR)].tolist()
        assert sketch.from_text(sketch.to_text(s)).tolist() == s.tolist()


def test_sketches_merge_and_estimate_containment_of_unequal_documents():
    rng = random.Random(8)
    book = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    part, other = book[10_000:11_500], [f"v{rng.randint(0, 5000)}" for _ in range(1500)]
    a, b, c = sketch.sketches([" ".join(x) for x in (part, book, part + other)])
    assert sketch.compare(a, b)[0] == 1.0 and sketch.compare(a, b)[1] < 0.05
    assert sketch.compare(b, a)[0] < 0.05 and abs(sketch.compare(c, b)[0] - 0.5) < 0.12
    halves = sketch.sketches([" ".join(x) for x in (book[:30_000], book[29_996:])])
    assert sketch.merge(*halves).tolist() == b.tolist()
    tiny = sketch.sketches(["a b c d e f", "c d e f g h"])
    assert sketch.merge(*tiny).tolist() == sorted(set(tiny[0].tolist()) | set(tiny[1].tolist()))
    assert sketch.compare(tiny[0], tiny[0]) == (1.0, 1.0) and sketch.compare(tiny[0][:0], tiny[0]) == (0.0, 0.0)


def test_sketch_odd_rows(spark):
    rows = [r for r in EDGE if r[0] not in (5, None)] + [(9, "word " * 3000), (5, "x y " * 20_000)]
    out = {r.doc_id: r for r in sketch.contract(corpus(spark, rows)).collect()}
    for k, t, edited, _ in neighbours([r[:2] for r in rows]):
        assert out[k].n_chars == len(t) and out[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[k].near_edited <= 1 and 0 <= out[k].near_next <= 1
    assert out[1].near_next == 1.0 and out[1].fingerprint == ""          # two empty texts
    assert sketch.contract(corpus(spark, EDGE)).count() == len(EDGE)     # equal and null ids
    assert sketch.contract(corpus(spark, [])).count() == 0
    alone = sketch.contract(corpus(spark, [(3, "a b c d e f g")])).first()
    assert alone.near_next == 1.0
    marked = sketch.fingerprint(corpus(spark, EDGE))
    assert marked.count() == len(EDGE) and "odd name" in marked.columns
    assert {r.fingerprint for r in marked.where("doc_id = 9").collect()} <= {out[9].fingerprint}


def test_sketch_does_not_depend_on_the_partitioning(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    one = sorted(map(str, sketch.contract(docs.coalesce(1)).collect()))
    many = sorted(map(str, sketch.contract(docs.repartition(13)).collect()))
    assert one == many
