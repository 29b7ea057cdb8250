"""Operators that judge or encode single texts: PII, quality, tokens."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from support import EDGE, SF, corpus

from turnstile.llm import pii, quality, tokens
from turnstile.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_pii_patterns_equal_plain_regex():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "@", "1", "2.", "+1", "25", " ", "-", "é", "9", "(", ".", "4111 1111 1111 1111"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert base_brute(t) == pii.base_spans(t)


def test_pii_patterns_stay_linear():
    pii.base_spans("@" * 2000 + "1" * 200_000 + " " + "a" * 200_000 + "@" + "1." * 50_000 + "+1" + " " * 200_000)


def test_crf_held_out_accuracy():
    weights, moves = pii.train()
    table = pii.labelled_table(300, seed=99)
    codes, starts, ends, lengths, begins = pii.sequences([t for t, _ in table])
    truth = pii.gold(table, starts, ends, lengths, begins)
    found = pii.viterbi(pii._emissions(weights, codes, lengths), lengths, moves)
    assert (found == truth)[truth > 0].mean() > 0.95 and (found == truth)[found > 0].mean() > 0.93


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 3, 2, 4])
    emission, moves = rng.normal(size=(10, 3)), rng.normal(size=(3, 3))
    got, at = pii.viterbi(emission, lengths, moves), 0
    for n in lengths:
        def score(path, at=at):
            return sum(emission[at + i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        best = max(np.ndindex(*[3] * n), key=score)
        assert tuple(got[at:at + n]) == best
        at += n


def test_pii_adds_written_out_forms(spark):
    text = "contact maria.lo [at] host [dot] org or (212) 555-0147 é 4539 1488 0343 6467 and a@b.co"
    row = pii.contract(corpus(spark, [(1, text), (2, "plain words (see page 12) of 1999")])).orderBy("doc_id").collect()
    assert row[0].n_email == 1 and row[0].n_card == 1 and row[0].n_phone == 0
    values = {text[int(a):int(b)] for _, a, b in (s.split(":") for s in row[0].spans.split(","))}
    assert {"maria.lo [at] host [dot] org", "(212) 555-0147", "a@b.co", "4539 1488 0343 6467"} <= values
    assert row[1].spans == "" and row[1].n_added == 0
    found = pii.redact(pii.find_pii(corpus(spark, [(1, text)]))).first()
    assert found.text == "contact <EMAIL> or <PHONE> é <CARD> and <EMAIL>"


def test_pii_edges(spark):
    rows = pii.find_pii(corpus(spark, EDGE))
    assert rows.count() == len(EDGE) and [c for c in rows.columns].count("spans") == 1 and "odd name" in rows.columns
    assert rows.where("size(spans) > 0").count() == 0
    assert pii.contract(corpus(spark, [])).count() == 0


def quality_brute(t):
    w = WORD.findall(t or "")
    n, longest = len(w), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        longest.append(best)
    def inside(least, span):
        hit = [False] * n
        for i in range(n):
            if longest[i] >= least:
                for k in range(span(longest[i])):
                    hit[i + k] = True
        return hit
    rep, cov = inside(3, lambda x: 3), inside(quality.MIN_REPEAT, lambda x: x)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    chars, covered = sum(map(len, w)), sum(len(x) for x, c in zip(w, cov) if c)
    top = max([x for x in longest if x >= quality.MIN_REPEAT], default=0)
    failed = n < 50 or 100 * sum(rep) > 50 * n
    bad = covered > quality.MAX_COVERED * chars or top > max(quality.SLACK, quality.MAX_LONGEST * n)
    return (n, chars, sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(rep), failed,
            not failed and not bad, covered, top)


def test_quality_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [t for _, t in EDGE if t is None or len(t) < 100]
    for _ in range(60):
        pool = rng.choice(["ab", "abcdef", "abcdefghijklmnopqrstuvwxyzé"])
        texts.append("".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "# "]) for _ in range(rng.randint(0, 120))))
    part = " ".join(str(x) for x in range(70))
    texts += [part + "\n" + " ".join(str(x) for x in range(100, 270)) + "\n" + part]
    rows = quality.contract(corpus(spark, list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept,
                r.covered_chars, r.longest_repeat) == quality_brute(texts[r.doc_id])
    assert not rows[[r.doc_id for r in rows].index(len(texts) - 1)].kept      # one long repeat is enough


def test_quality_edges(spark):
    rows = quality.quality_rules(corpus(spark, EDGE))
    assert rows.count() == len(EDGE) and rows.columns.count("kept") == 1
    assert quality.quality_rules(corpus(spark, [])).count() == 0


@pytest.fixture(scope="module")
def plain():
    return tokens.ChunkEncoder(tokens.vocabulary_path())


def test_chunked_encoding_equals_the_library(plain):
    odd = ["", " ", "  a", " a", "a  b   c", "\n a \n b", "a\n\n  b", "x<|endoftext|> y z<|endoftext|>", "\x1c a\x1d b 'll I'm  don't",
           "é  \t é", "日本 語 テキスト  ", "a " * 5, " \n", "🙂 🙂  x", "a \xa0b 　 c", "« b » – c ", "a ́b", "1 2,3 .4"]
    assert plain.encode(odd) == plain._plain(odd)


def test_each_piece_is_encoded_once(plain, monkeypatch):
    given = []
    monkeypatch.setattr(plain, "cache", {})
    monkeypatch.setattr(plain, "_plain", lambda texts, run=plain._plain: given.extend(texts) or run(texts))
    words = [f"{a}{b}ing" for a in "bcdfghklmn" for b in "aeiouäöü"]
    texts = [" ".join(f"{w},\n{v}({k})." for k, w in enumerate(words)) for v in words]
    got = plain.encode(texts)
    seen = sum(map(len, given))
    monkeypatch.undo()
    assert got == plain._plain(texts)
    assert seen < 20 * len(words), "words that stand beside other punctuation were encoded again"


def test_any_mixture_equals_the_library(plain, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 500)
    atoms = [*"abé'.,;!?-#|$\n  \t\x0b\x1c\x85\xa0　123²½ß×Ɏɐж日🙂\0\r_<>", "'s", "'ll", "<|endoftext|>", "<|end", "of",
             "text|>", " the", ".\n", ", ", "\n\n", "\n\n\n", "don't", "12.\n"]
    for _ in range(30):
        texts = ["".join(rng.choices(atoms, k=rng.randrange(30))) for _ in range(100)]
        assert plain.encode(texts) == plain._plain(texts)
    for texts in ([], [""], ["", ""], ["\n"], ["a"]):
        assert plain.encode(texts) == plain._plain(texts)


def test_slices_hold_every_row(plain, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    texts = ["a b", None, "", "twelve bytes and more", "x", None, "y z"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = [s.column("text").to_pylist() for s in tokens._slices(batch)]
    assert sum(got, []) == texts and len(got) > 2 and all(got)
    assert not list(tokens._slices(batch.slice(0, 0)))


def test_tokens_round_trip(spark, plain):
    rows = EDGE + [(9, "Some text, with 3 numbers.")]
    got = tokens.contract(corpus(spark, rows)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain._plain([t or ""])[0] + (0).to_bytes(4, "little"))
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(b) // 4, zlib.crc32(b)) for i, bs in want.items() for b in bs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    assert tokens.contract(corpus(spark, [])).count() == 0


def test_token_files(spark):
    path = scratch_path(spark, "token-test")
    tokens.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path)
    file = next(f for f in spark.read.parquet(path).inputFiles())
    meta = pq.ParquetFile(file.removeprefix("file://")).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = next(c for n, c in columns.items() if n.startswith("tokens"))
    assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_offset_index
    assert any("DELTA" in e for e in columns["doc_id"].encodings) and columns["doc_id"].has_column_index
    plan = tokens.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.split("ReadSchema", 1)[1].split("\n")[0]
    some = tokens.read_tokens(spark, path, 10, 19)
    assert "GreaterThanOrEqual(doc_id,10)" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 10
