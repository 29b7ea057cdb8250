"""Quality rules with a suffix array over each text's words.

A batch of texts becomes one array of word numbers. Suffixes are sorted by
prefix doubling under the key (document, words...), so no repeat crosses a
document, and only suffixes that still share their prefix are sorted again.
Longest common prefixes of neighbours follow from the stored ranks of each
doubling step. A position's longest repeat is the larger prefix it shares with
its two neighbours; the left-maximal ones are the maximal repeated substrings,
whose spans are united. A text is rejected when these spans cover too much of
it or one of them is too long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import carried, in_arrow

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
BATCH_WORDS = 400_000          # words sorted together; one longer text is its own batch

MIN_REPEAT = 5                 # words of the shortest repeat that counts
MAX_COVERED = 0.45             # of the code points in words
MAX_LONGEST = 0.20             # of the words, for one maximal repeat
SLACK = 30                     # words that a maximal repeat may have whatever the length of the text


def repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Length in words of the longest repeat that starts at each position, the
    other occurrence being in the same document. ``doc`` is non-decreasing."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    stop = np.searchsorted(doc, doc, "right")                # end of the own document

    def regroup(active: np.ndarray, key: np.ndarray, rank: np.ndarray, floor: np.ndarray):
        """Sort ``active`` by key; ranks are places of the group's first member."""
        order = np.argsort(key, kind="stable")
        active, key, floor = active[order], key[order], floor[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        head = np.concatenate([[True], floor[1:] != floor[:-1]])      # first of the parent group
        parent = np.flatnonzero(head)[np.cumsum(head) - 1]
        rank[active] = floor + (starts[group] - parent)
        alone = np.diff(np.append(starts, len(key))) == 1
        return active, alone[group], rank[active]

    rank = np.zeros(n, np.int64)
    base = int(ids.max()) + 1
    active, alone, _ = regroup(np.arange(n), doc * base + ids, rank, np.zeros(n, np.int64))
    levels, step = [rank.copy()], 1
    active = active[~alone]
    while len(active):
        ahead = active + step
        inside = ahead < stop[active]
        follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        floor = rank[active]
        nxt = rank.copy()
        members, alone, _ = regroup(active, floor * (n + 1) + follow, nxt, floor)
        rank = nxt
        levels.append(rank.copy())
        step *= 2
        active = members[~alone]
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)                               # the suffix array
    left, right = place[:-1].copy(), place[1:].copy()
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    for k in range(len(levels) - 1, -1, -1):
        a, b = left[live] + common[live], right[live] + common[live]
        ok = (a < stop[left[live]]) & (b < stop[right[live]])
        same = ok.copy()
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        common[live[same]] += 1 << k
    longest[place[:-1]] = common
    longest[place[1:]] = np.maximum(longest[place[1:]], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Mask of the positions inside a repeat of at least ``least`` words."""
    at = np.flatnonzero(longest >= least)
    marks = np.zeros(len(longest) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + longest[at], -1)
    return np.cumsum(marks[:-1]) > 0


def measure(texts: list[str], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All measures of a batch of texts, one array per measure."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    numbers: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter((numbers[w] for words in split for w in words), np.int64, int(n_words.sum()))
    chars = np.array([len(w.decode("utf-8", "surrogatepass")) for w in numbers], np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    out = {"n_words": n_words,
           "word_chars": np.array([len(t) - sum(t.count(c) for c in BLANKS) for t in texts], np.int64),
           "n_symbols": np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64)}
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, np.int64)
    longest = repeats(ids, doc)
    per = lambda x: np.bincount(doc, x, len(texts)).astype(np.int64)
    window = longest >= 3                                    # a 3-word window found again
    inside = window.copy()
    for k in (1, 2):
        inside[k:] |= window[:-k]                            # its other words (same document by construction)
    out["n_repeat_words"] = per(inside)
    out["covered_chars"] = per(covered(longest, min_repeat) * (chars[ids] if len(ids) else 0))
    counts = longest >= min_repeat
    before = np.concatenate([[0], longest[:-1]])[: len(longest)]
    first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(longest)]
    out["n_repeats"] = per(counts & (first | (before <= longest)))     # left-maximal
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc, np.where(counts, longest, 0))
    out["longest_repeat"] = top
    return out


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars",
           "n_repeats", "longest_repeat"]


def _measured(names: list[str], min_repeat: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            cuts, size = [0], 0
            for k, t in enumerate(texts):
                size += len(t) // 5 + 1
                if size > BATCH_WORDS:
                    cuts.append(k + 1)
                    size = 0
            cuts = sorted({*cuts, len(texts)})
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                found = measure(texts[lo:hi], min_repeat)
                rest = [batch.column(n).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays(rest + [pa.array(found[c]) for c in COLUMNS],
                                                 names=names + [f"_q_{c}" for c in COLUMNS])
    return run


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
                  max_longest: float = MAX_LONGEST, slack: int = SLACK) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``.

    Null or empty text has no words and fails; repeated rows are judged alike;
    an empty table gives none; input columns of an output's name are replaced.
    A scan without a shuffle; memory is a batch of words or one text.
    """
    outs = {"base_failed", "kept", *COLUMNS}
    names = [c for c in docs.columns if c.lower() not in outs]
    rows = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(names)],
                       docs["text"].alias("_text"))
    own = [f"_c{i}" for i in range(len(names))]
    schema = carried(docs, names, [StructField(f"_q_{c}", LongType()) for c in COLUMNS])
    found = in_arrow(rows, _measured(own, min_repeat), schema)
    q = {c: F.col(f"_q_{c}") for c in COLUMNS}
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    repetitive = ((q["covered_chars"] > max_covered * q["word_chars"])
                  | (q["longest_repeat"] > F.greatest(F.lit(slack), max_longest * q["n_words"])))
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)],
                        *[q[c].alias(c) for c in COLUMNS],
                        failed.alias("base_failed"), (~failed & ~repetitive).alias("kept"))


def contract(docs: DataFrame) -> DataFrame:
    rows = quality_rules(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "covered_chars", "n_repeats", "longest_repeat")
