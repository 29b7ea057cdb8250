"""Personal data: fixed patterns plus a linear-chain conditional random field.

Four kinds are matched by pattern: emails, IPv4 addresses, payment cards and
international phone numbers. The field then reads the words around anything
that looks like a number, an address or a bracketed word, by the shape of the
words only, and adds the written-out forms the patterns miss (``name [at] host
[dot] org``, ``10[.]0[.]0[.]1``, national phone numbers, cards with dots). It is
trained on the driver from a small labelled table made by rule, decoded by
Viterbi over numpy batches of sequences in the tasks. A decoded span must still
hold a valid value of its kind (digit counts, Luhn, parts up to 255).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import carried, in_arrow

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 400              # bound of the labelled table
REACH = 2                     # words on either side of a marked word that belong to its sequence
BATCH_ROWS = 512

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, odd)) + sum(even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the pattern matches, sorted. Each kind is
    matched leftmost without overlap; linear in the text: an email is found from
    its ``@``, whose run of local characters reaches back to the previous ``@`` or match."""
    found = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            seg = text[max(free, text.rfind("@", free, at) + 1):at]
            size = len(seg) - len(seg.rstrip(_LOCAL))
            if size:
                found.append((at - size, 0, m.end()))
                free = m.end()
            else:
                free = max(free, at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- words and their shapes -------------------------------------------------

#: One bit per character class; code points over 127 count as lower-case letters.
DIGIT, UPPER, LOWER, DOT, DASH, OPEN, CLOSE, SQUARE, PLUS, AT, OTHER, BLANK = (1 << i for i in range(12))


def _classes() -> np.ndarray:
    table = np.full(129, OTHER, np.int32)
    for c in range(128):
        ch = chr(c)
        for test, bit in ((ch.isdigit(), DIGIT), (ch.isupper(), UPPER), (ch.islower(), LOWER), (ch == ".", DOT),
                          (ch == "-", DASH), (ch == "(", OPEN), (ch == ")", CLOSE), (ch in "[]", SQUARE),
                          (ch == "+", PLUS), (ch == "@", AT), (ch in "\x20\x09\x0a\x0b\x0c\x0d", BLANK),
                          (ch in ",;:!?", 0)):
            if test:
                table[c] = bit
    table[128] = LOWER
    return table


_TABLE = _classes()
#: (class bits, upper bounds of the buckets): a word's count falls into one bucket.
_COUNTS = ((DIGIT, (0, 1, 2, 3, 4, 6, 9, 13, 19)), (UPPER | LOWER, (0, 1, 3, 5)), (DOT, (0, 1, 2, 3)),
           (DASH, (0, 1, 2)), (OPEN, (0,)), (CLOSE, (0,)), (SQUARE, (0, 1)), (PLUS, (0,)), (AT, (0, 1)),
           (OTHER, (0,)), (UPPER, (0, 1)))
_FIRST = (DIGIT, UPPER | LOWER, PLUS, OPEN)
_SIZES = [len(b) + 1 for _, b in _COUNTS] + [len(_FIRST) + 1]
_JOINT = ((0, 1), (0, 2), (0, 3), (0, 11), (1, 6))            # pairs of features seen together


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class bits of all texts' characters, word starts and ends in them, and
    the place where each text begins; one blank stands between texts."""
    raw = "\n".join(texts).encode("utf-32-le", "surrogatepass")
    bits = _TABLE[np.minimum(np.frombuffer(raw, np.uint32), 128)]
    ink = np.concatenate([[False], bits != BLANK, [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    return bits, edge[::2], edge[1::2], begins


def shapes(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per word that packs all its features."""
    if not len(starts):
        return np.zeros(0, np.int64)
    size = ends - starts
    at = np.cumsum(size) - size
    own = bits[np.repeat(starts - at, size) + np.arange(int(size.sum()))]
    code = np.zeros(len(starts), np.int64)
    for mask, bounds in _COUNTS:
        n = np.add.reduceat((own & mask) != 0, at, dtype=np.int64)
        code = code * (len(bounds) + 1) + np.searchsorted(bounds, n, "left")
    head = bits[starts]
    kind = np.full(len(starts), len(_FIRST), np.int64)
    for k, mask in enumerate(_FIRST):
        kind[(head & mask) != 0] = k
    return code * _SIZES[-1] + kind


def attributes(codes: np.ndarray) -> np.ndarray:
    """Numbers of the active attributes of each shape (one row per shape)."""
    parts, rest = [], codes.copy()
    for size in reversed(_SIZES):
        parts.append(rest % size)
        rest //= size
    parts = parts[::-1]
    columns, at = [], 0
    for p, size in zip(parts, _SIZES):
        columns.append(p + at)
        at += size
    for a, b in _JOINT:
        columns.append(parts[a] * _SIZES[b] + parts[b] + at)
        at += _SIZES[a] * _SIZES[b]
    return np.stack(columns, 1)


N_ATTR = sum(_SIZES) + sum(_SIZES[a] * _SIZES[b] for a, b in _JOINT) + 1   # the last: no such neighbour
N_LABEL = 1 + 2 * len(KINDS)                                               # O, then B and I of each kind


# --- the labelled table -----------------------------------------------------

def labelled_table(rows: int = TRAIN_ROWS, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``rows`` made-up lines with their ``(start, end, kind number)`` spans."""
    rng = random.Random(seed)
    syllables = "an be cor da el fi gra ho in jo ka lu mer no or pa qui ra so tu un ver wi".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: word() + rng.choice(["", "." + word(), num(2), "." + num(2)])
    host = lambda: word() + rng.choice(["", num(1)])
    top = lambda: rng.choice(["com", "org", "net", "example.com", "de"])
    octets = lambda: [str(rng.randint(0, 255)) for _ in range(4)]

    def card() -> str:
        body = rng.choice("345") + num(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def quads(sep: str) -> str:
        c = card()
        return sep.join(c[i:i + 4] for i in range(0, 16, 4))

    makers = [
        (0, lambda: f"{name()}@{host()}.{top()}"), (0, lambda: f"{name()} [at] {host()} [dot] {rng.choice(['com', 'org'])}"),
        (0, lambda: f"{name()}(at){host()}.{rng.choice(['com', 'org'])}"), (0, lambda: f"{name()} (at) {host()} (dot) com"),
        (0, lambda: f"{name()} @ {host()}.{rng.choice(['com', 'org'])}"), (0, lambda: f"{name()}[at]{host()}[dot]com"),
        (1, lambda: ".".join(octets())), (1, lambda: "[.]".join(octets())), (1, lambda: " . ".join(octets())),
        (2, card), (2, lambda: quads(" ")), (2, lambda: quads("-")), (2, lambda: quads(".")), (2, lambda: quads("/")),
        (3, lambda: f"+{rng.randint(1, 9)} ({num(3)}) {num(3)}-{num(4)}"), (3, lambda: f"+{rng.randint(10, 99)}{num(9)}"),
        (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"), (3, lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        (3, lambda: f"{num(3)}.{num(3)}.{num(4)}"), (3, lambda: f"({num(3)}) {num(3)} {num(4)}"),
    ]
    others = [
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{rng.randint(0, 23)}:{num(2)}", lambda: num(rng.randint(1, 9)), lambda: num(rng.randint(20, 26)),
        lambda: f"{rng.randint(1, 999)},{num(3)}", lambda: f"${num(2)}.{num(2)}", lambda: f"AKIA{word().upper()}{num(2)}{word().upper()}{num(1)}",
        lambda: f'token = "{num(4)}{word()}{num(3)}{word()}{num(6)}"', lambda: f"password={num(3)}{word()}{num(4)}",
        lambda: f"[{num(2)}]", lambda: f"({word()} {word()})", lambda: f"({rng.randint(1990, 2030)})", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}",
        lambda: f"p. {num(3)}-{num(3)}", lambda: f"{num(1)}. {word()} {num(1)}. {word()}", lambda: f"{num(4)} {num(4)}", lambda: f"{num(3)}-{num(4)}",
        lambda: f"§ {num(3)}.{num(2)}", lambda: f"[{word()}]", lambda: f"({word()})", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"CC BY-NC {num(1)}.0.",
    ]
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", ", ", ": "])
            if rng.random() < 0.55:
                kind, make = rng.choice(makers)
                value = make()
                spans.append((len(text), len(text) + len(value), kind))
            else:
                value = rng.choice(others)()
            text += value + rng.choice([" ", " ", ". ", ", "])
        out.append((text + word(), spans))
    return out


def sequences(texts: list[str]):
    """Words near a marked word (a digit, ``@`` or bracket), cut into sequences:
    shapes, starts, ends, lengths of the sequences, and text beginnings."""
    bits, starts, ends, begins = words(texts)
    if not len(starts):
        return np.zeros(0, np.int64), starts, ends, np.zeros(0, np.int64), begins
    marked = np.logical_or.reduceat((bits & (DIGIT | AT | SQUARE | OPEN)) != 0, starts)
    owner = np.searchsorted(begins, starts, "right") - 1
    near = marked.copy()
    for k in range(1, REACH + 1):
        near[k:] |= marked[:-k] & (owner[k:] == owner[:-k])
        near[:-k] |= marked[k:] & (owner[k:] == owner[:-k])
    at = np.flatnonzero(near)
    if not len(at):
        return np.zeros(0, np.int64), starts[:0], ends[:0], np.zeros(0, np.int64), begins
    new = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
    lengths = np.diff(np.append(np.flatnonzero(new), len(at)))
    starts, ends = starts[at], ends[at]
    return shapes(bits, starts, ends), starts, ends, lengths, begins


def _emissions(weights: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    known, place = np.unique(codes, return_inverse=True)
    rows = attributes(known)
    own, before, after = (w[rows].sum(1) for w in weights)
    out = own[place]
    stops = np.cumsum(lengths)
    first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    first[stops - lengths], last[stops - 1] = True, True
    out += np.where(first[:, None], weights[1, -1], before[np.roll(place, 1)])
    out += np.where(last[:, None], weights[2, -1], after[np.roll(place, -1)])
    return out


def viterbi(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of all sequences at once: step t works on the sequences that
    are longer than t, which the sort by length makes a prefix."""
    order = np.argsort(-lengths, kind="stable")
    size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")         # sequences longer than t
    score = emission[begin].copy()
    back = []
    for t in range(1, longest):
        n = alive[t]
        options = score[:n, :, None] + moves[None]
        back.append(options.argmax(1))
        score[:n] = options.max(1) + emission[begin[:n] + t]
    labels = np.zeros(len(emission), np.int64)
    current = score.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        labels[begin[:n] + t] = current[:n]
        if t:
            current[:n] = back[t - 1][np.arange(n), current[:n]]
    return labels


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def gold(table, starts, ends, lengths, begins) -> np.ndarray:
    """Labels of the sequences' words under the table's spans."""
    labels = np.zeros(len(starts), np.int64)
    owner = np.searchsorted(begins, starts, "right") - 1
    for i, (s, e, o) in enumerate(zip(starts.tolist(), ends.tolist(), owner.tolist())):
        for a, b, kind in table[o][1]:
            a, b = a + begins[o], b + begins[o]
            if s < b and e > a:
                labels[i] = 1 + 2 * kind + (s > a)
    return labels


@lru_cache(maxsize=4)
def train(rows: int = TRAIN_ROWS, seed: int = 7, rounds: int = 100, decay: float = 1e-3):
    """Weights (own word, word before, word after) and label moves: maximum
    likelihood by forward-backward and Adam on the labelled table."""
    table = labelled_table(rows, seed)
    codes, starts, ends, lengths, begins = sequences([t for t, _ in table])
    target = gold(table, starts, ends, lengths, begins)
    known, place = np.unique(codes, return_inverse=True)
    hot = np.zeros((len(known) + 1, N_ATTR))
    hot[np.arange(len(known))[:, None], attributes(known)] = 1
    hot[-1, -1] = 1
    n, longest = len(lengths), int(lengths.max())
    begin = np.cumsum(lengths) - lengths
    grid = np.minimum(begin[:, None] + np.arange(longest), len(codes) - 1)
    live = np.arange(longest) < lengths[:, None]
    none = len(known)
    own = np.where(live, place[grid], none)
    before = np.concatenate([np.full((n, 1), none), own[:, :-1]], 1)
    after = np.concatenate([own[:, 1:], np.full((n, 1), none)], 1)
    truth = np.eye(N_LABEL)[np.where(live, target[grid], 0)] * live[:, :, None]
    pair = np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:])
    params = [np.zeros((3, N_ATTR, N_LABEL)), np.zeros((N_LABEL, N_LABEL))]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        weights, moves = params
        by_code = np.einsum("ca,pal->pcl", hot, weights)
        emission = by_code[0][own] + by_code[1][before] + by_code[2][after]
        alpha, beta = np.zeros_like(emission), np.zeros_like(emission)
        alpha[:, 0] = emission[:, 0]
        for t in range(1, longest):
            nxt = _logsum(alpha[:, t - 1, :, None] + moves, 1) + emission[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = _logsum(moves + (emission[:, t + 1] + beta[:, t + 1])[:, None], 2)
            beta[:, t] = np.where(live[:, t + 1, None], nxt, 0)
        total = _logsum(alpha[:, -1], 1)
        share = np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
        scale = alpha[:, :-1].max(2, keepdims=True)
        left = np.exp(alpha[:, :-1] - scale).reshape(-1, N_LABEL)
        right = (np.exp((emission + beta)[:, 1:] + scale - total[:, None, None])
                 * live[:, 1:, None]).reshape(-1, N_LABEL)
        joint = np.exp(moves) * (left.T @ right)
        gap = (truth - share).reshape(-1, N_LABEL)
        grads = [np.empty_like(weights), pair - joint - decay * n * moves]
        for p, at in enumerate((own, before, after)):
            sums = np.zeros((len(known) + 1, N_LABEL))
            np.add.at(sums, at.ravel(), gap)
            grads[0][p] = hot.T @ sums - decay * n * weights[p]
        for k in range(2):
            mean[k] = 0.9 * mean[k] + 0.1 * grads[k]
            var[k] = 0.999 * var[k] + 0.001 * grads[k] ** 2
            params[k] = params[k] + 0.1 * (mean[k] / (1 - 0.9 ** step)) / (
                np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)
    return params[0], params[1]


# --- decoding ---------------------------------------------------------------

_EDGE = ".,;:!?\"'"


def valid(value: str, kind: int) -> bool:
    """Whether a decoded span holds a value of its kind once written plainly."""
    if kind == 0:
        plain = re.sub(r"\s*[\[(]\s*at\s*[\])]\s*|\s*@\s*", "@", value, flags=re.I)
        plain = re.sub(r"\s*[\[(]\s*dot\s*[\])]\s*|\s*\.\s*", ".", plain, flags=re.I)
        return bool(_EMAIL.fullmatch(plain))
    digits = re.sub(r"[^0-9]", "", value)
    if kind == 1:
        plain = re.sub(r"\s*\[?\.\]?\s*", ".", value)
        return bool(_IP.fullmatch(plain)) and all(len(p) <= 3 and int(p) <= 255 for p in plain.split("."))
    if kind == 2:
        return (bool(re.fullmatch(r"[0-9][0-9\s./_-]*[0-9]", value)) and 14 <= len(digits) <= 19 and luhn(digits))
    return (bool(re.fullmatch(r"[+(]?[0-9][0-9\s().+/-]*[0-9]", value)) and 10 <= len(digits) <= 15
            and len(value) - len(digits) >= 2)


def added_spans(texts: list[str], model, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Decoded spans that hold a valid value and overlap no pattern match."""
    weights, moves = model
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    codes, starts, ends, lengths, begins = sequences(texts)
    if not len(codes):
        return out
    labels = viterbi(_emissions(weights, codes, lengths), lengths, moves)
    at = np.flatnonzero(labels)
    head = np.zeros(len(codes), bool)
    head[np.cumsum(lengths) - lengths] = True
    run: list[int] = []

    def close() -> None:
        if not run:
            return
        kind = (int(labels[run[0]]) - 1) // 2
        s, e = int(starts[run[0]]), int(ends[run[-1]])
        o = int(np.searchsorted(begins, s, "right")) - 1
        s, e = s - int(begins[o]), e - int(begins[o])
        value = texts[o][s:e]
        s, e = s + len(value) - len(value.lstrip(_EDGE)), e - (len(value) - len(value.rstrip(_EDGE)))
        if s < e and valid(texts[o][s:e], kind) and not any(a < e and b > s for a, _, b in base[o]):
            out[o].append((s, kind, e))

    for i in at.tolist():
        label = int(labels[i])
        inside = run and i == run[-1] + 1 and not head[i] and label % 2 == 0 and (
            (label - 1) // 2 == (int(labels[run[0]]) - 1) // 2)
        if not inside:
            close()
            run = []
        run.append(i)
    close()
    return out


def _finder(names: list[str], model):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(lo, BATCH_ROWS)
                texts = [t or "" for t in piece.column("_text").to_pylist()]
                base = [base_spans(t) for t in texts]
                extra = added_spans(texts, model, base)
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "rule": r} for s, k, e, r in
                          sorted([(s, k, e, True) for s, k, e in b] + [(s, k, e, False) for s, k, e in x])]
                         for b, x in zip(base, extra)]
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names]
                                                 + [pa.array(spans, pa.list_(span))], names=names + ["_spans"])
    return run


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                              StructField("end", LongType()), StructField("rule", BooleanType())]))


def find_pii(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive) and
    whether a pattern (``rule``) or the field found it, by start and kind.

    Null and empty texts have no spans; repeated rows get equal spans; an empty
    table gives none; an input column ``spans`` is replaced. A scan without a
    shuffle; memory is a batch of rows or one text.
    """
    names = [c for c in docs.columns if c.lower() != "spans"]
    rows = docs.select(*[docs[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(names)], docs["text"].alias("_text"))
    own = [f"_c{i}" for i in range(len(names))]
    schema = carried(docs, names, [StructField("_spans", SPANS)])
    found = in_arrow(rows, _finder(own, train(train_rows)), schema)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], F.col("_spans").alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """``text`` with every span replaced by ``<KIND>``; where spans overlap, the
    one that starts first stands for both."""
    piece = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
        .otherwise(F.struct(
            F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                     F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).alias("out"), s["end"].alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return found.withColumn("text", piece)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def contract(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["rule"])

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: ~s["rule"])).cast("long").alias("n_added"))
