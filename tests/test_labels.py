"""Alias matching by grams against plain containment."""

import random

from turnstile.operators import labels as L


def _best(text, aliases):
    hits = [(len(a), -o, lab) for a, lab, o in aliases if a is not None and a.lower() in text.lower()]
    return max(hits)[2] if hits else None


def _check(spark, texts, aliases):
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    table = spark.createDataFrame(aliases, "alias string, label string, ord int")
    got = {r.request_id: r.label for r in L.alias_theta_join(rows, table).collect()}
    truth = {i: _best(t, aliases) for i, t in enumerate(texts) if t is not None}
    assert got == {i: lab for i, lab in truth.items() if lab is not None}


def test_labels_equal_plain_containment(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcÉ ") for _ in range(n))
    aliases = [(word(rng.randint(1, 7)), f"l{i % 9}", i) for i in range(120)] + [(None, "none", 500)]
    texts = [word(rng.randint(0, 40)) for _ in range(150)] + [None, "", "ABC É"] + ["abcabc"] * 3
    _check(spark, texts, aliases)
    _check(spark, texts, aliases[:5] + [("", "empty", 900)])
    _check(spark, texts, [])


def test_many_aliases(spark):
    aliases = [(f"alias {i:06d} of many", f"l{i}", i) for i in range(120_000)]
    texts = [f"says alias {i:06d} of many, and alias {i + 1:06d} of many" for i in (5, 77_777, 119_998)] + ["alias 5 of many"]
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    got = L.alias_theta_join(rows, spark.createDataFrame(aliases, "alias string, label string, ord int"))
    assert {r.request_id: r.label for r in got.collect()} == {0: "l5", 1: "l77777", 2: "l119998"}
