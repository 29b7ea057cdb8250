"""Mixing sources to target weights by deterministic repetition.

Sizes are summed per source, every source gets a target (its share of the whole
by weight, capped at ``max_repeat`` times what it has, the excess reshared by
weight), and a document of a source with rate r = target / source size is
emitted floor(r) times plus one more copy when a hash of its id falls under the
fraction of r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, pack, ranked, stash, unpack

MAX_REPEAT = 3
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A join key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) from the id: 13 hex digits of an md5."""
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(label.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def reshare(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sources(_key, _size, _weight)`` with ``_target``. Each round caps the
    sources whose share exceeds their cap and reshares the rest; only three
    numbers per round reach the driver, and the set of capped sources only
    grows, so the loop ends."""
    cap = F.col("_size") * max_repeat
    total, weight = sources.agg(F.sum("_size"), F.sum("_weight")).first()
    total, weight = total or 0, weight or 0
    rest, free = total, weight
    while True:
        over = cap.cast("double") * F.lit(float(free)) < F.col("_weight").cast("double") * F.lit(float(rest))
        taken, capped = sources.where(over).agg(F.sum(cap), F.sum("_weight")).first()
        now = (total - (taken or 0), weight - (capped or 0))
        if now == (rest, free):
            break
        rest, free = now
    share = F.col("_weight").cast("double") * F.lit(float(rest)) / F.lit(float(free or 1))
    return sources.withColumn("_target", F.when(over, cap.cast("double")).otherwise(share))


def plan_copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = MAX_REPEAT,
                seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with ``size`` (words), ``source_size``,
    ``target``, ``rate`` (double) and ``copies`` (int).

    Sources in code point order, null last, take ``weights`` in turn. Null text
    has size 0; a source without words has rate 0; repeated ids share one draw,
    so repeated rows get equally many copies; an empty table gives none. Input
    columns of the output names are replaced. The sum per source is combined
    before the shuffle; the join to the source table is a broadcast only when
    the written table is under the session's threshold, else a sort-merge join
    that AQE splits for a hot source.
    """
    columns = docs.columns
    rows = pack(docs, {"_key": source_key(docs["source"]), "_words": word_count(docs["text"]),
                       "_draw": draw(docs["doc_id"], seed)})
    sums = (docs.select(source_key(docs["source"]).alias("_key"), docs["source"].cast("string").alias("_source"),
                        word_count(docs["text"]).alias("_words"))
            .groupBy("_key", "_source").agg(F.sum("_words").alias("_size")))
    order = ranked(sums, [F.col("_source").asc_nulls_last()], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = stash(order.select("_key", "_size", weight.cast("long").alias("_weight")), "mix-weights")
    targets = stash(reshare(sources, max_repeat), "mix-targets").withColumn(
        "_rate", F.when(F.col("_size") > 0, F.least(F.lit(float(max_repeat)),
                                                   F.col("_target") / F.col("_size"))).otherwise(0.0))
    whole = F.floor("_rate")
    copies = (whole + F.when(F.col("_draw") < F.col("_rate") - whole, 1).otherwise(0)).cast("int")
    return unpack(rows.join(targets, "_key"), columns,
                  {"size": F.col("_words"), "source_size": F.col("_size"), "target": F.col("_target"),
                   "rate": F.col("_rate"), "copies": copies})


def emit(planned: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: every planned document ``copies`` times (``max_repeat``
    at most, so the generator is bounded)."""
    return (planned.where("copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[f"`{c}`" for c in columns]))


def contract(docs: DataFrame) -> DataFrame:
    planned = plan_copies(docs.select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target",
                          (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size) AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, sum(ss) OVER () AS total,
             coalesce(sum(3 * ss) OVER before, 0) AS fixed,
             sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free
      FROM w WINDOW before AS (ORDER BY ss::DOUBLE / w, source NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (3 * ss)::DOUBLE * free::DOUBLE < w::DOUBLE * (total - fixed)::DOUBLE AS capped FROM o),
r AS (SELECT sum(w) FILTER (WHERE NOT capped) AS free,
             max(total) - coalesce(sum(3 * ss) FILTER (WHERE capped), 0) AS rest FROM c),
t AS (SELECT c.source, c.ss,
             CASE WHEN capped THEN (3 * ss)::DOUBLE
                  ELSE w::DOUBLE * r.rest::DOUBLE / coalesce(r.free, 1)::DOUBLE END AS target
      FROM c, r),
k AS (SELECT *, CASE WHEN ss > 0 THEN least(3.0::DOUBLE, target / ss::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
u AS (SELECT d.doc_id, d.size, k.ss, k.target, k.rate,
             ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
               / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""
