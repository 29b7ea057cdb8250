"""Preference formatting with DataFrame functions only.

Two conversations of a pair, chosen and rejected, are compared turn by turn.
Everything before the first turn in which they differ is the prompt, rendered
once; what follows is rendered per side, with the character spans that a
trainer may learn from (assistant texts and their end marks) as a mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>\n"


def _turn(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)).cast("long"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``chosen`` and ``rejected`` with ``pair_id, turn, role, text`` give one row
    per pair: ``prompt``, ``chosen``, ``rejected`` (text), ``chosen_mask``,
    ``rejected_mask`` (arrays of start, end in code points) and turn counts.

    Turns are aligned by number, a null number first; several rows of one turn
    stand together in order of role and text, so repeated rows stay. A null
    role is ``unknown``, a null text empty; a turn missing on one side counts as
    a difference; identical sides leave both completions empty; a null
    ``pair_id`` is a pair of its own; an empty table gives none; further columns
    are ignored. Turns are compared by (pair, turn), so one very long
    conversation is compared by many tasks; only the finished strings meet in
    the pair's one row.
    """
    def side(df: DataFrame, k: int) -> DataFrame:
        return df.select(df["pair_id"].alias("p"), F.lit(k).alias("side"), _turn(df["turn"]).alias("t"),
                         F.struct(F.coalesce(df["role"], F.lit("unknown")).alias("role"),
                                  F.coalesce(df["text"], F.lit("")).alias("text")).alias("said"))

    turns = side(chosen, 0).unionByName(side(rejected, 1))
    pairs = turns.groupBy("p", "t").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.col("said")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.col("said")))).alias("b"))
    differs = F.min(F.when(F.col("a") != F.col("b"), F.col("t")))
    first = pairs.groupBy("p").agg(differs.alias("first"))
    marked = pairs.join(first.withColumnRenamed("p", "q"), F.col("p").eqNullSafe(F.col("q"))).drop("q")
    common = F.col("first").isNull() | (F.col("t") < F.col("first"))
    parts = F.when(common, F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("rows")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("a").alias("rows")),
                F.struct(F.lit("rejected").alias("part"), F.col("b").alias("rows"))))
    rows = (marked.select("p", "t", F.explode(parts).alias("x"))
            .select("p", "t", "x.part", F.posexplode("x.rows").alias("i", "said")))
    head = F.concat(F.lit("<|"), F.col("said.role"), F.lit("|>\n"))
    drawn = rows.select("p", "t", "i", "part", head.alias("head"), F.concat(F.col("said.text"), F.lit(END)).alias("body"),
                        ((F.col("said.role") == "assistant") & (F.col("part") != "prompt")).alias("learn"))
    before = Window.partitionBy("p", "part").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body")
    placed = drawn.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    begin = F.col("at") + F.length("head")
    pieces = placed.groupBy("p", "part").agg(F.sort_array(F.collect_list(F.struct(
        "at", F.concat("head", "body").alias("s"), "learn", begin.alias("start"),
        (begin + F.length("body")).alias("end")))).alias("w"))
    whole = pieces.select(
        "p", "part", F.concat_ws("", F.transform("w", lambda x: x["s"])).alias("s"), F.size("w").alias("n"),
        F.transform(F.filter("w", lambda x: x["learn"]),
                    lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("mask"))

    def of(part: str, what: str) -> Column:
        return F.first(F.when(F.col("part") == part, F.col(what)), ignorenulls=True)

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return whole.groupBy("p").agg(
        F.coalesce(of("prompt", "s"), F.lit("")).alias("prompt"), F.coalesce(of("chosen", "s"), F.lit("")).alias("chosen"),
        F.coalesce(of("rejected", "s"), F.lit("")).alias("rejected"),
        F.coalesce(of("chosen", "mask"), none).alias("chosen_mask"),
        F.coalesce(of("rejected", "mask"), none).alias("rejected_mask"),
        *[F.coalesce(of(k, "n"), F.lit(0)).cast("long").alias(f"n_{k}") for k in ("prompt", "chosen", "rejected")],
    ).withColumnRenamed("p", "pair_id")


def preference_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations, one for each: chosen is the conversation;
    rejected repeats it up to its last assistant turn and there has the last
    assistant turn of the neighbouring conversation (the id with its lowest bit
    flipped), if that exists. A conversation without an assistant turn is its
    own rejected side. Only rows of one turn and one (role, text) per partner
    are joined, so the join adds no more rows than it reads."""
    c = conversations.select("conv_id", _turn(conversations["turn"]).alias("turn"), "role", "text")
    last = c.where("role = 'assistant'").groupBy("conv_id").agg(
        F.max("turn").alias("_last"),
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).getField("text").alias("_answer"))
    own = last.select(F.col("conv_id").alias("_id"), "_last")
    marked = c.join(own, c["conv_id"].eqNullSafe(own["_id"]), "left").drop("_id")
    kept = marked.where("_last is null or turn < _last").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("_for"), "_answer")
    swapped = own.join(answers, own["_id"] == answers["_for"]).select(
        F.col("_id").alias("pair_id"), F.col("_last").alias("turn"), F.lit("assistant").alias("role"), F.col("_answer").alias("text"))
    chosen = c.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return chosen, kept.unionByName(swapped)


def contract(conversations: DataFrame) -> DataFrame:
    rows = format_preferences(*preference_pairs(conversations))

    def spans(mask: str) -> Column:
        return F.concat_ws(",", F.transform(mask, lambda x: F.concat_ws(":", x["start"], x["end"])))

    return rows.select("pair_id", "prompt", "chosen", "rejected", spans("chosen_mask").alias("chosen_mask"),
                       spans("rejected_mask").alias("rejected_mask"), "n_prompt", "n_chosen", "n_rejected")


ORACLE = r"""
WITH c AS (SELECT conv_id AS id, coalesce(turn, -9223372036854775808) AS t, coalesce(role, 'unknown') AS role,
                  coalesce(text, '') AS text FROM conversations),
l AS (SELECT id, max(t) AS last, max_by(text, struct_pack(t := t, s := text)) AS answer
      FROM c WHERE role = 'assistant' GROUP BY id),
r AS (SELECT c.id, c.t, c.role, c.text FROM c LEFT JOIN l ON c.id IS NOT DISTINCT FROM l.id
      WHERE l.last IS NULL OR c.t < l.last
      UNION ALL
      SELECT a.id, a.last, 'assistant', b.answer FROM l a JOIN l b ON a.id = xor(b.id, 1)),
u AS (SELECT 'chosen' AS side, * FROM c UNION ALL SELECT 'rejected', * FROM r),
d AS (SELECT id, t, list(struct_pack(r := role, s := text) ORDER BY role, text) FILTER (WHERE side = 'chosen') AS a,
             list(struct_pack(r := role, s := text) ORDER BY role, text) FILTER (WHERE side = 'rejected') AS b
      FROM u GROUP BY id, t),
f AS (SELECT id, min(t) FILTER (WHERE a IS DISTINCT FROM b) AS first FROM d GROUP BY id),
s AS (SELECT u.id, u.t, u.role, u.text,
             CASE WHEN f.first IS NULL OR u.t < f.first THEN 'prompt' ELSE u.side END AS part
      FROM u JOIN f ON u.id IS NOT DISTINCT FROM f.id
      WHERE u.side = 'chosen' OR (f.first IS NOT NULL AND u.t >= f.first)),
p AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM s),
o AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER w - length(head) - length(body) AS pos
      FROM p WINDOW w AS (PARTITION BY id, part ORDER BY t, role, text ROWS UNBOUNDED PRECEDING)),
g AS (SELECT id, part, string_agg(head || body, '' ORDER BY k) AS s, count(*) AS n,
             string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(body))::BIGINT, ',' ORDER BY k)
               FILTER (WHERE role = 'assistant' AND part <> 'prompt') AS mask
      FROM o GROUP BY id, part)
SELECT id AS pair_id,
       coalesce(max(s) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(max(s) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(max(s) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(max(mask) FILTER (WHERE part = 'chosen'), '') AS chosen_mask,
       coalesce(max(mask) FILTER (WHERE part = 'rejected'), '') AS rejected_mask,
       coalesce(max(n) FILTER (WHERE part = 'prompt'), 0)::BIGINT AS n_prompt,
       coalesce(max(n) FILTER (WHERE part = 'chosen'), 0)::BIGINT AS n_chosen,
       coalesce(max(n) FILTER (WHERE part = 'rejected'), 0)::BIGINT AS n_rejected
FROM g GROUP BY id
"""
