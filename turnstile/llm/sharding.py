"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns ``vnodes`` positions on
it; a key hashes to a cell and belongs to the first virtual node clockwise.
Shards have a capacity in rows: keys are admitted in ring order, and what finds
its shard full continues clockwise to the next virtual node whose shard has
room. With ``load_factor`` 1 the capacities add up to exactly the number of
rows, so counts differ by at most one; a larger factor leaves slack and moves
fewer rows when a shard is added.

The walk only needs the number of keys per cell, so the driver gets at most
``CELLS`` counts whatever the input, and the rows themselves find their place
by their rank inside a cell.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pack, stash, unpack

CELLS = 1 << 14           # ring cells: bounds the driver's counts and the broadcast plan
VNODES = 64
HOT_FACTOR = 50           # a cell this many times over the mean is ranked in salted parts
TIE_PARTS = 256                # parts of a hot cell


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Sorted ``(cell, shard)`` of all virtual nodes."""
    spots = []
    for s in range(n_shards):
        for v in range(vnodes):
            h = hashlib.md5(f"shard {s} vnode {v}".encode()).hexdigest()
            spots.append((int(h[:15], 16) % CELLS, h, s))
    return [(c, s) for c, _, s in sorted(spots)]


def capacities(rows: int, n_shards: int, load_factor: float = 1.0) -> list[int]:
    if load_factor < 1:
        raise ValueError("load_factor must be at least 1")
    if load_factor == 1:
        low, more = divmod(rows, n_shards)
        return [low + (s < more) for s in range(n_shards)]
    return [math.ceil(load_factor * rows / n_shards)] * n_shards


def fill(counts: dict[int, int], n_shards: int, load_factor: float = 1.0,
         vnodes: int = VNODES) -> list[tuple[int, int, int, int]]:
    """Walk the ring: ``(cell, first rank, shard, first slot)`` segments."""
    spots = ring(n_shards, vnodes)
    cells = [c for c, _ in spots]
    room = capacities(sum(counts.values()), n_shards, load_factor)
    used = [0] * n_shards
    nxt = list(range(len(spots) + 1))              # next virtual node that may have room

    def live(i: int) -> int:
        path = []
        while True:
            while nxt[i] != i:
                path.append(i)
                i = nxt[i]
            if i < len(spots) and used[spots[i][1]] >= room[spots[i][1]]:
                nxt[i] = i + 1
                continue
            for p in path:
                nxt[p] = i
            return i

    segments = []
    for cell in sorted(counts):
        rank, left = 0, counts[cell]
        i = bisect_left(cells, cell)
        while left:
            i = live(i)
            if i == len(spots):
                i = live(0)
            s = spots[i][1]
            take = min(left, room[s] - used[s])
            segments.append((cell, rank, s, used[s]))
            used[s] += take
            rank += take
            left -= take
    return segments


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", ties: list[Column] | None = None,
                  load_factor: float = 1.0, vnodes: int = VNODES) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 per shard).

    Null keys hash as the text ``null``; repeated keys and repeated rows each
    take a slot of their own (ties ordered by ``ties``); an empty table gives
    an empty result; input columns named ``shard`` or ``slot`` are replaced.
    One shuffle carries the rows to their cell. A cell far over the mean (one
    key repeated over a large part of the rows) is ranked in parts by a hash of
    the ties, the parts one after the other; rows of one and the same tie that
    are many by themselves are interchangeable and are parted by where they
    were read. Which row gets which slot therefore depends on keys and ties
    alone, not on the partitioning of the input.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark, columns = docs.sparkSession, docs.columns
    digest = F.md5(F.coalesce(docs[key].cast("string"), F.lit("null")).cast("binary"))
    position = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    rows = pack(docs, {"_pos": position, **{f"_t{i}": c for i, c in enumerate(ties or [])}})
    rows = rows.withColumn("_cell", (F.col("_pos") % CELLS).cast("int")).withColumn("_sub", F.lit(0).cast("long"))
    counts = {r["_cell"]: r["count"] for r in rows.groupBy("_cell").count().collect()}
    hot = [c for c, n in counts.items() if n > HOT_FACTOR * max(200, sum(counts.values()) / CELLS)]
    bases: list[tuple[int, int, int]] = []
    if hot:
        most = HOT_FACTOR * max(200, sum(counts.values()) / CELLS)
        names = [f"_t{i}" for i in range(len(ties or []))]
        rows = rows.withColumn("_tie", F.when(F.col("_cell").isin(hot), F.xxhash64(*names) if names else F.lit(0).cast("long")))
        heavy = rows.where("_tie is not null").groupBy("_cell", "_tie").count().where(F.col("count") > most).select(
            "_cell", "_tie").collect()                      # each over HOT_FACTOR mean cells: at most CELLS / HOT_FACTOR
        many = spark.createDataFrame([(r["_cell"], r["_tie"], i + 1) for i, r in enumerate(
            sorted(heavy, key=lambda r: (r["_cell"], r["_tie"])))], "_cell int, _tie long, _many long")
        rows = stash(rows.join(F.broadcast(many), ["_cell", "_tie"], "left").withColumn(
            "_sub", F.when(F.col("_many").isNotNull(), F.col("_many") * (1 << 32) + F.spark_partition_id())
            .when(F.col("_tie").isNotNull(), F.pmod("_tie", F.lit(TIE_PARTS)) + 1).otherwise(0)).drop("_tie", "_many"), "ring")
        parts = rows.where("_sub > 0").groupBy("_cell", "_sub").count().collect()
        at: dict[int, int] = {}
        for r in sorted(parts, key=lambda r: (r["_cell"], r["_sub"])):
            bases.append((r["_cell"], r["_sub"], at.get(r["_cell"], 0)))
            at[r["_cell"]] = at.get(r["_cell"], 0) + r["count"]
    plan: dict[int, list[tuple[int, int, int]]] = {}
    for cell, first, shard, slot in fill(counts, n_shards, load_factor, vnodes):
        plan.setdefault(cell, []).append((first, shard, slot))
    segments = spark.createDataFrame(
        list(plan.items()), "_cell int, _plan array<struct<first:long, shard:int, slot:long>>")
    order = ["_pos", *[f"_t{i}" for i in range(len(ties or []))]]
    out = rows.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_cell", "_sub").orderBy(*order)).cast("long") - 1)
    if bases:
        out = out.join(F.broadcast(spark.createDataFrame(bases, "_cell int, _sub long, _base long")),
                       ["_cell", "_sub"], "left").withColumn(
            "_rank", F.col("_rank") + F.coalesce("_base", F.lit(0)))
    out = out.join(F.broadcast(segments), "_cell")          # at most CELLS rows
    own = F.element_at(F.filter("_plan", lambda s: s["first"] <= F.col("_rank")), -1)
    out = out.withColumn("_own", own)
    return unpack(out, columns, {"shard": F.col("_own.shard"),
                                 "slot": F.col("_own.slot") + F.col("_rank") - F.col("_own.first")})


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a shard is cut into runs of
    slots so that no task holds a whole shard."""
    run = 1 << 18
    (placed.withColumn("_run", F.floor(F.col("slot") / run))
     .repartition("shard", "_run").sortWithinPartitions("shard", "slot").drop("_run")
     .write.partitionBy("shard").parquet(path))


def contract(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Digest rows of ``op2``: law ``rows`` (capacities are exact)."""
    text = docs["text"]
    narrow = docs.select(
        docs["doc_id"],
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = assign_shards(narrow, n_shards, "doc_id", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
