"""Conversation prefix trie by truncation peeling.

A node is a distinct sequence of first turns. The trie is taken off from its
deepest turn: at each depth the conversations that end there join the nodes
that survived from below, the last turn is stripped, and equal remainders are
grouped again, so a node is found and its counts are summed in the same pass.

Conversations enter only as distinct ends (equal conversations are combined
first), each carried by its smallest id, whose path stands for the node. A path
is stored in blocks of turns, as the keys of its prefixes (a hash chained turn
by turn). Blocks are peeled deepest first. Inside a block all that hangs under
one prefix is peeled together in a task; a prefix with more than
``GROUP_ENTRIES`` path entries under it, and the first block, whose prefixes
are few and hot, are peeled depth by depth with grouped aggregations, which
combine before the shuffle. Both give the same nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow, ranked, spread, stash

FIRST_BLOCK = 8                # turns of the first block; each further one reaches twice as deep
MOST_BLOCK = 1024              # turns of a block at most
GROUP_ENTRIES = 1 << 18        # path entries peeled in one task at once
ID_SPAN = 4096                 # ids joined into one piece of text before hashing
ROOT = bytes(16)

NODE = ("depth int, key binary, parent_key binary, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long")


def token(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn's role and text (null: empty)."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256),
                               1, 32))


def block_of(depth: Column) -> Column:
    """Number of the path block that holds a depth (from 1)."""
    eighths = F.floor((depth - 1) / FIRST_BLOCK).cast("long")
    doubling = F.when(eighths == 0, 0).otherwise(F.length(F.bin(eighths)))
    further = (MOST_BLOCK // FIRST_BLOCK).bit_length() + F.floor((depth - MOST_BLOCK - 1) / MOST_BLOCK)
    return F.when(depth <= MOST_BLOCK, doubling).otherwise(further).cast("long")


def bounds_of(block: int) -> tuple[int, int]:
    """Depths ``(low, high]`` of a block."""
    if block == 0:
        return 0, FIRST_BLOCK
    last = (MOST_BLOCK // FIRST_BLOCK).bit_length() - 1
    if block <= last:
        return FIRST_BLOCK << (block - 1), FIRST_BLOCK << block
    return MOST_BLOCK * (block - last), MOST_BLOCK * (block - last + 1)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` as ``(conv_id, ord, tok, bytes)``:
    1-based position by turn, null first; equal turns follow in an order fixed
    by their content. The text goes no further than this scan. Positions come
    from a global rank, so a conversation may span tasks. Rows without a
    conv_id belong to no conversation and are left out."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        token(F.col("role"), F.col("text")).alias("tok"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"))
    ranks = stash(ranked(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tok")], "trie-order"),
                  "trie-ranks")
    first = ranks.groupBy("conv_id").agg(F.min("_rank").alias("_first"))
    return ranks.join(first, "conv_id").select(
        "conv_id", (F.col("_rank") - F.col("_first") + 1).alias("ord"), "tok", "bytes")


def rebuild(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: ``(paths, conversations)``.

    Every conversation c takes the first h turns (h = crc32 of its decimal id
    modulo ``heads``) of conversation c - c % ``group``, as many as there are,
    then its own turns after the first h. ``conversations(conv_id)`` has every
    id, also one that ends up without turns."""
    rows = stash(ordered_turns(turns), "trie-turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    convs = rows.select("conv_id").distinct().select(
        "conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lead = rows.where(F.col("ord") < heads).groupBy(F.col("conv_id").alias("base")).agg(     # heads - 1 turns at most
        F.array_sort(F.collect_list(F.struct("ord", "tok", "bytes"))).alias("lead"))
    plans = stash(convs.join(lead, "base", "left").select(
        "conv_id", "h", F.filter(F.coalesce("lead", F.array()), lambda e: e["ord"] <= F.col("h")).alias("lead")),
        "trie-plans")
    own = rows.join(plans.select("conv_id", "h", F.size("lead").alias("k")), "conv_id").where("ord > h").select(
        "conv_id", (F.col("ord") - F.col("h") + F.col("k")).alias("ord"), "tok", "bytes")
    borrowed = plans.select("conv_id", F.explode("lead").alias("e")).select("conv_id", "e.*")
    return own.unionByName(borrowed), plans.select("conv_id")


def path_blocks(paths: DataFrame) -> DataFrame:
    """``paths(conv_id, ord, tok, bytes)`` as one row per conversation and block
    of turns: ``(conv_id, block, low_key, keys, bytes)`` with the keys of all
    prefixes that end in the block and of the one before it. The chain streams
    through a task one block at a time."""
    blocks = paths.groupBy("conv_id", block_of(F.col("ord")).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "tok", "bytes"))).alias("turns"))          # MOST_BLOCK at most
    flat = blocks.select("conv_id", "block", F.col("turns.tok").alias("toks"), F.col("turns.bytes").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key = None, ROOT
        for batch in batches:
            lows, keys = [], []
            for c, toks in zip(batch.column("conv_id").to_pylist(), batch.column("toks").to_pylist()):
                if c != conv:
                    conv, key = c, ROOT
                lows.append(key)
                chain = []
                for t in toks:
                    key = hashlib.blake2b(key + t, digest_size=16).digest()
                    chain.append(key)
                keys.append(chain)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(lows, pa.binary()),
                 pa.array(keys, pa.list_(pa.binary())), batch.column("bytes")],
                ["conv_id", "block", "low_key", "keys", "bytes"])
    dealt = flat.repartition(spread(paths), "conv_id").sortWithinPartitions("conv_id", "block")
    return in_arrow(dealt, run, "conv_id long, block long, low_key binary, keys array<binary>, bytes array<long>")


def id_digests(ends: DataFrame) -> DataFrame:
    """``ends(key, conv_id)`` as ``(key, ends_sha256)``: SHA-256 of the decimal
    ids of each key, ascending, comma-joined. Ids are joined in spans of
    ``ID_SPAN`` values, so no list grows with a key; the spans of a key stream
    in order through its digest."""
    pieces = ends.groupBy("key", F.floor(F.col("conv_id") / F.lit(ID_SPAN)).alias("span")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())],
                                             ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])],
                                             ["key", "ends_sha256"])
    dealt = pieces.repartition(spread(ends), "key").sortWithinPartitions("key", "span")
    return in_arrow(dealt, run, "key binary, ends_sha256 string")


def _peel_group(low: int, low_key: bytes, members: list[tuple]) -> list[tuple]:
    """Nodes at depths above ``low`` of the participants under one prefix. A
    participant is (conv_id, depth, n_convs, n_children, n_leaves, saved, keys,
    bytes): a survivor's children or an end, with its path in the block."""
    waiting: dict[int, list[tuple]] = {}
    for m in members:
        waiting.setdefault(m[1], []).append(m)
    out, carried = [], []
    for depth in range(max(waiting), low, -1):
        at = depth - low - 1
        nodes: dict[bytes, list] = {}
        for conv, _, n, children, leaves, saved, keys, sizes in waiting.get(depth, []) + carried:
            node = nodes.get(keys[at])
            if node is None:
                nodes[keys[at]] = [conv, n, children, leaves, saved, keys, sizes]
                continue
            if conv < node[0]:
                node[0], node[5], node[6] = conv, keys, sizes
            node[1] += n
            node[2] += children
            node[3] += leaves
            node[4] += saved
        carried = []
        for key, (conv, n, children, leaves, saved, keys, sizes) in nodes.items():
            leaves = leaves if children else 1
            saved += (n - 1) * sizes[at]
            out.append((depth, key, keys[at - 1] if at else low_key, conv, n, children, leaves, saved))
            carried.append((conv, depth - 1, n, 1, leaves, saved, keys, sizes))
    return out


def _peel_tasks(low: int):
    """``mapInArrow`` over participants in order of their low key."""
    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "keys", "bytes")
    fields = [(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]])
              for f in NODE.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)],
                                          [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, members = None, []
        for batch in batches:
            done: list[tuple] = []
            for key, *row in zip(batch.column("low_key").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                if key != prefix and members:
                    done += _peel_group(low, prefix, members)
                    members = []
                prefix = key
                members.append(tuple(row))
            if done:
                yield emit(done)
        if members:
            yield emit(_peel_group(low, prefix, members))
    return run


def peel_depth(participants: DataFrame, depth: int, low: int) -> DataFrame:
    """Nodes of one depth from all that reaches it: ``NODE`` columns, and the
    path (``low_key``, ``keys``, ``bytes``) of each node's smallest member."""
    at = depth - low - 1
    merged = participants.groupBy(F.col("keys")[at].alias("key")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"),
        # all members share the path up to here, and nothing past it is read again
        F.min(F.slice("keys", 1, depth - low)).alias("keys"), F.min(F.slice("bytes", 1, depth - low)).alias("bytes"),
        F.min("low_key").alias("low_key"))
    parent = F.col("keys")[at - 1] if at else F.col("low_key")
    return merged.select(
        F.lit(depth).alias("depth"), "key", parent.alias("parent_key"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("_leaves")).alias("n_leaves"),
        (F.col("_saved") + (F.col("n_convs") - 1) * F.col("bytes")[at]).alias("saved_tokens"),
        "low_key", "keys", "bytes")


_COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_PARTICIPANT = ["conv_id", "depth", *_COUNTS, "low_key", "keys", "bytes"]
_NODE = ["depth", "key", "parent_key", "conv_id", *_COUNTS]


def _surviving(nodes: DataFrame) -> list[Column]:
    """A node as a participant one turn shorter: one child of its parent."""
    return [F.col("conv_id"), (F.col("depth") - 1).cast("int").alias("depth"), F.col("n_convs"),
            F.lit(1).cast("long").alias("n_children"), F.col("n_leaves"), F.col("saved_tokens")]


def peel_by_depth(participants: DataFrame, low: int, high: int) -> list[DataFrame]:
    """Written nodes of the depths above ``low`` up to ``high``, one grouped
    aggregation a depth."""
    out, carried = [], None
    for depth in range(high, low, -1):
        ready = participants.where(F.col("depth") == depth)
        if carried is not None:
            ready = ready.unionByName(carried)
        nodes = stash(peel_depth(ready, depth, low), "trie-depth")
        out.append(nodes.select(*_NODE))
        carried = nodes.select(*_surviving(nodes), "low_key", "keys", "bytes")
    return out


def prefix_trie(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths(conv_id, ord, tok, bytes)``, positions from
    1 without gaps, over ``conversations(conv_id)``.

    One row per node, the textless root (depth 0) included: ``key``,
    ``parent_key`` (null at the root), ``conv_id`` (smallest member),
    ``depth``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its
    subtree), ``saved_tokens`` (over its subtree, (n_convs - 1) times the bytes
    of the last turn) and ``ends_sha256``. A conversation without turns belongs
    to the root; without conversations there is no node."""
    blocks = stash(path_blocks(paths), "trie-blocks")
    last = blocks.groupBy("conv_id").agg(F.max(F.struct(
        "block", F.size("keys").alias("n"), F.element_at("keys", -1).alias("key"))).alias("e"))
    ends = stash(conversations.select("conv_id").distinct().join(last, "conv_id", "left").select(
        "conv_id", F.col("e.block").alias("block"), F.col("e.n").alias("n"),
        F.coalesce(F.col("e.key"), F.lit(ROOT)).alias("key")), "trie-ends")
    digests = stash(id_digests(ends.select("key", "conv_id")), "trie-digests")
    # equal conversations as one end, carried by the smallest id
    distinct = stash(ends.where("n is not null").groupBy("key", "block", "n").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "trie-distinct")
    held = stash(blocks.join(distinct.select("conv_id"), "conv_id"), "trie-held")
    deepest = distinct.agg(F.max("block")).first()[0]
    levels: list[DataFrame] = []
    top = None                                          # nodes one turn below the block in hand
    for block in range(deepest if deepest is not None else -1, -1, -1):
        low, high = bounds_of(block)
        zero = F.lit(0).cast("long")
        joined = distinct.where(F.col("block") == block).select(
            "conv_id", (F.col("n") + low).cast("int").alias("depth"), "n_convs", zero.alias("n_children"),
            zero.alias("n_leaves"), zero.alias("saved_tokens"))
        if top is not None:
            joined = joined.unionByName(top.select(*_surviving(top)))
        participants = stash(joined.join(held.where(F.col("block") == block).drop("block"), "conv_id")
                             .select(*_PARTICIPANT), "trie-block")
        found = []
        hot = participants if block == 0 else None
        if block:
            entries = participants.groupBy("low_key").agg(F.sum(F.size("keys")).alias("entries"))
            calm = participants
            if entries.agg(F.max("entries")).first()[0] > GROUP_ENTRIES:
                groups = stash(entries.where(F.col("entries") > GROUP_ENTRIES).select("low_key"), "trie-hot")
                hot = stash(participants.join(groups, "low_key", "left_semi"), "trie-hot-rows")
                calm = participants.join(groups, "low_key", "left_anti")
            dealt = calm.repartition(spread(paths), "low_key").sortWithinPartitions("low_key")
            found.append(stash(in_arrow(dealt.select(*_PARTICIPANT), _peel_tasks(low), NODE), "trie-nodes"))
        if hot is not None:
            found += peel_by_depth(hot, low, high)
        levels += found
        top = found[0]
        for more in found[1:]:
            top = top.unionByName(more)
        top = top.where(F.col("depth") == low + 1)
    def sums(df: DataFrame, **columns: str) -> DataFrame:
        return df.agg(*[F.expr(columns.get(c, "cast(null as long)")).cast("long").alias(c) for c in "ncks" "l"])
    one = sums(conversations, n="count(distinct conv_id)", c="min(conv_id)")
    if top is not None:
        one = one.unionByName(sums(top, k="count(*)", l="sum(n_leaves)", s="sum(saved_tokens)"))
    root = one.agg(*[F.max(c).alias(c) for c in one.columns]).where("n > 0").select(
        F.lit(0).alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent_key"),
        F.col("c").alias("conv_id"), F.col("n").alias("n_convs"), F.coalesce("k", F.lit(0)).alias("n_children"),
        F.coalesce("l", F.lit(1)).alias("n_leaves"), F.coalesce("s", F.lit(0)).alias("saved_tokens"))
    nodes = root
    for level in levels:
        nodes = nodes.unionByName(level)
    return nodes.join(digests, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def contract(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; ``turns`` columns besides
    conv_id, turn, role and text are not read."""
    paths, convs = rebuild(turns)
    nodes = stash(prefix_trie(paths, convs), "trie")
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent_key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
           strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS ord
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)),
      lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384::BIGINT) ELSE b // 2 END))) % 9 AS h
  FROM t),
own AS (
  SELECT c.conv_id, least(c.h, coalesce(n.n, 0)) + t.ord - c.h AS ord, t.role, t.text
  FROM c JOIN t USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) n ON n.conv_id = c.base
  WHERE t.ord > c.h
  UNION ALL
  SELECT c.conv_id, t.ord, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE t.ord <= c.h),
p AS (
  SELECT conv_id, 0 AS depth, '' AS key, 0 AS bytes FROM c
  UNION ALL
  SELECT conv_id, ord AS depth, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '/')
    OVER (PARTITION BY conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS key, strlen(text) AS bytes
  FROM own),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY 1),
n AS (
  SELECT p.key, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.bytes) AS bytes,
         max(l.len) = p.depth AS leaf, coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)
           FILTER (WHERE l.len = p.depth), '') AS ids
  FROM p JOIN l USING (conv_id) GROUP BY 1, 2),
a AS (
  SELECT p.key, p.depth, sum(n.leaf::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens,
         sum((n.depth = p.depth + 1)::BIGINT) AS n_children
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1, 2),
m AS (SELECT p.conv_id, p.depth, n.conv_id AS low FROM p JOIN n USING (key, depth))
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, m.low::BIGINT AS parent_conv_id,
       n.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved_tokens::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM n JOIN a USING (key, depth) LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
"""
