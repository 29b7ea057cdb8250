"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..session import scratch_path, ship_package

#: A word: a maximal run without space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, makes
    partition ids and other run-dependent values plain data, and survives lost
    executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, names: list[str], extra: list[StructField]) -> StructType:
    """Schema of the columns ``names`` of ``df`` under the neutral names
    ``_c0, _c1, ...`` followed by ``extra``."""
    return StructType([StructField(f"_c{i}", df.schema[c].dataType) for i, c in enumerate(names)] + extra)


def in_arrow(df: DataFrame, task, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(task, schema)


def pack(df: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """``keep`` beside one struct ``_row`` that holds the input row, so that no
    input column can clash with an operator's own names."""
    row = F.struct(*[df[f"`{c}`"] for c in df.columns])
    return df.select(row.alias("_row"), *[c.alias(n) for n, c in keep.items()])


def unpack(df: DataFrame, columns: list[str], outputs: dict[str, Column]) -> DataFrame:
    """The input columns followed by the operator's outputs; an input column of
    an output's name is replaced by the output."""
    names = {n.lower() for n in outputs}
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in outputs.items()])


def spread(df: DataFrame, cores: int | None = None) -> int:
    """Number of tasks for a wide step: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[Column], name: str, rank: str = "_rank") -> DataFrame:
    """Global 0-based rank under ``order`` without a one-task sort: a range
    partitioning is written out, partition sizes give offsets (one number per
    partition goes to the driver), and each partition numbers its own rows."""
    parts = stash(df.repartitionByRange(spread(df), *order)
                  .withColumn("_part", F.spark_partition_id()), name)
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    bases = df.sparkSession.createDataFrame(offsets, "_part int, _base long")
    numbered = parts.withColumn(
        "_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long"))
    return (numbered.join(F.broadcast(bases), "_part")           # one row per partition
            .withColumn(rank, F.col("_base") + F.col("_n") - 1).drop("_part", "_base", "_n"))


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(node, label)``
    with the smallest node of each component, for every node with an edge.

    Alternating large-star and small-star steps. A step is one ``min`` per node
    (combined before the shuffle) and one join back, which AQE splits for a
    node with very many edges; no neighbour list is ever collected. Each
    round is written to the shared folder. The loop ends when every node has
    one edge and hangs on a root; ``max_rounds`` only guards against a
    programming error and raises.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:                                       # every edge seen from its larger end
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select(
            F.col("a").alias("_k"), F.least("a", "_m").alias("_m"))
        joined = both.join(low, both["a"] == low["_k"])
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                               F.col("_m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(
                low.select(F.col("_k").alias("a"), F.col("_m").alias("b")))
        return out.where("a <> b")

    def open_nodes(e: DataFrame) -> int:
        """Nodes with several edges, or whose other end has an edge of its own."""
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        sums = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return sums.where("up > 1 or (up = 1 and down = 1)").count()

    current = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b").distinct(), name)
    for _ in range(max_rounds):
        if not open_nodes(current):
            break
        current = stash(star(star(current, True), False).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
