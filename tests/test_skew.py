"""A hot conversation (thousands of turns, most of the rows) through the
block-wise window operators: results equal the naive full-partition window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnstile import schema as S
from turnstile.operators import facts as FX


def _turns(spark, n_hot=3000):
    hot = spark.range(n_hot).select(F.lit("hot").alias("request_id"), F.col("id").alias("turn_index"))
    cold = spark.range(40).select((F.col("id") % 4).cast("string").alias("request_id"),
                                  (F.col("id") / 4).cast("long").alias("turn_index"))
    base = hot.unionByName(cold)
    t = F.col("turn_index")
    cols = [F.when(t % 2 == 1, (F.hash("request_id", t, F.lit(k)) % 7) == 0).alias(f)
            for k, f in enumerate(S.CALLER_FLAGS)]
    cols += [F.when((t >= 2) & (t % 2 == 0), (F.hash("request_id", t, F.lit(10 + k)) % 5) == 0).alias(f)
             for k, f in enumerate(S.VIOLATION_FLAGS)]
    return base.select("request_id", "turn_index", F.lit("threat").alias("conversation_type"),
                       F.lit(0).cast("long").alias("n_turns"), F.lit("p").alias("passage"), *cols)


def test_blockwise_running_totals_match_naive(spark):
    turns = _turns(spark)
    got = FX.running_totals(turns, ("improper_action", "any_violation"))
    f = FX.flag_ints(turns)
    w = Window.partitionBy("request_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    want = f.select("request_id", "turn_index",
                    F.sum("improper_action").over(w).alias("running_total_improper_action"),
                    F.sum("any_violation").over(w).alias("running_total_any_violation"))
    diff = got.exceptAll(want).count() + want.exceptAll(got).count()
    assert diff == 0 and got.count() == 3000 + 40


def test_blockwise_cumulative_max_matches_naive(spark):
    f = FX.flag_ints(_turns(spark), masked=True)
    got = FX.cumulative_max(f, "any_violation").select("request_id", "turn_index", "cum_any_violation")
    w = Window.partitionBy("request_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    want = f.select("request_id", "turn_index",
                    F.max(F.coalesce("any_violation", F.lit(0))).over(w).alias("cum_any_violation"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
