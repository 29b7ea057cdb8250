"""Aggregate reports.

Fixed-grid reports (every key/type/cell always present) left-join their
group-by onto a scaffold generated by ``explode`` of a fixed literal array —
a generator, not a cross join — and ``coalesce`` the missing counts to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..session import scratch_path


def pct_label(p: float) -> str:
    """0.25 → 'p25', 0.999 → 'p999'."""
    return f"p{round(p * 1000)}" if p >= 0.999 else f"p{round(p * 100)}"


def _scaffold(df_spark_source: DataFrame, **axes: tuple[str, ...]) -> DataFrame:
    """Fixed grid built from literal arrays (one row, then explode per axis)."""
    out = df_spark_source.sparkSession.range(1)
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out.drop("id")


def with_type_sets(df: DataFrame, type_col: str = "conversation_type",
                   out_col: str = "conversation_filter") -> DataFrame:
    """GROUPING SETS ((…, type), (…)) as one generator: each row counted under
    its own type and under 'combined' (no re-scan per filter)."""
    return df.withColumn(out_col, F.explode(F.array(F.col(type_col), F.lit("combined"))))


def exact_percentiles(df: DataFrame, keys: list[str], value_col: str,
                      percentiles: tuple[float, ...] = S.DEFAULT_PERCENTILES) -> DataFrame:
    """Exact percentiles (linear interpolation) of ``value_col`` per ``keys``,
    with ``n_used``, for any number of rows and of distinct values per group.

    Values are counted first (combined before the shuffle); the counts are dealt
    to ranges of (key, value); the ranges' totals per key give every range its
    first rank; inside a range a running sum ranks the values, and one
    aggregation picks those that hold a target rank. No group is larger than a
    range, and no value list is kept in memory.
    """
    spark = df.sparkSession
    counts = df.filter(F.col(value_col).isNotNull()).groupBy(*keys, F.col(value_col).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    path = scratch_path(spark, "percentiles")
    dealt = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_v")
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(path)     # the range number becomes data
    parts = spark.read.parquet(path)
    per_part = parts.groupBy("_part", *keys).agg(F.sum("_n").alias("_sum"))
    by_key = Window.partitionBy(*keys)
    offsets = per_part.select(
        "_part", *keys, F.sum("_sum").over(by_key).alias("_total"),
        F.coalesce(F.sum("_sum").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    running = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v"))
    ranked = (parts.withColumn("_upto", running).join(offsets, ["_part", *keys])
              .withColumn("_to", F.col("_before") + F.col("_upto")).withColumn("_from", F.col("_to") - F.col("_n")))
    aggs = [F.max("_total").alias("n_used")]
    for i, p in enumerate(percentiles):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        for name, target in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            aggs.append(F.max(F.when((F.col("_from") <= target) & (target < F.col("_to")), F.col("_v"))
                              .cast("double")).alias(f"_{name}{i}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    for i, p in enumerate(percentiles):
        rank = F.lit(float(p)) * (F.col("n_used") - 1)
        out = out.withColumn(pct_label(p), F.col(f"_lo{i}") + (rank - F.floor(rank)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return out.select(*keys, "n_used", *[pct_label(p) for p in percentiles])


def latency_percentiles(detections: DataFrame,
                        percentiles: tuple[float, ...] = S.DEFAULT_PERCENTILES) -> DataFrame:
    """Latency percentiles per detection key × {threat, benign, combined}.
    Always 18 rows."""
    d = (detections.filter(F.col("latency_ms").isNotNull())
         .select(F.concat_ws("__", "objective", "stance").alias("detection_key"),
                 "conversation_type", "latency_ms"))
    g = exact_percentiles(with_type_sets(d), ["detection_key", "conversation_filter"], "latency_ms", percentiles)
    grid = _scaffold(detections, detection_key=S.DETECTION_KEYS,
                     conversation_filter=S.CONVERSATION_TYPES)
    return (grid.join(g, ["detection_key", "conversation_filter"], "left")
            .withColumnsRenamed({"conversation_filter": "conversation_type", "n_used": "n_turns_used"})
            .withColumn("n_turns_used", F.coalesce("n_turns_used", F.lit(0))))


def percentiles_by(df: DataFrame, group_col: str, value_col: str,
                   percentiles: tuple[float, ...] = S.DEFAULT_PERCENTILES) -> DataFrame:
    """Generic A17 on any table: percentiles of ``value_col`` per group + 'combined'."""
    return (exact_percentiles(with_type_sets(df, group_col, "grp"), ["grp"], value_col, percentiles)
            .withColumnRenamed("grp", group_col))


def confusion_scenarios(scores: DataFrame) -> DataFrame:
    """Zero-filled 2×2 confusion per scenario × stance (48 rows)."""
    g = (scores.groupBy("scenario", "stance", F.col("y_true").alias("actual"),
                        F.col("score").alias("predicted"))
         .agg(F.count(F.lit(1)).alias("n")))
    grid = _scaffold(scores, scenario=S.SCENARIOS, stance=S.STANCES) \
        .select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("actual")) \
        .select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("predicted"))
    return (grid.join(g, ["scenario", "stance", "actual", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def confusion_turns(conv_facts: DataFrame, detections: DataFrame) -> DataFrame:
    """Turn-level PV confusion on eligible turns with a prediction;
    absent combinations stay absent. The cumulative violation of a turn is
    whether the conversation's first violation is not after it, so one join with
    the conversation facts replaces the running windows."""
    pv = detections.filter((F.col("objective") == "policy_violation") & F.col("pred").isNotNull())
    j = pv.select("request_id", "turn_index", "stance", "pred").join(
        conv_facts.select("request_id", "first_violation_turn__any"), "request_id")
    had = F.coalesce(F.col("turn_index") >= F.col("first_violation_turn__any"), F.lit(False))
    return j.groupBy(
        "stance", had.cast("long").alias("had_cumulative_violation"),
        (F.col("pred") == 1).cast("long").alias("pv_predicted_positive"),
    ).agg(F.count(F.lit(1)).alias("n"))


def coverage(detections: DataFrame) -> DataFrame:
    """Eligible vs valid predictions per key; always 6 rows."""
    d = detections.select(F.concat_ws("__", "objective", "stance").alias("detection_key"), "pred")
    g = d.groupBy("detection_key").agg(
        F.count("pred").alias("n_eligible_turns"),
        F.count_if(F.col("pred").isin(0, 1)).alias("n_valid_predictions"))
    grid = _scaffold(detections, detection_key=S.DETECTION_KEYS)
    out = grid.join(g, "detection_key", "left").select(
        "detection_key",
        F.coalesce("n_eligible_turns", F.lit(0)).alias("n_eligible_turns"),
        F.coalesce("n_valid_predictions", F.lit(0)).alias("n_valid_predictions"))
    return out.withColumn("coverage", F.try_divide(
        F.col("n_valid_predictions").cast("double"), F.nullif("n_eligible_turns", F.lit(0))))


def recall_rules(conv_facts: DataFrame, det_facts: DataFrame,
                 objectives: tuple[str, ...] = S.OBJECTIVES,
                 rules: tuple[str, ...] = S.RECALL_RULES) -> DataFrame:
    """Recall on threat conversations under any / two_or_more / majority.
    Threat conversations without an eligible turn stay in the denominator."""
    unknown = [r for r in rules if r not in S.RECALL_RULES]
    if unknown:
        raise ValueError(f"unknown rule: {unknown[0]!r}")
    keys = F.explode(F.array(*[F.struct(F.lit(o).alias("objective"), F.lit(s).alias("stance"))
                               for o in objectives for s in S.STANCES])).alias("k")
    threat = (conv_facts.filter(F.col("conversation_type") == S.THREAT)
              .select("request_id", keys).select("request_id", "k.objective", "k.stance"))
    f = threat.join(det_facts.select("request_id", "objective", "stance", "n_fired", "n_predicted"),
                    ["request_id", "objective", "stance"], "left")
    fired, n = F.coalesce(F.col("n_fired"), F.lit(0)), F.col("n_predicted")
    rule_cols = {"any": fired >= 1, "two_or_more": fired >= 2,
                 "majority": F.coalesce(fired > n / 2.0, F.lit(False))}
    arr = F.array(*[F.struct(F.lit(r).alias("rule"), rule_cols[r].alias("flagged")) for r in rules])
    g = (f.select("objective", "stance", F.explode(arr).alias("x"))
         .groupBy("objective", "stance", "x.rule")
         .agg(F.count(F.lit(1)).alias("n_threat_conversations"),
              F.count_if("x.flagged").alias("n_flagged")))
    return g.withColumn("recall", F.try_divide(F.col("n_flagged").cast("double"),
                                               F.nullif("n_threat_conversations", F.lit(0))))


def histogram(values: DataFrame, series_cols: tuple[str, ...], value_col: str,
              from_zero: bool = False) -> DataFrame:
    """Integer-bin histogram per series with with/without-event counts.
    Zero bins run from 0 (turn-index series, ``from_zero``) or from the
    minimum (lead series) to the maximum; they are generated per series by
    ``sequence`` (bounded by the value range), then left-joined to the counts.
    Everything comes from one count per (series, value), null included."""
    counts = values.groupBy(*series_cols, F.col(value_col).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_conversations"))
    n, held = F.col("n_conversations"), F.col("bin").isNotNull()
    lo = F.min("bin")
    summary = counts.groupBy(*series_cols).agg(
        F.sum(F.when(held, n).otherwise(0)).alias("n_with"), F.sum(F.when(held, 0).otherwise(n)).alias("n_without"),
        (F.when(lo.isNotNull(), F.lit(0).cast("long")) if from_zero else lo).alias("_lo"), F.max("bin").alias("_hi"))
    bins = summary.select(*series_cols, "n_with", "n_without", F.explode_outer(
        F.when(F.col("_lo").isNotNull(), F.sequence("_lo", "_hi"))).alias("bin"))
    return (bins.join(counts.filter(held), [*series_cols, "bin"], "left")
            .withColumn("n_conversations", F.coalesce("n_conversations", F.lit(0))))


def hist_first_violation(conv_facts: DataFrame) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(v).alias("violation_type"),
                             F.col(f"first_violation_turn__{v}").alias("value"))
                    for v in S.VIOLATION_TYPES])
    vals = (with_type_sets(conv_facts)
            .select("conversation_filter", F.explode(arr).alias("x"))
            .select("conversation_filter", "x.violation_type", "x.value"))
    return histogram(vals, ("conversation_filter", "violation_type"), "value", from_zero=True)


def _per_stance_values(conv_facts: DataFrame, det_facts: DataFrame, combined: DataFrame,
                       column: str) -> DataFrame:
    per_key = det_facts.select("request_id", "conversation_type", "objective", "stance",
                               F.col(column).alias("value"))
    comb = combined.join(conv_facts.select("request_id", "conversation_type"), "request_id") \
        .select("request_id", "conversation_type", F.lit("combined").alias("objective"),
                "stance", F.col(column).alias("value"))
    # conversations without any cell of an objective still count as "without"
    keys = conv_facts.select("request_id", "conversation_type", F.explode(F.array(*[
        F.struct(F.lit(o).alias("objective"), F.lit(s).alias("stance"))
        for o in S.OBJECTIVES for s in S.STANCES])).alias("k")).select(
        "request_id", "conversation_type", "k.objective", "k.stance")
    per_key = keys.join(per_key, ["request_id", "conversation_type", "objective", "stance"], "left")
    return with_type_sets(per_key.unionByName(comb))


def hist_first_prediction(conv_facts: DataFrame, det_facts: DataFrame,
                          combined: DataFrame) -> DataFrame:
    vals = _per_stance_values(conv_facts, det_facts, combined, "first_prediction_turn")
    return histogram(vals, ("conversation_filter", "objective", "stance"), "value", from_zero=True)


def hist_lead(conv_facts: DataFrame, det_facts: DataFrame, combined: DataFrame) -> DataFrame:
    vals = _per_stance_values(conv_facts, det_facts, combined, "lead")
    return histogram(vals, ("conversation_filter", "objective", "stance"), "value")


def violations_by_rep(conv: DataFrame, rep_col: str = "short_representative",
                      violation_types: tuple[str, ...] = S.VIOLATION_TYPES) -> DataFrame:
    """Total / n conversations / mean per violation type × representative."""
    arr = F.array(*[F.struct(F.lit(v).alias("violation_type"),
                             F.col(f"total_{v}").alias("n")) for v in violation_types])
    x = (with_type_sets(conv).select("conversation_filter", F.col(rep_col).alias("representative"),
                                     F.explode(arr).alias("x")))
    return (x.groupBy("conversation_filter", "representative", "x.violation_type")
            .agg(F.sum("x.n").alias("total_count"),
                 F.count(F.lit(1)).alias("n_conversations"))
            .withColumn("mean_per_conversation",
                        F.col("total_count") / F.col("n_conversations")))


def pre_at_post_mean(det_facts: DataFrame) -> DataFrame:
    """Mean violations before/at/after the first prediction per objective ×
    stance × type over conversations with a prediction; zero row when none."""
    arr = F.array(*[F.struct(F.lit(v).alias("violation_type"),
                             F.col(f"violations_pre__{v}").alias("pre"),
                             F.col(f"violations_at__{v}").alias("at"),
                             F.col(f"violations_post__{v}").alias("post"))
                    for v in S.VIOLATION_TYPES])
    x = (with_type_sets(det_facts.filter(F.col("first_prediction_turn").isNotNull()))
         .select("conversation_filter", "objective", "stance", F.explode(arr).alias("x")))
    g = x.groupBy("conversation_filter", "objective", "stance", "x.violation_type").agg(
        F.avg("x.pre").alias("pre"), F.avg("x.at").alias("at"), F.avg("x.post").alias("post"),
        F.count(F.lit(1)).alias("n_conversations"))
    grid = _scaffold(det_facts, conversation_filter=S.CONVERSATION_TYPES,
                     objective=S.OBJECTIVES, stance=S.STANCES, violation_type=S.VIOLATION_TYPES)
    out = grid.join(g, ["conversation_filter", "objective", "stance", "violation_type"], "left")
    return out.select("conversation_filter", "objective", "stance", "violation_type",
                      *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pre", "at", "post")],
                      F.coalesce("n_conversations", F.lit(0)).alias("n_conversations"))


def flow_edges(conv_facts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Conversation flow type → violation → SE fired → PV fired as edge
    counts, for every pair of an SE stance and a PV stance. ``firsts`` =
    facts.stance_firsts, folded to one row of at most three fired stances per
    objective, so each conversation is joined once."""
    fired = firsts.groupBy("request_id").agg(
        *[F.collect_set(F.when(F.col(f"{o}_first").isNotNull(), F.col("stance"))).alias(o) for o in ("se", "pv")])
    j = (conv_facts.select("request_id", "conversation_type", (F.col("total_any_violation") > 0).alias("viol"))
         .join(fired, "request_id", "left"))
    for o in ("se", "pv"):
        j = j.withColumn(f"{o}_stance", F.explode(F.array(*[F.lit(x) for x in S.STANCES])))

    def lab(b: Column, yes: str, no: str) -> Column:
        return F.when(F.coalesce(b, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))

    v = lab(F.col("viol"), "violation", "no_violation")
    s = lab(F.array_contains("se", F.col("se_stance")), "se_predicted", "se_not_predicted")
    p = lab(F.array_contains("pv", F.col("pv_stance")), "pv_predicted", "pv_not_predicted")
    edges = F.array(
        F.struct(F.col("conversation_type").alias("from"), v.alias("to")),
        F.struct(v.alias("from"), s.alias("to")),
        F.struct(s.alias("from"), p.alias("to")))
    return (j.select("se_stance", "pv_stance", F.explode(edges).alias("e"))
            .groupBy("se_stance", "pv_stance", F.col("e.from").alias("from"), F.col("e.to").alias("to"))
            .agg(F.count(F.lit(1)).alias("count")))


def emphasis_matrix(conv: DataFrame, emphasis_col: str = "short_cialdini_emphasis") -> DataFrame:
    """Prompted emphasis × mean actual principle signals (threat only);
    one column per principle, named by the principle."""
    t = conv.filter(F.col("conversation_type") == S.THREAT)
    return t.groupBy(F.col(emphasis_col).alias("prompted_emphasis")).agg(
        F.count(F.lit(1)).alias("n_conversations"),
        *[F.avg(f"total_cialdini_{p}").alias(p) for p in S.PRINCIPLES])


def type_filter(df: DataFrame, conversation_type: str, col: str = "conversation_type") -> DataFrame:
    """P3: 'threat' / 'benign' filter; 'combined' = no filter."""
    if conversation_type == "combined":
        return df
    return df.filter(F.col(col) == conversation_type)
