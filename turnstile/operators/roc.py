"""Scenario labels/scores, operating points, AUC, slices.

Every ROC family member is one group-by over the per-conversation score table:
the slice is part of the key, so no slice re-scans the data (the reference
re-filters per slice and per heatmap cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def scenario_labels(conv_facts: DataFrame) -> DataFrame:
    """Ground truth per conversation for the SE and PV scenario families."""
    return conv_facts.select(
        "request_id", "conversation_type",
        (F.col("conversation_type") == S.THREAT).cast("long").alias("y_threat"),
        (F.col("total_any_violation") > 0).cast("long").alias("y_violation"))


def scenario_scores(conv_facts: DataFrame, firsts: DataFrame,
                    slice_cols: tuple[str, ...] = ()) -> DataFrame:
    """A23 + J9: one row per (conversation, scenario, stance) with y_true and
    the 0/1 score; ``slice_cols`` of ``conv_facts`` ride along as keys.
    ``firsts`` = facts.stance_firsts (se_first, pv_first, pv_last).

    pv_detection is exact: the detector fired at or after the first
    violation iff its *last* fire turn is ≥ that turn (J9 as one max()).
    """
    c = conv_facts.select("request_id", "conversation_type", "total_any_violation",
                          "first_violation_turn__any", *slice_cols)
    stances = F.explode(F.array(*[F.lit(x) for x in S.STANCES])).alias("stance")
    j = c.select("*", stances).join(firsts, ["request_id", "stance"], "left")
    fv = F.col("first_violation_turn__any")
    se_f, pv_f, pv_l = F.col("se_first"), F.col("pv_first"), F.col("pv_last")
    y_se = (F.col("conversation_type") == S.THREAT).cast("long")
    y_pv = (F.col("total_any_violation") > 0).cast("long")
    scored = {
        "se_detection": (y_se, se_f.isNotNull()),
        "se_prevention": (y_se, F.when(fv.isNull(), se_f.isNotNull())
                                 .otherwise(F.coalesce(se_f < fv, F.lit(False)))),
        "pv_detection": (y_pv, F.when(pv_l.isNull(), F.lit(False))
                                .when(fv.isNull(), F.lit(True)).otherwise(pv_l >= fv)),
        "pv_on_time": (y_pv, F.when(fv.isNull(), pv_f.isNotNull())
                              .otherwise(F.coalesce(pv_f == fv, F.lit(False)))),
    }
    arr = F.array(*[F.struct(F.lit(name).alias("scenario"), y.alias("y_true"),
                             s.cast("long").alias("score"))
                    for name, (y, s) in scored.items()])
    return (j.select("request_id", "stance", *slice_cols, F.explode(arr).alias("x"))
            .select("request_id", "x.scenario", "stance", *slice_cols, "x.y_true", "x.score"))


def operating_points(scores: DataFrame, slice_cols: tuple[str, ...] = ()) -> DataFrame:
    """Tp, fp, tpr, fpr (null when a class is empty) per scenario × slice × stance."""
    pos, neg = F.col("y_true") == 1, F.col("y_true") == 0
    g = scores.groupBy("scenario", *slice_cols, "stance").agg(
        F.count_if(pos).alias("n_positive_conversations"),
        F.count_if(neg).alias("n_negative_conversations"),
        F.count_if(pos & (F.col("score") == 1)).alias("tp"),
        F.count_if(neg & (F.col("score") == 1)).alias("fp"))
    return (g.withColumn("tpr", F.try_divide(F.col("tp").cast("double"),
                                             F.nullif(F.col("n_positive_conversations"), F.lit(0))))
             .withColumn("fpr", F.try_divide(F.col("fp").cast("double"),
                                             F.nullif(F.col("n_negative_conversations"), F.lit(0)))))


def _trapezoid(points: Column) -> Column:
    """AUC of (0,0) + valid points sorted by (fpr, tpr) + (1,1), trapezoid rule,
    on an array of struct(fpr, tpr) — at most one point per stance."""
    valid = F.filter(points, lambda p: p["fpr"].isNotNull() & p["tpr"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    one = F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    curve = F.concat(F.array(zero), F.array_sort(valid), F.array(one))
    idx = F.sequence(F.lit(1), F.size(curve) - 1)
    seg = F.transform(idx, lambda i: (F.element_at(curve, i + 1)["fpr"] - F.element_at(curve, i)["fpr"])
                      * (F.element_at(curve, i + 1)["tpr"] + F.element_at(curve, i)["tpr"]) / 2.0)
    return F.aggregate(seg, F.lit(0.0), lambda acc, x: acc + x)


def auc_from_points(points: DataFrame, group_cols: tuple[str, ...]) -> DataFrame:
    """One aggregation per (scenario, slice) over its operating points."""
    pts = F.collect_list(F.struct(F.col("fpr").cast("double").alias("fpr"),
                                  F.col("tpr").cast("double").alias("tpr")))
    return points.groupBy(*group_cols).agg(_trapezoid(pts).alias("auc"))


def roc(scores: DataFrame, slice_cols: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(operating points with auc, auc summary) for a scenario-score table.
    The AUC rides on each point row through a window over its (scenario,
    slice) group — a handful of rows — instead of a join back."""
    pts = operating_points(scores, slice_cols)
    keys = ("scenario", *slice_cols)
    w = Window.partitionBy(*keys)
    with_auc = pts.withColumn("auc", _trapezoid(F.collect_list(F.struct("fpr", "tpr")).over(w)))
    summary = with_auc.groupBy(*keys).agg(
        F.first("n_positive_conversations").alias("n_positive_conversations"),
        F.first("n_negative_conversations").alias("n_negative_conversations"),
        F.first("auc").alias("auc"))
    return with_auc, summary


def canonical_order(label: Column, dimension: str) -> Column:
    """O2: canonical position of a label (extras after, to sort alphabetically)."""
    labels = S.canonical_labels(dimension)
    arr = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    pos = F.array_position(arr, label)
    return F.when(pos > 0, pos).otherwise(F.lit(len(labels) + 1))


def auc_heatmap(scores: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """AUC per (row label, column label), one cell for every observed row
    and column label of a scenario; null when the cell is empty or one-class."""
    _, summary = roc(scores, (row_col, col_col))
    two_class = (F.col("n_positive_conversations") > 0) & (F.col("n_negative_conversations") > 0)
    labels = [summary.select("scenario", c).distinct() for c in (row_col, col_col)]
    cells = labels[0].join(labels[1], "scenario")             # label vocabularies, per scenario
    match = [F.col(f"_g.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in ("scenario", row_col, col_col)]
    return (cells.alias("_g").join(summary.alias("_s"), match[0] & match[1] & match[2], "left")
            .select("_g.scenario", f"_g.{row_col}", f"_g.{col_col}",
                    *[F.coalesce(F.col(f"_s.{c}"), F.lit(0)).alias(c)
                      for c in ("n_positive_conversations", "n_negative_conversations")],
                    F.when(two_class, F.col("_s.auc")).alias("auc")))


def heatmap_matrix(heat: DataFrame, row_col: str, col_col: str, col_values: list[str]) -> DataFrame:
    """Presentation pivot with explicit column values (no extra job)."""
    return heat.groupBy("scenario", row_col).pivot(col_col, col_values).agg(F.first("auc"))


def check_scenarios(names) -> list[str]:
    """Unknown scenario names raise."""
    bad = [n for n in names if n not in S.SCENARIOS]
    if bad:
        raise ValueError(f"unknown scenario {bad[0]!r}; choose from {S.SCENARIOS}")
    return list(names)
