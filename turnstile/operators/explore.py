"""Search and lookup over the conversation pool (SURVEY P17, P18, P24, P25,
P27, J3, J11, J12, A39, O3, O6, record captions).

All are filters, semi/anti joins and small group-bys; a single-conversation
lookup is a pushed-down filter, never a scan of every file in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

WILDCARD = "__random__"


def dimension_values(meta: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """dim_values(dimension, key, value): short label as key, rendered text as
    value, taken from the data (one distinct over a generator of the dims)."""
    arr = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"short_{d}").alias("key"),
                             F.col(d).alias("value")) for d in dims])
    return meta.select(F.explode(arr).alias("x")).select("x.*").filter(
        F.col("value").isNotNull()).distinct()


def template_options(template_dims: DataFrame, dim_values: DataFrame) -> DataFrame:
    """P25: template → visible fields and their option labels ``key: value[:60]``."""
    return template_dims.join(dim_values, "dimension").select(
        "template", "field", "key",
        F.concat(F.col("key"), F.lit(": "), F.left(F.col("value"), F.lit(60))).alias("label"))


def match_conversations(records: DataFrame, template: str, expected: dict[str, str],
                        stance_idx: DataFrame | None = None,
                        stance_filters: dict[str, str] | None = None) -> DataFrame:
    """P24 + J11: records of ``template`` whose rendered dimension values equal
    the chosen ones (compared as strings; wildcard/empty = no filter), and —
    per objective with a chosen stance — where that stance fired."""
    out = records.filter(F.col("prompt_template_key") == template)
    for col, val in expected.items():
        if val and val != WILDCARD:
            out = out.filter(F.coalesce(F.col(col).cast("string"), F.lit("")) == F.lit(str(val)))
    for obj, st in (stance_filters or {}).items():
        if not st or st == WILDCARD or stance_idx is None:
            continue
        fired = stance_idx.filter((F.col("objective") == obj) & F.col("stance").eqNullSafe(st)) \
            .select("request_id").distinct()
        out = out.join(fired, "request_id", "left_semi")
    return out


def suppress_broken(records: DataFrame, status: DataFrame) -> DataFrame:
    """Drop records whose normalised status is not 'success'; ids without a
    status row are kept; blank ids in the status table are skipped."""
    sid = F.col("request_id") if "request_id" in status.columns else F.col("conversation_id")
    norm = F.coalesce(F.lower(F.trim(F.col("detection_status").cast("string"))), F.lit("(null)"))
    bad = (status.select(sid.cast("string").alias("request_id"), norm.alias("_s"))
           .filter(F.col("request_id").isNotNull() & (F.col("request_id") != ""))
           .filter(F.col("_s") != "success").select("request_id").distinct())
    return records.join(bad, "request_id", "left_anti")


def detections_by_turn(det: DataFrame, stances: dict[str, str]) -> DataFrame:
    """Chosen stance per objective → per turn the code (and measures);
    turns without a code are omitted."""
    cond = None
    for obj, st in stances.items():
        c = (F.col("objective") == obj) & (F.col("stance") == st)
        cond = c if cond is None else cond | c
    return det.filter(cond & F.col("code").isNotNull()).select(
        "request_id", "turn_index", "objective", "stance", "code", "p_detected", "p_not_detected")


def pool_values(records: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """The distinct dimension values present per template, one row each."""
    arr = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                    for d in dims])
    x = records.select("prompt_template_key", F.explode(arr).alias("x")).select(
        "prompt_template_key", "x.dimension", "x.value").filter(F.col("value").isNotNull())
    return x.distinct()


def random_match(records: DataFrame, seed: int, group: str = "prompt_template_key") -> DataFrame:
    """A seeded, reproducible pick of one record per group: the smallest
    sha2(seed|id) (min_by — an aggregation, map-side reduced)."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("request_id")), 256)
    return records.groupBy(group).agg(F.min_by("request_id", h).alias("request_id"))


def random_stance(det: DataFrame, conversations: DataFrame, seed: int) -> DataFrame:
    """A seeded pick of one stance per conversation and objective, among
    those that fired (code 'Y' or 'S'), or among the presets if none did. One
    aggregation of at most three stances per key; no cell is copied."""
    def order(stance: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(str(seed)), "request_id", "objective", stance), 256)

    fired = (det.filter(F.col("code").isin("Y", "S")).groupBy("request_id", "objective")
             .agg(F.min_by("stance", order(F.col("stance"))).alias("_fired")))
    keys = conversations.select("request_id", F.explode(F.array(*[F.lit(o) for o in S.OBJECTIVES])).alias("objective"))
    preset = F.array_min(F.array(*[F.struct(order(F.lit(s)).alias("h"), F.lit(s).alias("stance")) for s in S.STANCES]))
    return (keys.join(fired, ["request_id", "objective"], "left")
            .select("request_id", "objective", F.coalesce("_fired", preset["stance"]).alias("stance"),
                    F.col("_fired").isNotNull().alias("fired")))


def truncate_through(turns: DataFrame, k: int | Column) -> DataFrame:
    """Conversation through turn k (inclusive)."""
    kc = F.lit(k) if isinstance(k, int) else k
    return turns.filter(F.col("turn_index") <= kc)


def records_by_time(records: DataFrame) -> DataFrame:
    """O3: records ordered by generated_at_utc, missing = '' first (range-partitioned sort)."""
    return records.orderBy(F.coalesce(F.col("generated_at_utc"), F.lit("")), "request_id")


def record_caption(source_label: Column, selection: Column, request_id: Column) -> Column:
    """``[id8] source · scenario_key · caller_key · emphasis_key · context_key``
    from the non-empty parts; ``[id8]`` alone when none (``[??]`` without id)."""
    def nz(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)
    bits = [nz(source_label)] + [nz(selection.getItem(k)) for k in (
        "scenario_key", "caller_key", "cialdini_emphasis_key", "benign_context_key")]
    short = F.when(F.length(F.coalesce(request_id, F.lit(""))) > 0, F.left(request_id, F.lit(8))) \
        .otherwise(F.lit("??"))
    joined = F.concat_ws(" · ", *bits)
    return F.when(F.length(joined) > 0, F.concat(F.lit("["), short, F.lit("] "), joined)) \
        .otherwise(F.concat(F.lit("["), short, F.lit("]")))


def normalise_record(records: DataFrame) -> DataFrame:
    """Ordered turn list with speaker and text; template key promoted from
    ``selection``; records that already carry ``turns`` pass through."""
    if "turns" in records.columns and "conversation" not in records.columns:
        return records
    entries = F.map_entries(F.col("conversation"))
    idx = lambda e: F.regexp_extract(e["key"], r"^turn_([0-9]+)$", 1).cast("int")
    keep = F.filter(entries, lambda e: e["key"].rlike(r"^turn_[0-9]+$"))
    turns = F.transform(keep, lambda e: F.struct(
        idx(e).alias("turn_index"),
        F.when(idx(e) % 2 == 1, F.lit("caller")).otherwise(F.lit("representative")).alias("speaker"),
        e["value"]["passage"].alias("text")))
    tpl = F.coalesce(F.col("prompt_template_key"), F.col("selection").getItem("prompt_template_key")) \
        if "prompt_template_key" in records.columns else F.col("selection").getItem("prompt_template_key")
    return records.withColumn("turns", F.array_sort(turns)).withColumn("prompt_template_key", tpl)


def custom_rows(base: DataFrame, custom: DataFrame, text_col: str) -> DataFrame:
    """User-supplied dimension values / stance texts under a synthetic
    key; blank custom text is ignored."""
    return base.unionByName(custom.filter(F.length(F.trim(F.col(text_col))) > 0),
                            allowMissingColumns=True)


def first_k(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """First-k diagnostics (a limit is the feature here)."""
    return df.orderBy(*order).limit(k)


__all__ = ["WILDCARD", "Window", "S"]
