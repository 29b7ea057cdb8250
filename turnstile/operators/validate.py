"""Validation operators.

Each rule produces a *violations* DataFrame (one row per offending record and
the reason) instead of raising on the first bad row; ``strict()`` turns any
violation into an error with the first offending rows in the message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S


class ValidationError(ValueError):
    pass


def strict(violations: DataFrame, what: str, sample: int = 3) -> None:
    """Raise if ``violations`` has any row (driver sees at most ``sample``)."""
    rows = violations.limit(sample).collect()
    if rows:
        raise ValidationError(f"{what}: {[r.asDict() for r in rows]}")


def require_columns(df: DataFrame, required: list[str] | tuple[str, ...], what: str = "table") -> None:
    """Schema-level check before any action (no job runs)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValidationError(f"{what} is missing required columns: {missing}")


def success_filter(meta: DataFrame, seen: Observation) -> DataFrame:
    """Rows with status success. What was dropped is counted on the way:
    after an action ``seen.get`` has ``n_rows`` and ``n_dropped``."""
    ok = F.coalesce(F.col("detection_status") == S.STATUS_SUCCESS, F.lit(False))
    return meta.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(~ok).alias("n_dropped")).filter(ok)


def n_turns(turns: DataFrame) -> DataFrame:
    """Number of turns per conversation."""
    return turns.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_turns"))


def turn_key_index(key: Column) -> Column:
    """Integer of a ``turn_<n>`` key, null when the key does not match."""
    return F.when(key.rlike(r"^turn_[0-9]+$"),
                  F.regexp_extract(key, r"^turn_([0-9]+)$", 1).cast("long"))


def turn_contiguity(turns: DataFrame) -> DataFrame:
    """Turn indices must be 0..n-1 with no gap or duplicate."""
    t = F.col("turn_index")
    g = turns.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(t).alias("n_distinct"),
        F.min(t).alias("min_turn"), F.max(t).alias("max_turn"))
    return g.withColumn("contiguous", (F.col("min_turn") == 0)
                        & (F.col("n_distinct") == F.col("n_rows"))
                        & (F.col("max_turn") == F.col("n_rows") - 1))


def _one_list(cell: Column, element_type: str) -> Column:
    """The cell as a list, null unless the whole text is one: a JSON reader stops
    after the first value, so the text is read as the first of two elements."""
    outer = F.from_json(F.concat(F.lit("["), cell, F.lit(", []]")), f"array<array<{element_type}>>")
    return F.when(F.size(outer) == 2, outer[0])


def parse_list(cell: Column, element_type: str = "string", tolerant: bool = False) -> Column:
    """Parse a JSON list cell. Strict: null / malformed / non-list → null
    here, reported by :func:`list_parse_violations`; tolerant → empty list."""
    parsed = _one_list(cell, element_type)
    if tolerant:
        return F.coalesce(parsed, F.array().cast(f"array<{element_type}>"))
    return parsed


def list_parse_violations(df: DataFrame, cols: list[str], id_col: str = "request_id",
                          element_type: str = "string") -> DataFrame:
    """P7 strict: one row per (record, column) whose cell is null, not JSON,
    or not a JSON list."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")) for c in cols])
    x = df.select(id_col, F.explode(arr).alias("x")).select(id_col, "x.column", "x.cell")
    parsed = _one_list(F.col("cell"), element_type)
    reason = (F.when(F.col("cell").isNull(), F.lit("null list cell"))
               .when(~F.trim(F.col("cell")).startswith("["), F.lit("not a JSON list"))
               .when(parsed.isNull(), F.lit("malformed JSON list")))
    return x.select(id_col, "column", reason.alias("reason")).filter(F.col("reason").isNotNull())


def list_length_violations(wide: DataFrame, n_col: str, list_cols: list[str],
                           id_col: str = "request_id") -> DataFrame:
    """Every per-turn list must have exactly n_turns entries; a null list is
    reported with a null length."""
    arr = F.array(*[F.struct(F.lit(c).alias("key"), F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias("len"))
                    for c in list_cols])
    x = wide.select(id_col, F.col(n_col).cast("long").alias("n_turns"), F.explode(arr).alias("x"))
    return (x.select(id_col, F.col("x.key").alias("key"), F.col("x.len").alias("list_length"), "n_turns")
            .filter(~F.col("list_length").eqNullSafe(F.col("n_turns"))))


def label_leakage(labels: DataFrame, canonical: dict[str, tuple[str, ...]]) -> DataFrame:
    """P20: per target column, values outside the canonical set: distinct count
    and the first 3 in sorted order.

    The first values are a rank-limited window over the distinct leaks, which
    keeps three rows per target before the shuffle; the count is one
    aggregation over the same distinct rows."""
    arr = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("v")) for c in canonical])
    x = labels.select(F.explode(arr).alias("x")).select("x.target", "x.v")
    cond = None
    for c, vals in canonical.items():
        part = (F.col("target") == c) & ~F.col("v").isin(*vals)
        cond = part if cond is None else cond | part
    leaked = x.filter(cond).distinct()
    rank = F.row_number().over(Window.partitionBy("target").orderBy("v"))
    first = (leaked.withColumn("rank", rank).filter("rank <= 3").groupBy("target")
             .agg(F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("first")))      # three values
    return leaked.groupBy("target").agg(F.count(F.lit(1)).alias("n_unrecognized")).join(first, "target").select(
        "target", "n_unrecognized", F.array_join(F.transform("first", lambda f: f["v"]), " | ").alias("first_values"))


def dataset_summary(meta: DataFrame) -> DataFrame:
    """Per run label — conversations, kept, dropped, kept turn rows."""
    kept = (F.col("detection_status") == S.STATUS_SUCCESS) & (F.col("n_e") == 0)
    return meta.groupBy(F.col("prompt_template_key").alias("run_label")).agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.count_if(kept).alias("n_kept"),
        F.count_if(~kept).alias("n_dropped"),
        F.sum(F.when(kept, F.col("turn_count_value")).otherwise(0)).cast("long").alias("n_turn_rows"))


def dataset_labels(meta: DataFrame, label_col: str = "short_cialdini_emphasis") -> DataFrame:
    """Label values present among kept conversations, as rows (no list)."""
    kept = (F.col("detection_status") == S.STATUS_SUCCESS) & (F.col("n_e") == 0)
    return meta.filter(kept).groupBy(F.col("prompt_template_key").alias("run_label"),
                                     F.col(label_col).alias("label")) \
        .agg(F.count(F.lit(1)).alias("n_conversations"))


def stance_catalogue(det: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Ordered distinct stance keys (first position wins)."""
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stance"))
    return det.groupBy("stance").agg(F.min(pos).alias("ord"))


# ------------------------------------------------------------------ P22
# FIXED VALUES: fields a stored record must have, and the texts and numbers
# accepted as a flag besides JSON booleans.
TOP_FIELDS = ("selection", "flavor", "replicate_index", "conversation")
SELECTION_FIELDS = ("prompt_template_key", "scenario", "representative", "caller",
                    "benign_context", "cialdini_emphasis", "turn_count_value")
FLAG_WORDS = ("0", "off", "f", "false", "n", "no", "1", "on", "t", "true", "y", "yes")
FLAG_NUMBERS = ("0", "1", "0.0", "1.0", "0E0", "1E0")


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _entries(v: Column) -> Column:
    """An object's fields as map<string, variant>; empty for anything else."""
    none = F.create_map().cast("map<string,variant>")
    return F.when(_is_object(v), F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), none)).otherwise(none)


def _as_count(v: Column) -> Column:
    """A whole number from a JSON number (cut towards zero), a boolean or an
    integer text; null for the rest."""
    kind = F.schema_of_variant(v)
    return (F.when(kind == "STRING", F.when(_text(v).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(_text(v)).try_cast("int")))
             .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
             .otherwise(F.try_variant_get(v, "$", "double").try_cast("int")))


def malformed_records(records: DataFrame) -> DataFrame:
    """First structural problem per record (null when valid).

    ``records`` columns: ``request_id`` and ``record``, the parsed JSON value as a
    variant (null when the text is no JSON), so that a missing field, a null and
    a value of another type are told apart. Rules in order: not an object,
    missing top-level fields, selection not an object, missing selection fields,
    turn count not an integer or below 1, turn keys other than
    turn_0..turn_{n-1}, and per turn the exact fields of its parity (greeting:
    passage; caller: passage and 7 principle flags; representative: passage and
    3 violation flags): a text as passage, and flags that are booleans or are
    read as such.
    """
    record = F.col("record")
    turns = F.transform_values(_entries(F.col("_top")["conversation"]), lambda k, v: _entries(v))
    greeting = F.array(F.lit("passage"))
    caller = F.array(*[F.lit(f) for f in ("passage",) + S.CALLER_FLAGS])
    rep = F.array(*[F.lit(f) for f in ("passage",) + S.VIOLATION_FLAGS])

    def bad_value(name: Column, v: Column) -> Column:
        kind, text = F.coalesce(F.schema_of_variant(v), F.lit("VOID")), _text(v)
        flag = ((kind == "BOOLEAN") | ((kind == "STRING") & F.lower(text).isin(*FLAG_WORDS))
                | ((kind != "STRING") & text.isin(*FLAG_NUMBERS)))
        return ~F.coalesce(F.when(name == "passage", kind == "STRING").otherwise(flag), F.lit(False))

    def bad_turn(k: Column, fields: Column) -> Column:
        i = F.regexp_extract(k, r"^turn_([0-9]+)$", 1).try_cast("int")
        want = F.when(i == 0, greeting).when(i % 2 == 1, caller).otherwise(rep)
        names = F.map_keys(fields)
        return ((F.size(F.array_except(want, names)) + F.size(F.array_except(names, want))) > 0) | (
            F.size(F.map_filter(fields, bad_value)) > 0)

    # intermediate values become columns once; the reason chain reads them by name
    n = F.col("_n")
    expected = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1),
                                         lambda i: F.concat(F.lit("turn_"), i.cast("string")))
                      ).otherwise(F.array().cast("array<string>"))
    keys = F.map_keys("_turns")
    staged = (records.withColumn("_object", _is_object(record)).withColumn("_top", _entries(record))
              .withColumns({"_sel_object": _is_object(F.col("_top")["selection"]),
                            "_sel": _entries(F.col("_top")["selection"]), "_turns": turns})
              .withColumn("_n", _as_count(F.col("_sel")["turn_count_value"]))
              .withColumns({
                  "_missing_top": F.array_except(F.array(*[F.lit(f) for f in TOP_FIELDS]), F.map_keys("_top")),
                  "_missing_sel": F.array_except(F.array(*[F.lit(f) for f in SELECTION_FIELDS]), F.map_keys("_sel")),
                  "_key_diff": F.size(F.array_except(keys, expected)) + F.size(F.array_except(expected, keys)),
                  "_bad_turns": F.map_keys(F.map_filter("_turns", bad_turn))}))
    mt, ms, bt = F.col("_missing_top"), F.col("_missing_sel"), F.col("_bad_turns")
    reason = (F.when(~F.col("_object"), F.lit("record is not an object"))
               .when(F.size(mt) > 0, F.concat(F.lit("missing fields: "), F.array_join(F.array_sort(mt), ",")))
               .when(~F.col("_sel_object"), F.lit("selection is not an object"))
               .when(F.size(ms) > 0, F.concat(F.lit("selection missing: "), F.array_join(F.array_sort(ms), ",")))
               .when(n.isNull(), F.lit("turn_count_value is not an integer"))
               .when(n < 1, F.lit("turn_count_value is below 1"))
               .when(F.col("_key_diff") > 0, F.lit("turn keys do not match turn_count_value"))
               .when(F.size(bt) > 0, F.concat(F.lit("bad turn fields: "), F.array_join(F.array_sort(bt), ","))))
    return staged.withColumn("malformed_reason", reason).drop(
        "_object", "_top", "_sel_object", "_sel", "_turns", "_n", "_missing_top", "_missing_sel", "_key_diff",
        "_bad_turns")


def meta_conv_join(meta: DataFrame, conversations: DataFrame, seen: Observation, key: str = "request_id") -> DataFrame:
    """Metadata ⋈ conversations; extra conversations are ignored. Metadata
    ids without a conversation are counted on the way: after an action
    ``seen.get`` has ``n_missing`` and the first of them, ``first_missing``;
    :func:`raise_missing` is the strict mode."""
    joined = meta.join(conversations.withColumn("_has", F.lit(True)), key, "left")
    gone = F.col("_has").isNull()
    return joined.observe(seen, F.count_if(gone).alias("n_missing"),
                          F.min(F.when(gone, F.col(key))).alias("first_missing")).filter(~gone).drop("_has")


def raise_missing(seen: Observation) -> None:
    """Strict J1, after the action."""
    if seen.get["n_missing"]:
        raise ValidationError(f"{seen.get['n_missing']} metadata ids without a conversation, "
                              f"first {seen.get['first_missing']}")
