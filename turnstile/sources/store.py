"""Sources and sinks.

The reference keeps conversations in one keyed JSON document per run
(``{"conversations": {request_id: record}}``). We read that format with a
declared schema, dealt to tasks by byte ranges (``sources.document``); the same
records are also read and written as JSON Lines / Parquet. Upserts are joins (anti-join + union, or left join + coalesce), never
driver-side dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.columns import speaker
from ..session import ship_package
from .document import parse_members, read_members

# ------------------------------------------------------------------ S1/S2
def _source_name(path: Column) -> Column:
    """Store name = file name of the scanned file, or the folder's name for a
    store written by Spark (a folder of part files)."""
    file = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when(file.startswith("part-"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).otherwise(file)


def ingest_order() -> Column:
    """Place of a row in its source: (file, byte position of its split, position
    within the split). Take it in the projection right on a file scan; as a
    column it is plain data, so what comes later may shuffle as it likes."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"))


def read_store(spark: SparkSession, paths: str | list[str], *, jsonl: bool = False,
               with_source: bool = True, strict: bool = True, with_order: bool = False) -> DataFrame:
    """Records of one or more conversation stores as rows.

    ``jsonl=False`` reads JSON documents, dealt to tasks by byte ranges
    (``sources.document``): the keyed form ``{"conversations": {id: rec}}``, and
    with ``strict=False`` also a bare map or list of records (``strict`` raises
    on those). ``jsonl=True`` reads one record per line.
    ``source`` is the store's file name and ``source_label`` a label derived
    from it (``threat`` / ``benign`` / the name without its extension);
    ``with_order`` adds ``ordinal``, the record's place in file order.
    """
    if jsonl:
        df = spark.read.schema(S.RECORD_STRUCT).json(paths)
        rec = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("r"),
                        _source_name(F.col("_metadata.file_path")).alias("source"), ingest_order().alias("ordinal"))
    else:
        members = parse_members(read_members(spark, paths, strict), S.RECORD_STRUCT)
        rec = members.select(
            F.col("r").withField("request_id", F.coalesce(F.col("r.request_id"), F.col("key"))).alias("r"),
            _source_name(F.col("file")).alias("source"),
            F.struct("file", F.lit(0).cast("long").alias("block"), F.col("position").alias("at")).alias("ordinal"))
    out = rec.select("r.*", "source", *(["ordinal"] if with_order else []))
    if with_source:
        name = F.lower(F.col("source"))
        out = out.withColumn("source_label", F.when(name.contains("threat"), F.lit("threat"))
                             .when(name.contains("benign"), F.lit("benign"))
                             .otherwise(F.regexp_replace("source", r"\.[^.]*$", "")))
    return out


def explode_turns(records: DataFrame, strict_keys: bool = True) -> DataFrame:
    """Record conversation map → one row per turn with a numeric index.
    Non-``turn_<n>`` keys are dropped (tolerant reader) or kept with a null
    index for validation (``strict_keys``)."""
    t = records.select("request_id", F.explode("conversation").alias("turn_key", "turn"))
    idx = F.when(F.col("turn_key").rlike(r"^turn_[0-9]+$"),
                 F.regexp_extract("turn_key", r"^turn_([0-9]+)$", 1).cast("long"))
    t = t.select("request_id", "turn_key", idx.alias("turn_index"), "turn.*")
    if not strict_keys:
        t = t.filter(F.col("turn_index").isNotNull())
    return t


#: What a document starts and ends with, and whether its records have keys.
DOCUMENT_FORMS = {"keyed": ('{"conversations": {', "}}", True), "map": ("{", "}", True), "list": ("[", "]", False)}


def write_store(records: DataFrame, path: str, *, jsonl: bool = True, mode: str = "overwrite",
                form: str = "keyed") -> None:
    """Write records. ``jsonl`` (default) writes splittable JSON Lines;
    otherwise one document of ``form`` (``keyed``: ``{"conversations": {id:
    record}}``, ``map`` or ``list``) in id order. That is a single file by format, so
    one task writes it, record by record; the records are serialised before."""
    cols = [f.name for f in S.RECORD_STRUCT.fields if f.name in records.columns]
    if jsonl:
        records.select(*cols).write.mode(mode).json(path)
        return
    head, foot, keyed = DOCUMENT_FORMS[form]
    name = F.to_json(F.array("request_id"))
    key = F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(": ")) if keyed else F.lit("")
    lines = records.select(F.lit(1).alias("part"), "request_id",
                           F.concat(key, F.to_json(F.struct(*cols))).alias("value"))
    ends = records.sparkSession.createDataFrame(
        [(0, None, head), (2, None, foot)], "part int, request_id string, value string")
    ship_package(records.sparkSession)
    ordered = lines.unionByName(ends).repartition(1).sortWithinPartitions("part", "request_id")
    ordered.mapInArrow(_with_commas, "value string").write.mode(mode).text(path)


def _with_commas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A comma before every record but the first."""
    first = True
    for batch in batches:
        lead = []
        for part in batch.column("part").to_pylist():
            lead.append("" if part != 1 or first else ",")
            first = first and part != 1
        yield pa.RecordBatch.from_arrays(
            [pc.binary_join_element_wise(pa.array(lead), batch.column("value"), "")], ["value"])


def records_from_turns(turns: DataFrame, meta: DataFrame) -> DataFrame:
    """Assemble store records (nested conversation map) from turn rows +
    metadata: one group-by on request_id."""
    turn = F.struct(F.col("passage"), *[F.col(f) for f in S.ALL_FLAGS])
    convs = turns.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("turn_"), F.col("turn_index").cast("string")), turn))).alias("conversation"))
    m = meta.select(
        "request_id", "replicate_index", "flavor", "generated_at_utc",
        F.col("generation_model").alias("model"), F.lit(1.0).alias("temperature"),
        F.lit(1.0).alias("top_p"), F.lit(None).cast("string").alias("system_prompt"),
        F.lit(None).cast("string").alias("user_prompt"),
        F.map_concat(F.col("selection"), F.create_map(
            F.lit("representative"), F.coalesce(F.col("representative"), F.lit("")),
            F.lit("caller"), F.col("caller"),
            F.lit("benign_context"), F.coalesce(F.col("benign_context"), F.lit("")),
            F.lit("cialdini_emphasis"), F.coalesce(F.col("cialdini_emphasis"), F.lit("")),
            F.lit("turn_count_value"), F.col("turn_count_value").cast("string"))).alias("selection"),
        F.struct(F.col("generation_input_tokens").alias("input_tokens"),
                 F.col("generation_output_tokens").alias("output_tokens"),
                 (F.col("generation_input_tokens") + F.col("generation_output_tokens"))
                 .alias("total_tokens")).alias("usage"))
    return m.join(convs, "request_id")


# ------------------------------------------------------------------ S3/S8/S9
def read_metadata(spark: SparkSession, path: str, fmt: str = "parquet", *,
                  null_policy: str = "keep") -> DataFrame:
    """S3: metadata table. ``null_policy``: 'keep' (analysis reader),
    'skip_blank_rows' (detection reader drops all-null rows), 'empty_string'
    (generation reader maps null → '')."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    return apply_null_policy(df, null_policy)


def apply_null_policy(df: DataFrame, null_policy: str) -> DataFrame:
    if null_policy == "skip_blank_rows":
        return df.filter(F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull())
    if null_policy == "empty_string":
        strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        return df.fillna("", subset=strs)
    return df


#: Per-turn fields that are JSON text themselves.
JSON_FIELDS = ("top10",)


def detection_metadata(generation: DataFrame, det: DataFrame, model: str, started_at: str, finished_at: str,
                       run_aggs: list, status: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per conversation of ``generation``: its columns (ambiguous
    ones prefixed), the per-turn lists as JSON, and the run columns, in the
    declared order. ``det`` has the cells with ``top10`` as JSON text;
    ``run_aggs`` are the run columns' aggregates and ``status`` the rule over
    (cells, failures). A conversation without cells was run without a call: it
    has lists of nulls, zero totals, no error, and is a success."""
    wide = wide_lists(det, generation, DETECTION_FIELDS, extra_aggs=run_aggs)
    counts = [f.name for f in wide.schema.fields if f.name not in S.LIST_COLUMNS and isinstance(f.dataType, T.NumericType)]
    wide = wide.fillna(0, counts).fillna("", ["detection_last_error"])
    wide = (wide.withColumn("detection_status", status(F.col("n_applicable"), F.col("detection_error_count")))
            .withColumns({"detection_model": F.lit(model), "detection_started_at_utc": F.lit(started_at),
                          "detection_finished_at_utc": F.lit(finished_at)}))
    names = prefix_generation_columns(generation).columns
    return prefix_generation_columns(generation).join(wide, "request_id").select(
        *names, *S.LIST_COLUMNS, *S.RUN_COLUMNS)


def wide_lists(det: DataFrame, meta: DataFrame, fields: tuple[tuple[str, str], ...],
               as_json: bool = True, extra_aggs: list | None = None) -> DataFrame:
    """Long detections → one row per conversation with a per-turn list
    (length n_turns, null on inapplicable turns) per key × field. One
    group-by with one collected list per key (all fields together); the pivot
    values are explicit so no extra job runs.

    Every conversation of ``meta`` has a row, also without cells; of two cells of
    one turn the later in order counts. Placement is O(n log n): the key's cells
    are sorted by turn (native ``sort_array``) and, when their turns are exactly
    the eligible ones, turn i reads element (i − first)/2 directly; any other
    list is placed by a lookup of the turn."""
    aggs = []
    for k in S.DETECTION_KEYS:
        obj, st = k.split("__")
        match = (F.col("objective") == obj) & (F.col("stance") == st)
        aggs.append(F.collect_list(F.when(match, F.struct(
            F.col("turn_index").alias("t"), *[F.col(src).alias(name) for name, src in fields])))
            .alias(f"_{k}"))
    extra = list(extra_aggs or [])
    g = meta.select("request_id", F.col("turn_count_value").cast("long").alias("_n")).join(
        det.groupBy("request_id").agg(*aggs, *extra), "request_id", "left")
    out = [F.col("request_id")]
    extra_names = [c for c in g.columns if c not in ("request_id", "_n")
                   and not c.startswith("_")]
    out += [F.col(c) for c in extra_names]
    staged = g.select("request_id", "_n", *extra_names,
                      *[F.sort_array(F.coalesce(f"_{k}", F.array())).alias(f"_{k}") for k in S.DETECTION_KEYS])
    # one cell per turn: the last of its run
    staged = staged.select("request_id", "_n", *extra_names, *[
        F.expr(f"filter(`_{k}`, (c, j) -> j = size(`_{k}`) - 1 OR `_{k}`[j + 1].t <> c.t)").alias(f"_{k}")
        for k in S.DETECTION_KEYS])
    for k in S.DETECTION_KEYS:
        first = 1 if k.startswith("social_engineering") else 2
        cells = f"`_{k}`"
        # written as SQL text: one parse in the JVM instead of a py4j call per
        # lambda node when the plan is built
        aligned = (f"(size({cells}) = greatest(floor((_n - {first} + 1) / 2), 0) AND "
                   f"forall(transform({cells}, (c, j) -> c.t = {first} + 2 * j), x -> x))")
        for name, _ in fields:
            fast = (f"transform(sequence(0L, _n - 1), i -> CASE WHEN i >= {first} AND (i - {first}) % 2 = 0 "
                    f"THEN element_at({cells}, CAST((i - {first}) / 2 AS INT) + 1).`{name}` END)")
            slow = (f"transform(sequence(0L, _n - 1), i -> element_at(map_from_entries("
                    f"transform({cells}, c -> struct(c.t, c.`{name}`))), i))")
            lst = F.expr(f"CASE WHEN _n <= 0 THEN array() WHEN {aligned} THEN {fast} ELSE {slow} END")
            if as_json and name in JSON_FIELDS:
                lst = F.transform(lst, F.parse_json)         # JSON text stays JSON within the list
            out.append((F.to_json(lst) if as_json else lst).alias(f"{k}__{name}"))
    return staged.select(*out)


DETECTION_FIELDS = (("prediction", "code"), ("p_detected", "p_detected"), ("p_not_detected", "p_not_detected"),
                    ("latency_ms", "latency_ms"), ("input_tokens", "input_tokens"),
                    ("output_tokens", "output_tokens"), ("top10", "top10"))


def write_detection_store(det: DataFrame, meta: DataFrame, path: str, message: Column) -> None:
    """The nested detection store, one JSON line per conversation of
    ``meta``: conversation_id, n_turns, speakers, per key the seven per-turn
    lists (null on inapplicable turns), and the errors in call order.
    ``message`` is the text of a failed cell, null for the others."""
    wide = wide_lists(det, meta, DETECTION_FIELDS, as_json=False, extra_aggs=[
        F.array_sort(F.collect_list(F.when(message.isNotNull(), F.struct(
            F.col("turn_index").alias("target_turn"), F.concat_ws("__", "objective", "stance").alias("key"),
            message.alias("message"))))).alias("errors"),
    ]).join(meta.select("request_id", F.col("turn_count_value").cast("long").alias("n_turns")), "request_id")
    n = F.col("n_turns")
    speakers = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), speaker)).otherwise(
        F.array().cast("array<string>"))
    keys = [F.struct(*[F.col(f"{k}__{f}").alias(f) for f, _ in DETECTION_FIELDS]).alias(k) for k in S.DETECTION_KEYS]
    (wide.select(F.col("request_id").alias("conversation_id"), "n_turns", speakers.alias("speakers"),
                 F.struct(*keys).alias("detections"),
                 F.coalesce("errors", F.array().cast("array<struct<target_turn:bigint,key:string,message:string>>")).alias("errors"))
     .write.option("ignoreNullFields", "false").json(path))


def read_detection_store(spark: SparkSession, path: str) -> DataFrame:
    """The detection store as one row per (conversation, key, turn) with a
    prediction; the lists are walked by position, the turn number."""
    cell = T.StructType([T.StructField("prediction", T.ArrayType(T.StringType())),
                         *[T.StructField(f, T.ArrayType(T.DoubleType())) for f in ("p_detected", "p_not_detected")],
                         *[T.StructField(f, T.ArrayType(T.LongType())) for f in ("latency_ms", "input_tokens", "output_tokens")],
                         T.StructField("top10", T.ArrayType(T.ArrayType(T.StructType([
                             T.StructField("token", T.StringType()), T.StructField("prob", T.DoubleType())]))))])
    schema = T.StructType([
        T.StructField("conversation_id", T.StringType()), T.StructField("n_turns", T.LongType()),
        T.StructField("speakers", T.ArrayType(T.StringType())),
        T.StructField("detections", T.StructType([T.StructField(k, cell) for k in S.DETECTION_KEYS])),
        T.StructField("errors", T.ArrayType(T.StructType([T.StructField("target_turn", T.LongType()),
                                                          T.StructField("key", T.StringType()),
                                                          T.StructField("message", T.StringType())])))])
    rows = spark.read.schema(schema).json(path)
    per_key = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"detections.{k}").alias("c")) for k in S.DETECTION_KEYS])
    x = rows.select(F.col("conversation_id").alias("request_id"), "speakers", "errors", F.explode(per_key).alias("k"))
    cells = x.select("request_id", "speakers", "errors", F.col("k.key").alias("detection_key"),
                     F.posexplode(F.arrays_zip(*[F.col(f"k.c.{f}").alias(f) for f, _ in DETECTION_FIELDS])).alias("turn_index", "c"))
    failed = F.filter("errors", lambda e: (e["target_turn"] == F.col("turn_index")) & (e["key"] == F.col("detection_key")))
    return cells.filter(F.col("c.prediction").isNotNull()).select(
        "request_id", "detection_key", F.col("turn_index").cast("long").alias("turn_index"),
        F.element_at("speakers", F.col("turn_index") + 1).alias("speaker"), "c.*",
        F.try_element_at(failed, F.lit(1))["message"].alias("error"))


def in_declared_order(df: DataFrame, column_order: tuple[str, ...] | list[str]) -> DataFrame:
    """The declared columns that ``df`` has, in the declared order."""
    return df.select(*[c for c in column_order if c in df.columns])


def export_metadata(df: DataFrame, path: str, column_order: tuple[str, ...] | list[str], fmt: str = "parquet") -> None:
    """Write a table with columns in the declared order."""
    in_declared_order(df, column_order).write.mode("overwrite").format(fmt).save(path)


def prefix_generation_columns(df: DataFrame) -> DataFrame:
    """Prefix the generation columns whose meaning is ambiguous, keep order."""
    return df.select(*[F.col(c).alias(f"generation_{c}") if c in S.AMBIGUOUS_GENERATION_COLUMNS
                       else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ S10–S12, T4
def last_per_key(updates: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """One update per key: the last by ``order``, as a dictionary filled in file
    order keeps it. ``order`` is a column of the updates (``ingest_order`` or
    ``read_store(with_order=True)``), so the winner does not depend on the plan;
    it is not part of the result."""
    if order not in updates.columns:
        raise ValueError(f"updates need their place in file order in column {order!r}")
    rest = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def upsert_update_only(base: DataFrame, updates: DataFrame, key: str,
                       columns: list[str], order: str = "ordinal") -> DataFrame:
    """Rows of ``base`` matching ``updates`` on ``key`` take the listed
    columns from the last update in file order (a null update value clears
    nothing — the base value stays only when the update row is absent); unknown
    ids are skipped."""
    u = last_per_key(updates, key, order).select(key, *[F.col(c).alias(f"_u_{c}") for c in columns],
                                                 F.lit(True).alias("_matched"))
    j = base.join(u, key, "left")
    return j.select(*[F.when(F.col("_matched"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
                      if c in columns else F.col(c) for c in base.columns])


def upsert_overwrite(base: DataFrame, updates: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """Insert or overwrite whole records by key (anti-join + union); of
    several updates the last in file order counts."""
    return base.join(updates.select(key), key, "left_anti").unionByName(
        last_per_key(updates, key, order), allowMissingColumns=True)


def evolve_schema(df: DataFrame, wanted: T.StructType) -> tuple[DataFrame, list[str]]:
    """Append missing columns (typed nulls), keep data; report the names."""
    added = [f.name for f in wanted.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType)
                           for f in wanted.fields if f.name in added}), added


def attempts_update(base: DataFrame, results: DataFrame, key: str = "request_id",
                    max_attempts: int = 10, order: str = "ordinal") -> DataFrame:
    """T4: of several results of one id the last in file order counts; success → status success, attempts += used; failure → status error,
    attempts += max; success rows are never retried (only pending/error rows
    are planned), so a success row in ``results`` only lands on such rows."""
    r = last_per_key(results, key, order).select(key, F.col("ok").alias("_ok"), F.col("attempts_used").alias("_used"),
                       F.col("error").alias("_err"), F.lit(True).alias("_m"))
    j = base.join(r, key, "left")
    m = F.coalesce(F.col("_m"), F.lit(False))
    add = F.when(F.col("_ok"), F.col("_used")).otherwise(F.lit(max_attempts))
    cols = []
    for c in base.columns:
        if c == "status":
            cols.append(F.when(m, F.when(F.col("_ok"), F.lit("success")).otherwise(F.lit("error")))
                        .otherwise(F.col(c)).alias(c))
        elif c == "attempts":
            cols.append(F.when(m, F.coalesce(F.col(c), F.lit(0)) + add).otherwise(F.col(c)).alias(c))
        elif c == "last_error":
            cols.append(F.when(m, F.when(F.col("_ok"), F.lit("")).otherwise(F.col("_err")))
                        .otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Empty table of the declared schema (new store / nothing to resume)."""
    return spark.createDataFrame([], schema)


def register_views(spark: SparkSession, conversations: DataFrame, turns: DataFrame) -> None:
    """SQL views without list/map columns (declared types, no null typing)."""
    def scalar(df: DataFrame) -> DataFrame:
        keep = [f.name for f in df.schema.fields
                if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
        return df.select(*keep)
    scalar(conversations).createOrReplaceTempView("conversations_facts")
    scalar(turns).createOrReplaceTempView("turns_facts")


def write_named(df: DataFrame, out_dir: str, name: str) -> str:
    """Named result-table sink."""
    path = f"{out_dir}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def export_order(rows: DataFrame, generation: DataFrame, key: str = "request_id",
                 ordinal: str = "ordinal") -> DataFrame:
    """Output in generation order first, then rows not in the generation
    table (by id) — a range-partitioned global sort, no driver ordering."""
    g = generation.select(key, F.col(ordinal).alias("_gen_ord"))
    last = F.lit(2 ** 62)
    return (rows.join(g, key, "left")
            .orderBy(F.coalesce("_gen_ord", last), key).drop("_gen_ord"))
