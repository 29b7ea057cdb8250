"""Request grid, prompts, reconstruction and repair (SURVEY J4–J6, J8, W4, W6,
P22/P23, P26, A2, A37, A38, A40).

The grid is a product over dimension vocabularies. Its rows are numbered: a
row's number in mixed radix gives the place of each of its values, so the rows
come from ``range`` in even tasks, and a stored record's number follows from
its values. Reconstruction joins on that number; a record without one is an
orphan. Everything else is group-bys and anti/semi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

CONTENT_KEY = ("prompt_template_key", "scenario", "representative", "caller", "benign_context",
               "cialdini_emphasis", "turn_count_value", "flavor", "replicate_index")

# FIXED VALUES: which dimensions each template declares (the rest stay '').
TEMPLATE_AXES = {
    "threat": ("scenario", "representative", "caller", "cialdini_emphasis", "turn_count_value"),
    "benign": ("scenario", "representative", "caller", "benign_context", "turn_count_value"),
}
# Prompt templates (own wording); placeholders are replaced by row values.
PROMPT_TEMPLATES = {
    "threat": ("Simulate a {turn_count}-turn support call about {scenario}. Representative: "
               "{representative} Caller: {caller} Persuasion focus: {cialdini_emphasis} "
               "Number the turns 0 to {last_turn_index}."),
    "benign": ("Simulate a {turn_count}-turn support call about {scenario}. Representative: "
               "{representative} Caller: {caller} Context: {benign_context} "
               "Number the turns 0 to {last_turn_index}."),
}
FLAVOR_STRATEGIES = ("deterministic", "resampled")


def stable_id(cols: list[Column] | tuple[Column, ...]) -> Column:
    """Deterministic request id from content (uuid4 is not reproducible)."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


GRID_AXES = CONTENT_KEY[1:-1]


def dimension_vocab(records: DataFrame) -> DataFrame:
    """``(prompt_template_key, axis, value, ord)``: the distinct values of every
    axis that a template declares, and of its flavors, numbered from 0 in order
    of value. An undeclared axis has the one value ''."""
    axes = [F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in GRID_AXES]
    rows = records.select("prompt_template_key", F.explode(F.array(*axes)).alias("e")).select(
        "prompt_template_key", "e.axis", "e.value").where(F.col("value").isNotNull())
    declared = F.lit(False)
    for tpl, names in TEMPLATE_AXES.items():
        declared = declared | ((F.col("prompt_template_key") == tpl) & F.col("axis").isin(*names, "flavor"))
    rows = rows.withColumn("value", F.when(declared, F.col("value")).otherwise("")).distinct()
    place = F.row_number().over(Window.partitionBy("prompt_template_key", "axis").orderBy("value"))
    return rows.withColumn("ord", (place - 1).cast("long"))


def with_flavors(vocab: DataFrame, flavors: DataFrame) -> DataFrame:
    """The vocabulary with the flavors of ``flavors(prompt_template_key, flavor)``
    (e.g. a W6 sample) in place of its own."""
    place = F.row_number().over(Window.partitionBy("prompt_template_key").orderBy("flavor"))
    chosen = flavors.select("prompt_template_key", "flavor").distinct().select(
        "prompt_template_key", F.lit("flavor").alias("axis"), F.col("flavor").alias("value"),
        (place - 1).cast("long").alias("ord"))
    return vocab.where(F.col("axis") != "flavor").unionByName(chosen)


def _strides(vocab: DataFrame, replicates: int) -> dict[str, tuple[int, dict[str, tuple[int, int]]]]:
    """Per template the number of grid rows and, per axis, (stride, size): two
    numbers an axis go to the driver."""
    sizes: dict[str, dict[str, int]] = {}
    for r in vocab.groupBy("prompt_template_key", "axis").count().collect():
        sizes.setdefault(r["prompt_template_key"], {})[r["axis"]] = r["count"]
    out = {}
    for tpl in sorted(sizes):
        stride, axes = replicates, {"replicate_index": (1, replicates)}
        for a in reversed(GRID_AXES):
            axes[a] = (stride, sizes[tpl].get(a, 0))
            stride *= axes[a][1]
        if stride >= 1 << 63:
            raise ValueError(f"the grid of {tpl} has {stride} rows, more than a number can name")
        out[tpl] = (stride, axes)
    return out


def request_grid(vocab: DataFrame, replicates: int = 1) -> DataFrame:
    """Product of the template's declared dimension values × flavors ×
    replicates, all ``pending``; undeclared dimensions are ''. Row number
    ``grid_number`` is unranked: its digits pick the values by their place, each
    by an equi-join with the vocabulary of that axis."""
    spark, out = vocab.sparkSession, None
    for tpl, (total, axes) in _strides(vocab, replicates).items():
        g = spark.range(total).withColumnRenamed("id", "grid_number")
        for a in GRID_AXES:
            stride, size = axes[a]
            values = vocab.where((F.col("prompt_template_key") == tpl) & (F.col("axis") == a)).select(
                F.col("ord").alias("_ord"), F.col("value").alias(a))
            digit = F.expr(f"grid_number div {stride} % {max(size, 1)}")
            g = g.withColumn("_ord", digit).join(values, "_ord").drop("_ord")
        g = g.withColumn("prompt_template_key", F.lit(tpl)).withColumn(
            "replicate_index", F.col("grid_number") % max(replicates, 1))
        out = g if out is None else out.unionByName(g)
    if out is None:
        out = spark.createDataFrame([], "grid_number long, " + ", ".join(f"{c} string" for c in CONTENT_KEY))
    out = out.withColumn("turn_count_value", F.expr("try_cast(turn_count_value AS BIGINT)")).withColumn(
        "replicate_index", F.col("replicate_index").cast("long"))
    return out.select(stable_id([F.col(c) for c in CONTENT_KEY]).alias("request_id"),
                      *CONTENT_KEY, F.lit("pending").alias("status"),
                      F.lit(0).cast("long").alias("attempts"), "grid_number")


def grid_size(vocab: DataFrame, replicates: int = 1) -> int:
    """Number of grid rows of all templates."""
    return sum(total for total, _ in _strides(vocab, replicates).values())


def rank_records(records: DataFrame, vocab: DataFrame, replicates: int = 1) -> DataFrame:
    """``records`` with ``grid_number``, the row of the grid that has their
    values; null where a value is not in the vocabulary or the replicate is out
    of range."""
    known = _strides(vocab, replicates)
    number = F.when((F.col("replicate_index") >= 0) & (F.col("replicate_index") < replicates), F.col("replicate_index"))
    out = records
    for a in GRID_AXES:
        stride = F.lit(None).cast("long")
        for tpl, (_, axes) in known.items():
            stride = F.when(F.col("prompt_template_key") == tpl, F.lit(axes[a][0]).cast("long")).otherwise(stride)
        places = vocab.where(F.col("axis") == a).select(
            F.col("prompt_template_key").alias("_tpl"), F.col("value").alias("_value"), F.col("ord").alias(f"_{a}"))
        out = out.join(places, (F.col("prompt_template_key") == F.col("_tpl"))
                       & (F.col(a).cast("string") == F.col("_value")), "left").drop("_tpl", "_value")
        number = number + F.col(f"_{a}") * stride
    return out.withColumn("grid_number", number).drop(*[f"_{a}" for a in GRID_AXES])


def flavor_sample(combos: DataFrame, flavors: DataFrame, n: int, seed: int,
                  strategy: str, combo_cols: list[str]) -> DataFrame:
    """N distinct flavors per combination. deterministic = one seeded subset
    shared by all combinations; resampled = a fresh seeded subset per
    combination. n > pool raises.

    Each row draws n places of the pool, all subsets alike (Floyd's method: the
    j-th draw is below the pool's size less the draws to come, and one that is
    taken already gives way to the largest allowed), then an equi-join brings
    the flavors. O(n) hashes a row, whatever the pool's size."""
    if strategy not in FLAVOR_STRATEGIES:
        raise ValueError(f"Unknown flavor_strategy: {strategy}")
    pool = flavors.select("flavor").where(F.col("flavor").isNotNull()).distinct()
    size = pool.count()
    if n > size:
        raise ValueError(f"Requested {n} flavors but only {size} available.")
    parts = [F.lit(str(seed))]
    if strategy == "resampled":
        parts += [F.col(c).cast("string") for c in combo_cols]

    def draw(taken: Column, k: Column) -> Column:
        top = k + F.lit(size - n)
        label = F.sha2(F.concat_ws("|", *parts, k.cast("string")), 256)
        place = F.conv(F.substring(label, 1, 13), 16, 10).cast("long") % (top + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, place), top).otherwise(place))
    if n < 1:
        return combos.withColumn("flavor", F.lit(None).cast("string")).limit(0)
    steps = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    places = F.aggregate(steps, F.array().cast("array<bigint>"), draw)
    numbered = pool.withColumn("_place", (F.row_number().over(Window.orderBy("flavor")) - 1).cast("long"))
    return (combos.withColumn("_place", F.explode(places)).join(numbered, "_place")
            .select(*combos.columns, "flavor"))


def render_prompts(rows: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """System prompt = template with {placeholders} replaced by the row's
    values (turn_count and last_turn_index derived); user prompt 'flavor: …'.
    ``templates(template, text)`` are those of a prompt document (default: the
    shipped ones)."""
    if templates is not None:
        texts = templates.select(F.col("template").alias("prompt_template_key"), F.col("text").alias("_tpl")).distinct()
        rows = rows.join(texts, "prompt_template_key", "left")
    tpl = F.col("_tpl") if templates is not None else F.element_at(F.create_map(*[F.lit(x) for kv in PROMPT_TEMPLATES.items() for x in kv]),
                       F.col("prompt_template_key"))
    n = F.col("turn_count_value").cast("long")
    reps = {"scenario": F.col("scenario"), "representative": F.col("representative"),
            "caller": F.col("caller"), "benign_context": F.col("benign_context"),
            "cialdini_emphasis": F.col("cialdini_emphasis"),
            "turn_count": n.cast("string"), "last_turn_index": (n - 1).cast("string")}
    out = tpl
    for ph, val in reps.items():
        out = F.replace(out, F.lit("{" + ph + "}"), F.coalesce(val.cast("string"), F.lit("")))
    return rows.withColumn("system_prompt", out).drop("_tpl") \
        .withColumn("user_prompt", F.concat(F.lit("flavor: "), F.col("flavor")))


def dedupe_latest(records: DataFrame, key: tuple[str, ...] = CONTENT_KEY,
                  ts: str = "generated_at_utc", ordinal: str = "ordinal") -> DataFrame:
    """One record per content key — the strictly newest timestamp wins,
    ties keep the first seen (lowest ``ordinal``, a number or a place in file
    order, ``store.ingest_order``). Adds ``n_in_group``.

    Two aggregations, first per timestamp and then per key, not a window: a key
    with very many copies is reduced map-side before the shuffle."""
    rest = [c for c in records.columns if c not in key]
    first = records.groupBy(*key, F.coalesce(F.col(ts), F.lit("")).alias("_ts")).agg(
        F.min_by(F.struct(*rest), ordinal).alias("_r"), F.count(F.lit(1)).alias("_n"))
    g = first.groupBy(*key).agg(F.max_by("_r", "_ts").alias("_r"), F.sum("_n").alias("n_in_group"))
    return g.select(*key, "_r.*", "n_in_group")


def reconstruct_match(grid: DataFrame, store: DataFrame) -> DataFrame:
    """Grid ⋈ deduped, ranked store (``rank_records``) on template and grid
    number; matched rows adopt the record's id, usage and timestamp with status
    success and attempts 1; unmatched rows stay pending."""
    s = store.select("prompt_template_key", "grid_number", F.col("request_id").alias("_sid"),
                     F.col("generated_at_utc").alias("_ts"),
                     F.col("input_tokens").alias("_in"), F.col("output_tokens").alias("_out"),
                     F.lit(True).alias("_hit"))
    j = grid.join(s, ["prompt_template_key", "grid_number"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        F.coalesce("_sid", "request_id").alias("request_id"),
        F.col("request_id").alias("grid_id"), *CONTENT_KEY,
        F.when(hit, F.lit("success")).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(1)).otherwise(F.col("attempts")).cast("long").alias("attempts"),
        F.when(hit, F.col("_ts")).otherwise(F.lit("")).alias("generated_at_utc"),
        F.when(hit, F.coalesce("_in", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("input_tokens"),
        F.when(hit, F.coalesce("_out", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("output_tokens"))


def reconstruct_orphans(store: DataFrame) -> DataFrame:
    """Ranked store records that no grid row matches: those without a number."""
    return store.where(F.col("grid_number").isNull()).drop("grid_number")


def reconstruct_summary(n_grid: int, store: DataFrame) -> DataFrame:
    """Grid rows, valid records, matched, unmatched, orphans, duplicates,
    from the deduped, ranked store: a number names exactly one grid row."""
    a = store.agg(F.count("grid_number").alias("n_matched"), F.count(F.lit(1)).alias("n_unique"),
                  F.sum("n_in_group").alias("n_records"))
    return a.select(F.lit(n_grid).cast("long").alias("n_grid"), F.coalesce("n_records", F.lit(0)).alias("n_records"),
                    "n_matched", (F.lit(n_grid) - F.col("n_matched")).cast("long").alias("n_unmatched"),
                    (F.col("n_unique") - F.col("n_matched")).alias("n_orphans"),
                    (F.coalesce("n_records", F.lit(0)) - F.col("n_unique")).alias("n_duplicates"))


def flag_metrics(turns: DataFrame, n_col: str = "turn_count_value") -> DataFrame:
    """A2: ``{flag}_sum`` and ``{flag}_by_turn`` ('0'/'1' per position, length
    turn_count; only literal true on an applicable turn counts; missing turns
    are '0').

    One collected list per conversation of (turn, bits[10]), sorted natively;
    of two rows of one turn the later in order counts. When the turns are
    exactly 0..n-1 each string is a projection of the sorted list (O(n log n));
    any other list is placed by a lookup of the turn."""
    t = F.col("turn_index")
    caller = t % 2 == 1
    rep = (t >= 2) & (t % 2 == 0)
    bits = []
    for f in S.ALL_FLAGS:
        app = caller if f in S.CALLER_FLAGS else rep
        bits.append(F.when(app & (F.col(f) == F.lit(True)), 1).otherwise(0))
    g = turns.groupBy("request_id").agg(
        F.first(n_col).cast("long").alias("_n"),
        F.sort_array(F.collect_list(F.struct(t.alias("t"), _mask(bits).alias("b")))).alias("_rows"))
    g = g.withColumn("_rows", F.expr("filter(_rows, (x, j) -> j = size(_rows) - 1 OR _rows[j + 1].t <> x.t)"))
    g = g.withColumn("_exact", F.expr("size(_rows) = _n AND forall(transform(_rows, (x, j) -> x.t = j), y -> y)"))
    nn = F.col("_n")
    out = [F.col("request_id")]
    for k, f in enumerate(S.ALL_FLAGS):
        fast = F.array_join(F.transform("_rows", _bit(k)), ",")
        fires = F.transform(F.filter("_rows", _fired(k)), _turn())
        slow = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), nn - 1), _present(fires)), ",")
        out += [F.size(F.filter("_rows", _counted(k))).cast("long").alias(f"{f}_sum"),
                F.when(nn <= 0, F.lit("")).when(F.col("_exact"), fast).otherwise(slow).alias(f"{f}_by_turn")]
    return g.select(*out)


def _counted(k: int):
    return lambda x: (F.shiftright(x["b"], k).bitwiseAND(1) == 1) & (x["t"] >= 0) & (x["t"] < F.col("_n"))


def _mask(bits: list[Column]) -> Column:
    """The turn's flags packed into one int (bit k = flag k)."""
    out = bits[0]
    for k, b in enumerate(bits[1:], start=1):
        out = out + F.shiftleft(b, k)
    return out


def _bit(k: int):
    return lambda x: F.shiftright(x["b"], k).bitwiseAND(1).cast("string")


def _fired(k: int):
    return lambda x: F.shiftright(x["b"], k).bitwiseAND(1) == 1


def _turn():
    return lambda x: x["t"]


def _present(fires: Column):
    return lambda i: F.when(F.array_contains(fires, i), F.lit("1")).otherwise(F.lit("0"))


def repair_backfill(metadata: DataFrame, store: DataFrame) -> DataFrame:
    """Per metadata row the repair outcome — repaired (a conversation
    exists and the turn count is an integer), no_conversation, bad_shape —
    tallied, plus the success-but-missing diagnostic."""
    s = store.select("request_id", F.lit(True).alias("_has"))
    j = metadata.join(s, "request_id", "left")
    n = F.expr("try_cast(turn_count_value AS BIGINT)")
    outcome = (F.when(F.col("_has").isNull(), F.lit("no_conversation"))
                .when(n.isNull(), F.lit("bad_shape")).otherwise(F.lit("repaired")))
    diag = F.when(F.col("_has").isNull() & (F.col("status") == "success"),
                  F.lit("success_missing_conversation"))
    x = j.select(F.explode(F.array_compact(F.array(outcome, diag))).alias("outcome"))
    return x.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


METRIC_COLUMNS = tuple(f"{f}_{m}" for f in S.ALL_FLAGS for m in ("sum", "by_turn"))


def repair_rows(metadata: DataFrame, store: DataFrame, turns: DataFrame) -> DataFrame:
    """``metadata`` with the flag metrics of every row that has a
    conversation in ``store(request_id)`` and an integer turn count, taken anew
    from its ``turns``, whatever the row's status; the others keep what they
    have. ``outcome`` says which (``repaired``, ``no_conversation``,
    ``bad_shape``), ``changed`` whether a metric differs from before."""
    n = F.expr("try_cast(turn_count_value AS BIGINT)")
    counted = turns.drop("turn_count_value").join(
        metadata.select("request_id", n.alias("turn_count_value")).where(F.col("turn_count_value").isNotNull()), "request_id")
    metrics = flag_metrics(counted).select("request_id", *[F.col(c).alias(f"_{c}") for c in METRIC_COLUMNS])
    has = store.select("request_id").distinct().withColumn("_has", F.lit(True))
    j = metadata.join(has, "request_id", "left").join(metrics, "request_id", "left")
    outcome = (F.when(F.col("_has").isNull(), "no_conversation").when(n.isNull(), "bad_shape").otherwise("repaired"))
    blank = F.array_join(F.array_repeat(F.lit("0"), F.greatest(n, F.lit(0)).cast("int")), ",")       # no turn at all
    new = {c: F.when(outcome == "repaired", F.coalesce(F.col(f"_{c}"), blank if c.endswith("_by_turn") else F.lit(0)))
           .otherwise(F.col(c)) for c in METRIC_COLUMNS}
    differs = F.lit(False)
    for c in METRIC_COLUMNS:
        differs = differs | ~new[c].eqNullSafe(F.col(c))
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in metadata.columns],
                    outcome.alias("outcome"), differs.alias("changed"))


def reconstruct_rows(matched: DataFrame, records: DataFrame, turns: DataFrame) -> DataFrame:
    """J4, whole rows: matched rows (``reconstruct_match``) take the record's
    prompts and total tokens, no error, and the flag metrics of its ``turns``;
    pending rows have the rendered prompts, no tokens and no metrics.
    ``records(request_id, system_prompt, user_prompt, total_tokens)``."""
    hit = F.col("status") == "success"
    own = records.select("request_id", F.col("system_prompt").alias("_system"), F.col("user_prompt").alias("_user"),
                         F.col("total_tokens").alias("_total"), F.lit(True).alias("_own")).dropDuplicates(["request_id"])
    counted = turns.drop("turn_count_value").join(matched.where(hit).select("request_id", "turn_count_value"), "request_id")
    j = render_prompts(matched).join(own, "request_id", "left").join(flag_metrics(counted), "request_id", "left")
    return j.select(*matched.columns,
                    F.when(hit, F.coalesce("_system", "system_prompt")).otherwise(F.col("system_prompt")).alias("system_prompt"),
                    F.when(hit, F.coalesce("_user", "user_prompt")).otherwise(F.col("user_prompt")).alias("user_prompt"),
                    F.when(hit, F.coalesce("_total", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("total_tokens"),
                    F.lit("").alias("last_error"), *METRIC_COLUMNS)


def token_usage(rows: DataFrame, by: str = "prompt_template_key") -> DataFrame:
    """Token totals and integer (floor) per-conversation means over successes."""
    s = rows.filter(F.col("status") == "success")
    g = s.groupBy(by).agg(F.count(F.lit(1)).alias("n_success"),
                          F.sum("input_tokens").alias("input_total"),
                          F.sum("output_tokens").alias("output_total"),
                          F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_total"))
    return g.select(by, "n_success", "input_total", "output_total", "total_total",
                    *[F.expr(f"{c}_total div n_success").alias(f"{c}_mean")
                      for c in ("input", "output", "total")])


def status_counts(rows: DataFrame, label: str = "prompt_template_key") -> DataFrame:
    """Rows per (run label, status)."""
    return rows.groupBy(F.col(label).alias("run_label"), "status").agg(F.count(F.lit(1)).alias("n"))
