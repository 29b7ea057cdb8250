"""Prompt-dimension and detector-dimension documents as small
dimension tables (template_dims, dim_values, flavors, stances).

These are configuration documents (kilobytes), read whole as text and parsed
with ``from_json``; validation failures raise before any data job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.validate import ValidationError

DETECTOR_REQUIRED = ("objective_key", "applies_to_speaker", "base_prompt", "stances")
PROMPT_REQUIRED = ("prompt_templates", "flavors")


#: FIXED VALUES: the metadata column that a template's field fills.
FIELD_COLUMNS = {"scenario_key": "scenario", "representative_key": "representative", "caller_key": "caller",
                 "benign_context_key": "benign_context", "cialdini_emphasis_key": "cialdini_emphasis",
                 "turn_count_key": "turn_count_value"}


def _doc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string,string>").alias("doc"),
        F.col("_metadata.file_path").alias("source"))


def read_detector_dims(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Detector dimension files → stances(objective, speaker, stance, ord,
    description, instruction, template); every file must define the required
    keys, a base prompt template, and all three preset stances with an
    instruction. ``file`` is the place of the file in ``paths``."""
    d = _doc(spark, paths)
    rows = d.select(
        "source",
        F.col("doc")["objective_key"].alias("objective"),
        F.col("doc")["applies_to_speaker"].alias("speaker"),
        F.get_json_object(F.col("doc")["base_prompt"], "$.template").alias("template"),
        F.from_json(F.col("doc")["stances"], "map<string, struct<description:string, instruction:string>>")
        .alias("stances"),
        F.map_keys("doc").alias("keys"))
    said = F.coalesce(F.map_entries("stances"), F.array())
    checks = rows.select(
        "source", F.col("template").isNull().alias("no_template"),
        F.transform(F.filter(said, lambda e: e["key"].isin(*S.STANCES) & e["value"]["instruction"].isNull()),
                    lambda e: e["key"]).alias("no_instruction"),
        F.array_except(F.array(*[F.lit(k) for k in DETECTOR_REQUIRED]), F.col("keys")).alias("missing"),
        F.array_except(F.array(*[F.lit(s) for s in S.STANCES]),
                       F.coalesce(F.map_keys("stances"), F.array().cast("array<string>"))).alias("missing_st"))
    bad = checks.filter((F.size("missing") > 0) | (F.size("missing_st") > 0) | F.col("no_template")
                        | (F.size("no_instruction") > 0)).limit(3).collect()
    if bad:
        raise ValidationError(f"detector dimensions invalid: {[r.asDict() for r in bad]}")
    place = F.lit(len(paths))
    for k, path in enumerate(paths):
        place = F.when(F.col("source").endswith("/" + path.rstrip("/").rpartition("/")[2])
                       | F.col("source").contains("/" + path.rstrip("/").rpartition("/")[2] + "/"), k).otherwise(place)
    return rows.select("objective", "speaker", "template", place.alias("file"),
                       F.posexplode(F.map_entries("stances")).alias("ord", "e")).select(
        "objective", "speaker", "file", F.col("e.key").alias("stance"), "ord",
        F.col("e.value.description").alias("description"),
        F.col("e.value.instruction").alias("instruction"), "template")


def stance_catalogue_from_files(stances: DataFrame) -> DataFrame:
    """``(stance, ord)``, the distinct stances of the detector files in order
    of first appearance, file after file; the presets when there are none."""
    found = stances.groupBy("stance").agg(F.min(F.struct("file", "ord")).alias("_at"))
    ranked = found.select("stance", (F.row_number().over(Window.orderBy("_at")) - 1).cast("int").alias("ord"))
    preset = stances.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in S.STANCES])).alias("ord", "stance"))
    empty = ranked.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return ranked.unionByName(preset.join(empty, F.lit(True)).select("stance", "ord"))


def detector_prompts(stances: DataFrame) -> DataFrame:
    """P26 for detectors: ``(objective, stance, system_prompt)``, each file's
    template with the stance's instruction in place."""
    return stances.select("objective", "stance", F.replace(
        F.col("template"), F.lit("{stance_instruction}"), F.coalesce("instruction", F.lit(""))).alias("system_prompt"))


def grid_vocab(template_dims: DataFrame, values: DataFrame, flavors: DataFrame) -> DataFrame:
    """S5 → J8: ``(prompt_template_key, axis, value, ord)`` of every template from
    the documents' tables; a column that a template does not declare has the
    one value ''."""
    column = F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_COLUMNS.items() for x in kv]), F.col("field"))
    templates = template_dims.select(F.col("template").alias("prompt_template_key")).distinct()
    declared = template_dims.select(F.col("template").alias("prompt_template_key"), column.alias("axis"), "dimension") \
        .where(F.col("axis").isNotNull())
    axes = F.explode(F.array(*[F.lit(c) for c in FIELD_COLUMNS.values()]))
    filled = templates.select("prompt_template_key", axes.alias("axis")).join(
        declared, ["prompt_template_key", "axis"], "left").join(values, "dimension", "left")
    place = F.row_number().over(Window.partitionBy("prompt_template_key", "axis").orderBy("key"))
    rows = filled.select("prompt_template_key", "axis", F.coalesce("value", F.lit("")).alias("value"),
                         (place - 1).cast("long").alias("ord"))
    tone = F.row_number().over(Window.partitionBy("prompt_template_key").orderBy("ord"))
    return rows.unionByName(templates.join(flavors, F.lit(True)).select(
        "prompt_template_key", F.lit("flavor").alias("axis"), F.col("flavor").alias("value"), (tone - 1).cast("long").alias("ord")))


def read_prompt_dims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prompt dimensions → (template_dims(template, field, dimension, text),
    dim_values(dimension, key, value), flavors(ord, flavor))."""
    d = _doc(spark, path)
    keys = d.select(F.map_keys("doc").alias("k")).first().k or []
    missing = [k for k in PROMPT_REQUIRED if k not in keys]
    if missing:
        raise ValidationError(f"prompt dimensions missing keys: {missing}")
    tpl = d.select(F.explode(F.from_json(
        F.col("doc")["prompt_templates"],
        "map<string, struct<template:string, dimensions:map<string,string>>>")).alias("template", "t"))
    template_dims = tpl.select("template", F.col("t.template").alias("text"),
                               F.explode("t.dimensions").alias("field", "dimension"))
    dims = [r.dimension for r in template_dims.select("dimension").distinct().collect()]
    values = None
    for dim in dims:
        v = d.select(F.explode(F.from_json(F.col("doc")[dim], "map<string,string>")).alias("key", "value")) \
            .select(F.lit(dim).alias("dimension"), "key", "value")
        values = v if values is None else values.unionByName(v)
    flavors = d.select(F.posexplode(F.from_json(F.col("doc")["flavors"], "array<string>"))
                       .alias("ord", "flavor"))
    return template_dims, values, flavors
