"""Alias matching (text contains alias, longest wins) for user alias tables.

The default labels use a CASE chain (functions.columns.alias_label). A user's
alias table may have any size, so texts and aliases meet by an equi-join: every
alias is looked up by the rarest of its character grams, every text offers the
grams it has, and the few pairs that meet are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

GRAM = 4                       # characters; a shorter alias is its own gram


def alias_table(spark: SparkSession, dimension: str) -> DataFrame:
    rows = [(alias, label, i) for i, (label, alias) in enumerate(
        (lab, a) for lab, al in S.aliases_for(dimension).items() for a in al)]
    return spark.createDataFrame(rows, "alias string, label string, ord int")


def _grams(text: Column, size: int) -> Column:
    """The distinct grams of ``size`` characters."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def alias_theta_join(texts: DataFrame, aliases: DataFrame, text_col: str = "text",
                     id_col: str = "request_id") -> DataFrame:
    """(id, label) for every text containing at least one alias, compared in
    lower case; the longest alias wins, ties in order of ``ord``.

    ``aliases(alias, label, ord)`` may be as large as the texts. Null texts and
    null aliases match nothing; an empty alias is in every text. A text costs its
    number of distinct grams, whatever the number of aliases."""
    named = aliases.where(F.col("alias").isNotNull()).select(F.lower("alias").alias("_alias"), "label", "ord")
    sizes = [r["n"] for r in named.select(F.least(F.length("_alias"), F.lit(GRAM)).alias("n")).distinct().collect()]
    rows = texts.select(id_col, F.lower(F.col(text_col)).alias("_t")).where(F.col("_t").isNotNull()) \
        .withColumn("_key", F.md5(F.col("_t").cast("binary")))
    once = rows.select("_key", "_t").dropDuplicates(["_key"])
    own = F.when(F.length("_alias") < GRAM, F.array("_alias")).otherwise(_grams(F.col("_alias"), GRAM))
    spelled = named.select("_alias").distinct().select("_alias", F.explode(own).alias("_gram"))
    common = spelled.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    anchor = spelled.join(common, "_gram").groupBy("_alias").agg(F.min(F.struct("_n", "_gram")).alias("_g")).select(
        "_alias", F.col("_g._gram").alias("_gram"))
    offered = F.flatten(F.array(*[F.coalesce(_grams(F.col("_t"), n), F.array().cast("array<string>")) for n in sizes])) \
        if sizes else F.array().cast("array<string>")
    met = once.select("_key", F.explode(offered).alias("_gram")).join(anchor, "_gram").select("_key", "_alias").distinct()
    found = met.join(once, "_key").where(F.col("_t").contains(F.col("_alias"))).join(named, "_alias")
    best = F.max(F.struct(F.length("_alias").alias("size"), (-F.col("ord")).alias("first"), "label"))
    return (rows.select(id_col, "_key").join(found.groupBy("_key").agg(best.alias("_best")), "_key")
            .groupBy(id_col).agg(F.max("_best").getField("label").alias("label")))
