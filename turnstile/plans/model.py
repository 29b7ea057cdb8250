"""The analysis DAG for one dataset: domain tables → facts → labelled
conversation table. Every attribute is a lazy DataFrame; nothing is
collected. Build once per (session, sf_dir) and reuse across queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import short_label
from ..operators import facts as FX
from ..operators import roc as R
from ..sources.fixture import Domain

LABEL_DIMENSIONS = ("representative", "benign_context", "cialdini_emphasis")


def short_label_columns(meta: DataFrame, normalizers: dict | None = None) -> list:
    """P19 columns ``short_<dimension>`` for the three labelled dimensions."""
    normalizers = normalizers or {}
    out = []
    for dim in LABEL_DIMENSIONS:
        key = F.col(f"{dim}_key") if f"{dim}_key" in meta.columns else None
        sel = F.col("selection").getItem(f"{dim}_key") if "selection" in meta.columns else None
        out.append(short_label(dim, key, sel, F.col(dim), normalizers.get(dim)).alias(f"short_{dim}"))
    return out


class Model:
    """Facts layer over the ingested domain tables. The conversation-, key-
    and stance-grain facts are written once to the shared checkpoint folder
    (``materialize=True``) and every report reads them back — the reports
    never recompute the turn-level aggregations, and lineage is cut at a
    durable table (an executor loss recomputes nothing upstream)."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.domain = Domain(spark, sf_dir)
        self.materialize = materialize

    def _table(self, name: str, build) -> DataFrame:
        if not self.materialize:
            return build()
        path = f"{self._facts_dir}/{name}"
        build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def _facts_dir(self) -> str:
        from ..session import scratch_path
        return scratch_path(self.spark, "facts")

    @cached_property
    def conv_facts(self) -> DataFrame:
        return self._table("conv_facts", lambda: FX.conversation_flag_facts(self.domain.turns))

    @cached_property
    def det_core(self) -> DataFrame:
        return self._table("det_core",
                           lambda: FX.detection_facts(self.domain.detections, self.conv_facts))

    @cached_property
    def det_facts(self) -> DataFrame:
        return self._table("det_facts", lambda: FX.with_pre_at_post(self.det_core, self.domain.turns))

    @cached_property
    def firsts(self) -> DataFrame:
        return self._table("firsts", lambda: FX.stance_firsts(self.domain.detections))

    @cached_property
    def combined(self) -> DataFrame:
        return FX.combined_first(self.det_core)

    @cached_property
    def labels(self) -> DataFrame:
        def build():
            m = self.domain.analysis_meta
            return m.select("request_id", *short_label_columns(m))
        return self._table("labels", build)

    @cached_property
    def conv(self) -> DataFrame:
        """Conversation facts glued to labelled metadata by key (never by position)."""
        return self.conv_facts.join(self.labels, "request_id")

    @cached_property
    def turn_table(self) -> DataFrame:
        return FX.turn_table(self.domain.turns)

    def scores(self, slice_cols: tuple[str, ...] = ()) -> DataFrame:
        base = self.conv if slice_cols else self.conv_facts
        return R.scenario_scores(base, self.firsts, slice_cols)


_CACHE: dict[tuple, Model] = {}


def model(spark: SparkSession, sf_dir: str) -> Model:
    """Per-session memo so queries share one facts layer."""
    from ..session import session_key
    from ..sources import fixture as FXT
    key = (session_key(spark), sf_dir, FXT.GROWTH)
    if key not in _CACHE:
        _CACHE[key] = Model(spark, sf_dir)
    return _CACHE[key]


__all__ = ["Model", "model", "S"]
