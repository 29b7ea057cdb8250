"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from . import analysis_queries, detection_queries, explore_queries, grid_queries, stream_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v() if callable(v) else v for k, v in ORACLE.items() if k in QUERIES}
