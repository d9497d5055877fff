"""Query registry: every operator of the survey is registered once, with its
Spark plan and, where the semantics are SQL-expressible, its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the plan modules fills the registry.
    from lodestar.plans import (q_io, q_profile, q_clean, q_features, q_relations,  # noqa: F401
                                q_split, q_linear, q_resample, q_enrich, q_models, q_diagnostics)
