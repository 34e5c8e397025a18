"""Query registry: name -> (Spark builder, optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is its DuckDB twin."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so that its queries register themselves."""
    from jobsieve.plans import (  # noqa: F401
        governance_plans,
        maintain_plans,
        model_plans,
        question_plans,
        ranking_plans,
        salary_plans,
        search_plans,
        skill_plans,
        source_plans,
        stats_plans,
        stream_plans,
        taxonomy_plans,
    )
