"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonearm.plans.views import sql
from tonearm.sources.library import Library

QUERIES: dict[str, Callable[[Library], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None = None):
    """Register a function of the library as a query; ``body`` is its SQL, views by name."""

    def register(f: Callable[[Library], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body)
        return f

    return register


def _load() -> None:
    from tonearm.plans import analysis, discovery, evaluation, matching, relational  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Library(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["win_rank_group"](Library(spark, sf_dir))
