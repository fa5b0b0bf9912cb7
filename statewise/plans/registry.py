"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statewise.plans.bindings import DUCK, Bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: Callable[[], str] | None = None):
    """Register ``build(bound) -> DataFrame`` under ``name``."""

    def wrap(build: Callable[[Bound], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Bound(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle()
        return build

    return wrap


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the bound views (space-separated) as CTEs."""
    return DUCK.with_views(names.split(), body)
