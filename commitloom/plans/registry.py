"""Registry of runnable queries: name, Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from commitloom.plans.bindings import Tables, with_bindings


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    oracle: str | None


FAMILIES = ["scalars", "changes", "graphs", "impacts", "insights", "texts", "imports", "searches", "lookups", "reports", "streams"]
REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, uses: str = "") -> Callable:
    """Register the decorated ``plan(t: Tables)`` under ``name`` with its oracle SQL."""

    def wrap(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        oracle = with_bindings(sql, *uses.split()) if sql else None
        REGISTRY[name] = Query(name, plan, oracle)
        return plan

    return wrap


def load_all() -> dict[str, Query]:
    import importlib

    for family in FAMILIES:
        importlib.import_module(f"commitloom.plans.{family}")
    return REGISTRY


def runner(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query.plan(Tables(spark, folder))

    return run
