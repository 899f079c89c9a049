"""The table of named queries: a Spark plan and, where SQL can express it, the same query as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gaugegrid.plans.sqltext import render
from gaugegrid.sources.fixtures import Tables


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    items: str


REGISTRY: dict[str, Query] = {}


def query(name: str, items: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` may use the common tables of ``sqltext``."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, plan, render(sql) if sql else None, items)
        return plan

    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return q.plan(Tables(spark, directory))

    run.__name__ = q.name
    return run
