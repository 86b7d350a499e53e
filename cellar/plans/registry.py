"""Registry of named queries bound to the driver's test tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is the equivalent
DuckDB statement over the same tables (None when the result is not expressible
in SQL, e.g. generators or sinks, which get a rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills REGISTRY
    from cellar.plans import (  # noqa: F401
        q_aggregate,
        q_charts,
        q_cleaning,
        q_filters,
        q_findings,
        q_functions,
        q_jobs,
        q_ordered,
        q_profile,
        q_sheet,
        q_sources,
        q_text,
    )

    return REGISTRY
