"""Registry of report jobs: name -> (Spark builder, DuckDB oracle SQL, operator ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Report:
    name: str
    build: Builder
    sql: str | None
    ops: str


REGISTRY: dict[str, Report] = {}


def report(name: str, ops: str, sql: str | None = None):
    """Register ``fn(spark, data_dir) -> DataFrame`` with its oracle SQL (None: no SQL form)."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate report {name}")
        REGISTRY[name] = Report(name, fn, sql, ops)
        return fn
    return deco
