"""Registry of named queries: a Spark callable, inventory ids, and an optional DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from casemill.plans import standins


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[["standins.Tables"], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(standins.Tables(spark, sf_dir))

    def oracle(self) -> str | None:
        return standins.oracle_text(self.sql) if self.sql else None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``sql`` may use ``@table`` for any base table or stand-in."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(ids.split()), build, sql)
        return build

    return register
