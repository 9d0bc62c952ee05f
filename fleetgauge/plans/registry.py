"""Registered queries: a builder over the bound inputs and, where SQL can say it, a checking query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .bindings import Inputs, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
#: Checking queries as written, over the names of the bindings.
TEXTS: dict[str, str] = {}


def add(name: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Inputs(configure(spark), sf_dir))

    QUERIES[name] = run
    if sql is not None:
        TEXTS[name] = sql
        CHECKS[name] = check_sql(sql)
