"""Registering scalar functions for SQL, with the volatility they declare."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession, functions as F


def register_scalar(spark: SparkSession, name: str, fn: Callable[[pd.Series], pd.Series], returns: str, *, volatile: bool = False):
    """Make a function of one column callable from SQL; ``fn`` maps whole Arrow batches.

    ``volatile`` keeps the optimizer from assuming that equal arguments give equal results.
    """
    def batch(column: pd.Series) -> pd.Series:
        return fn(column)

    udf = F.pandas_udf(batch, returns)
    return spark.udf.register(name, udf.asNondeterministic() if volatile else udf)


def url_host_function() -> Callable:
    """Host of each URL of a column; nested, so that it travels to the executors by value."""
    def host(urls):
        return urls.str.extract(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", expand=False).str.lower()
    return host
