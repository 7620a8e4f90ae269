"""Where queries and their oracle statements are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function of ``Tables`` under its name, with its SQL counterpart."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = function.__name__
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register
