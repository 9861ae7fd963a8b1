"""Registered queries: name -> (function of a Trace, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.plans.work import checkpointed
from spanforge.sources.adapters import PRELUDE, Trace

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: str = ""):
    """Registers a function of a Trace. sql is a SELECT over the adapters; more holds further
    common table expressions."""

    def add(function: Callable[[Trace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Trace(spark, sf_dir))
        QUERIES[name].__doc__ = function.__doc__
        if sql:
            SQL[name] = PRELUDE + (",\n" + more if more else "") + "\n" + sql
        return function

    return add


def fitting(df: DataFrame, *columns: str) -> DataFrame:
    """df, an aggregated table, with exact sums as the BIGINT of the SQL; columns with a sum beyond 64 bits, where the SQL
    ends in an overflow, stay decimals."""
    df = checkpointed(df)
    found = df.agg(*(F.coalesce(F.max(F.abs(c)), F.lit(0)).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns if found[c] < 1 << 63})
