"""The registered queries and their SQL, and what writing them takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def wrap(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return wrap


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def counted(*parts: tuple[str, str, str, str]) -> str:
    """SQL of a report: (path, code, condition, table)."""
    return "select path, code, count(*)::bigint as n from (" + " union all ".join(f"select '{p}' as path, '{c}' as code from {tab} where {cond}" for p, c, cond, tab in parts) + ") group by path, code"


def either(key: str, n: int, bad: str, good: str) -> Column:
    """A bad text where the key is divisible by n, else a good one."""
    return F.when(F.col(key) % n == 0, F.lit(bad)).otherwise(F.lit(good))
