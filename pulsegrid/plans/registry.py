"""The registry of queries over the driver's tables, each with SQL for DuckDB that says the same.

Doubles are rounded to six decimals on both sides, and + 0.0 makes a negative zero positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + 0.0


def long_of(df: DataFrame, keys: list[str], data: Column, name: str = "y") -> DataFrame:
    return df.select(*keys, F.posexplode(data).alias("i", name)).select(*keys, F.col("i").cast("long").alias("i"), r6(name).alias(name))


def values(name: str, numbers, columns: str = "k, h") -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(map(float, numbers))) + ")"
