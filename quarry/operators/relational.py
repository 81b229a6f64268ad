"""Relational operators as plain DataFrame functions.

Each builds a declarative plan and leaves the physical strategy to Catalyst and AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


def condition(left: str | Column, op: str, right) -> Column:
    """``left op right``; ``right`` is a column or a value."""
    column = F.col(left) if isinstance(left, str) else left
    return COMPARE[op](column, right if isinstance(right, Column) else F.lit(right))


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet all conditions."""
    return reduce(lambda d, c: d.where(c), conditions, df)


def project(df: DataFrame, *columns, **named: Column) -> DataFrame:
    """Columns in the given order, then the named expressions."""
    return df.select(*columns, *[c.alias(n) for n, c in named.items()])


def join(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Join on any condition (none: every pair); ``how`` may be semi, anti, left, right or full."""
    how = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    right = right.hint(hint) if hint else right
    if on is None:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    return left.join(right, on, how)


def aggregate(df: DataFrame, by=(), having: Column | None = None, **measures: Column) -> DataFrame:
    """Grouped (or with no keys, global) aggregates, then the HAVING filter."""
    if not measures:
        return df.select(*by).distinct()
    out = df.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])
    return out if having is None else out.where(having)


def top(df: DataFrame, keys, limit: int | None = None) -> DataFrame:
    """Total order by ``keys`` (columns), with a limit a top-k."""
    out = df.orderBy(*keys)
    return out if limit is None else out.limit(limit)


def key_range(df: DataFrame, **bounds) -> DataFrame:
    """Rows by column bounds: a value means equality, a pair (low, high) an inclusive range, None open."""
    for name, bound in bounds.items():
        if isinstance(bound, tuple):
            low, high = bound
            df = df if low is None else df.where(F.col(name) >= low)
            df = df if high is None else df.where(F.col(name) <= high)
        else:
            df = df.where(F.col(name) == bound)
    return df
