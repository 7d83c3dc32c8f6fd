"""Joins between series tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def align(dfs: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Put series side by side on a shared key and keep complete rows.

    An outer alignment followed by dropping every incomplete row keeps exactly
    the keys present in all tables with all values set. Saying so directly lets
    Spark push the NULL filters below an inner join.
    """
    return reduce(lambda a, b: a.join(b, list(on)), [d.na.drop() for d in dfs])


def merge_all(dfs: Sequence[DataFrame], on: Sequence[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), how), dfs)


def without_match(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key is absent from `other`."""
    return df.join(other.select(*on), list(on), "left_anti")
