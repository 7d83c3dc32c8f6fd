"""Supplier orders: calendar parts and the value of the row before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordered import add_lags
from tidemark.series import Series


def supplier_features(df: DataFrame, s: Series, value: str = "orders") -> DataFrame:
    """`weekday` (Monday = 0), `month`, `year`, `yesterday`; each first row goes."""
    df = df.withColumns({"weekday": F.weekday(s.ts), "month": F.month(s.ts), "year": F.year(s.ts)})
    return add_lags(df, s, [value], [1]).withColumnRenamed(f"{value}_lag1", "yesterday")
