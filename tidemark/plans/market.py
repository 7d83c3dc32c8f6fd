"""Market series: aligned daily changes with calendar, lag and difference features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tidemark.functions.calendar import calendar_features
from tidemark.operators.joins import align
from tidemark.operators.ordered import add_diffs, add_lags, difference
from tidemark.series import Series


def market_changes(target: DataFrame, exogenous: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Two value columns on common dates, as day-to-day changes."""
    return difference(align([target, exogenous], [*s.keys, s.ts]), s, cols)


def market_features(df: DataFrame, s: Series, target: str, exogenous: str,
                    lags: Mapping[str, Sequence[int]] | None = None, diffs: Sequence[int] = (1, 2)) -> DataFrame:
    """Calendar columns, lags, differences of every lag; the same-day exogenous
    value is not known in advance and is dropped."""
    lags = lags or {target: [1, 2, 3], exogenous: [1, 2]}
    df = add_lags(calendar_features(df, s.ts), s, [target, exogenous], lags)
    lagged = [f"{c}_lag{k}" for c, ks in lags.items() for k in ks]
    return add_diffs(df, s, lagged, diffs).drop(exogenous)


def market_hook(target: str, exogenous: str) -> Any:
    """The features as an experiment hook."""
    return lambda params, df, s: market_features(df, s, target, exogenous)
