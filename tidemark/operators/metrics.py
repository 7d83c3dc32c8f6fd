"""Accuracy as positive losses, and tables of actual against predicted."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import TEST, TRAIN, VAL

Metric = Callable[[Column, Column], Column]
# Fixed value: the smallest denominator of MAPE.
MAPE_EPSILON = 2.220446049250313e-16


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(MAPE_EPSILON)))


def wape(y: Column, p: Column) -> Column:
    return F.try_divide(F.sum(F.abs(y - p)), F.sum(F.abs(y)))


METRICS: dict[str, Metric] = {
    "neg_mean_squared_error": mse, "neg_mean_absolute_error": mae,
    "neg_mean_absolute_percentage_error": mape, "wape": wape,
    "mse": mse, "mae": mae, "mape": mape,
}


def metric_of(metric: str | Metric) -> Metric:
    """A registered loss by name, or any function (actual, predicted) -> aggregate."""
    if callable(metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(METRICS)}")
    return METRICS[metric]


def actual_vs_predicted(df: DataFrame, keys: Sequence[str], ts: str, target: str, predicted: str = "predicted") -> DataFrame:
    return df.select(*keys, ts, "split", F.col(target).cast("double").alias("actual"), F.col(predicted).alias("predicted"))


def split_losses(actual: Column, predicted: Column, metrics: Mapping[str, str | Metric]) -> Column:
    """Array of one struct per split: name, row count and losses.

    Each loss sees NULL for rows of other splits, which aggregates skip, so all
    splits are scored in one aggregate and an empty split has NULL losses.
    """
    parts = []
    for name in (TRAIN, VAL, TEST):
        here = (F.col("split") == name) & actual.isNotNull() & predicted.isNotNull()
        y, p = F.when(here, actual), F.when(here, predicted)
        parts.append(F.struct(F.lit(name).alias("split"), F.count_if(here).alias("rows"),
                              *[metric_of(m)(y, p).alias(n) for n, m in metrics.items()]))
    return F.array(*parts)


def evaluate(pred: DataFrame, metrics: Mapping[str, str | Metric], keys: Sequence[str] = ()) -> DataFrame:
    """Losses per split; a split without rows is there with NULL losses."""
    scored = pred.groupBy(*keys).agg(split_losses(F.col("actual"), F.col("predicted"), metrics).alias("__s"))
    return scored.select(*keys, F.inline("__s"))
