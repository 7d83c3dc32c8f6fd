"""Candidate grids, random search and the record of tried pipelines."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

# Search ranges of the model adapters. Fixed values: (kind, low, high, step).
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "linear_regression": {"fit_intercept": ("cat", (True, False))},
    "ridge": {"alpha": ("float", 0.0, 4.0, 0.1), "fit_intercept": ("cat", (True, False))},
    "lasso": {"alpha": ("float", 0.0, 4.0, 0.1), "fit_intercept": ("cat", (True, False))},
    "elasticnet": {"alpha": ("float", 0.1, 4.0, 0.1), "l1_ratio": ("float", 0.0, 1.0, 0.05),
                   "fit_intercept": ("cat", (True, False))},
    "xgb": {"min_child_weight": ("int", 1, 100, 5), "gamma": ("float", 0.1, 5.0, 0.5),
            "subsample": ("float", 0.1, 1.0, 0.1), "colsample_bytree": ("float", 0.1, 1.0, 0.1),
            "max_depth": ("int", 1, 10, 1)},
    "lgbm": {"learning_rate": ("float", 0.01, 0.3, None), "num_leaves": ("int", 20, 3000, 20), "max_depth": ("int", 3, 12, 1),
             "min_data_in_leaf": ("int", 200, 10000, 100), "max_bin": ("int", 200, 300, 1), "lambda_l1": ("int", 0, 100, 5),
             "lambda_l2": ("int", 0, 100, 5), "min_gain_to_split": ("float", 0.0, 15.0, None),
             "bagging_fraction": ("float", 0.2, 0.95, 0.1), "feature_fraction": ("float", 0.2, 0.95, 0.1)},
    "sarimax": {"max_p": ("int", 2, 10, 2), "max_d": ("int", 2, 10, 2), "max_q": ("int", 2, 10, 2)},
}

# Parameter grids used without random search. Fixed values.
SEARCH_GRIDS: dict[str, dict[str, Sequence[Any]]] = {
    "linear_regression": {"fit_intercept": [True, False]},
    "ridge": {"alpha": [0.1, 0.5, 0.8, 1, 2]},
    "lasso": {"alpha": [0.1, 0.5, 0.8, 1.0, 2.0], "fit_intercept": [True, False]},
    "elasticnet": {"alpha": [0.1, 0.5, 0.8, 1.0, 2.0],
                   "l1_ratio": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], "fit_intercept": [True, False]},
    "xgb": {"min_child_weight": [1, 5, 10], "gamma": [0.5, 1, 1.5, 2, 5], "subsample": [0.6, 0.8, 1.0],
            "colsample_bytree": [0.6, 0.8, 1.0], "max_depth": [3, 4, 5, 6, 7]},
    "lgbm": {"n_estimators": [10, 100, 1000, 10000, 100000],
             "learning_rate": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9],
             "num_leaves": [20, 200, 2000, 30000], "max_depth": [3, 5, 7, 8, 10, 12], "min_data_in_leaf": [200, 1000, 5000, 10000],
             "max_bin": [200, 250, 300], "lambda_l1": [0, 10, 50, 100], "lambda_l2": [0, 10, 50, 100],
             "min_gain_to_split": [0, 1, 5, 10, 15], "bagging_fraction": [0.2, 0.4, 0.6, 0.8, 0.95],
             "feature_fraction": [0.2, 0.4, 0.6, 0.8, 0.95]},
    "sarimax": {"max_p": [2, 4, 6, 8], "max_d": [1, 3], "max_q": [2, 4, 6, 8]},
}

# More combinations than this are not a grid anyone can try.
GRID_LIMIT = 100_000


def expand_grid(spec: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """Every combination of the listed values, last name fastest; raises where
    there are more than `GRID_LIMIT`."""
    size = math.prod(len(v) for v in spec.values())
    if size > GRID_LIMIT:
        raise ValueError(f"a grid of {size} combinations; list fewer values or search at random")
    return [dict(zip(spec, values)) for values in itertools.product(*spec.values())]


def grid_frame(spark: SparkSession, spec: Mapping[str, Sequence[Any]]) -> DataFrame:
    """The same combinations as rows, numbered from 0."""
    rows = [(i, *c.values()) for i, c in enumerate(expand_grid(spec))]
    return spark.createDataFrame(rows, ["candidate", *spec])


def sample_space(spark: SparkSession, spec: Mapping[str, tuple], n: int, seed: int = 0) -> DataFrame:
    """`n` seeded random draws: one row per trial, one column per name.

    A draw hashes (seed, trial, name), so it depends on nothing else.
    """
    d = spark.range(n).select(F.col("id").alias("trial"))
    out = {}
    for name, (kind, *rest) in spec.items():
        u = F.xxhash64(F.lit(seed), F.col("trial"), F.lit(name)) / F.lit(2.0**64) + 0.5
        if kind == "cat":
            values = [F.lit(v) for v in rest[0]]
            out[name] = F.get(F.array(*values), F.floor(u * len(values)).cast("int"))
        else:
            lo, hi, step = rest
            if step is None:
                out[name] = F.lit(lo) + u * (hi - lo)
            else:
                steps = int((hi - lo) / step + 1e-9) + 1
                value = F.lit(lo) + F.floor(u * steps) * F.lit(step)
                out[name] = value.cast("long") if kind == "int" else F.round(value.cast("double"), 10)
    return d.withColumns(out)


def best_trial(trials: DataFrame, score: str = "score", trial: str = "trial", direction: str = "minimize") -> DataFrame:
    """The best scored row; the earliest trial wins a tie."""
    if direction not in ("minimize", "maximize"):
        raise ValueError(f"unknown direction {direction!r}")
    s = F.col(score) if direction == "minimize" else -F.col(score)
    everything = F.struct(*[F.col(c) for c in trials.columns])
    return trials.filter(F.col(score).isNotNull()).agg(F.min_by(everything, F.struct(s, F.col(trial))).alias("b")).filter(
        "b IS NOT NULL").select("b.*")


def performance_row(best_params: Mapping[str, Any], train: float | None, val: float | None, test: float | None,
                    train_cv_score: float | None) -> dict[str, Any]:
    """The record kept for one fitted pipeline."""
    return {"best_params": dict(best_params), "train": train, "val": val, "test": test, "train_cv_score": train_cv_score}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
