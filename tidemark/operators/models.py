"""Boosted trees for one table: a thin face of `boost`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import boost

# What the two adapters leave to their libraries: learning rate, leaves, ridge penalty.
XGB = {"rate": 0.3, "l2": 1.0}
LGBM = {"rate": 0.1, "leaves": 31, "depth": 12, "least": 20}
ADAPTERS = {"xgb": XGB, "lgbm": LGBM}


def fit_gbt(df: DataFrame, target: str, cols: Sequence[str], params: Mapping[str, Any] | None = None,
            rounds: int = 100, adapter: str = "xgb") -> boost.Boosted:
    """Fit on the train part (all rows if there is no split column). Rows with
    missing features take part; those without a target do not."""
    train = df.filter(F.col("split") == "train") if "split" in df.columns else df
    return boost.fit_many(train, target, cols, [params or {}], **{"rounds": rounds, **ADAPTERS[adapter]})[0]


def predict_gbt(model: boost.Boosted, df: DataFrame, out: str = "predicted") -> DataFrame:
    """A prediction for every row, also where features are missing."""
    return boost.predict(model, df, 0, out)
