"""Stage tables and result records of an experiment, as Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.columns import nan_to_null

# Fixed value: artifact names are cut to this many characters.
NAME_LIMIT = 100


def artifact_name(*parts: Column | str) -> Column:
    """Name columns joined by `_` and cut to the limit."""
    return F.substring(F.concat_ws("_", *parts), 1, NAME_LIMIT)


def rounded(params: Mapping[str, Any]) -> dict[str, Any]:
    """Floats to 4 digits, as they appear in artifact names."""
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in params.items()}


@dataclass(frozen=True)
class Store:
    """Tables under `{base}/{experiment}/{trial}/{stage}`, partitioned by split.

    `base` must be a folder that every executor can reach.
    """

    spark: SparkSession
    base: str
    experiment: str = field(default_factory=lambda: str(uuid.uuid4()))

    def path(self, stage: str, trial: int | None = None) -> str:
        return f"{self.base}/{self.experiment}/{'shared' if trial is None else trial}/{stage}"

    def write(self, df: DataFrame, stage: str, trial: int | None = None) -> DataFrame:
        """Write a stage and read it back, so that later work starts from disk."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy("split") if "split" in df.columns else writer).parquet(self.path(stage, trial))
        return self.read(stage, trial)

    def read(self, stage: str, trial: int | None = None, split: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path(stage, trial))
        return df.filter(F.col("split") == split) if split is not None else df

    def write_result(self, row: Mapping[str, Any], name: str) -> None:
        """Append one result record: name, parameters as a map, metrics."""
        metrics = {k: v for k, v in row.items() if k != "best_params"}
        params = {k: str(v) for k, v in rounded(row.get("best_params", {})).items()}
        record = self.spark.createDataFrame(
            [(name[:NAME_LIMIT], params, json.dumps(row.get("best_params", {}), sort_keys=True),
              {k: (float(v) if v is not None else None) for k, v in metrics.items()})],
            "name string, params map<string,string>, params_json string, metrics map<string,double>")
        record.write.mode("append").parquet(f"{self.base}/{self.experiment}/results")

    def read_results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{self.experiment}/results")


def land(spark: SparkSession, loader: Callable[[SparkSession], DataFrame], store: Store) -> DataFrame:
    """Call the loader, make NULL the only missing marker, and keep the result."""
    return store.write(nan_to_null(loader(spark)), "landed_data")
