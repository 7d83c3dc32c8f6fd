"""Run the pipeline search of an experiment.

    python -m tidemark my_package.my_module:EXPERIMENT --store /shared/results --trials 200
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from tidemark.plans.experiment import search_pipelines
from tidemark.session import ship_package
from tidemark.sources.store import Store


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("experiment", help="module:name of an Experiment")
    parser.add_argument("--store", required=True, help="folder all executors share")
    parser.add_argument("--trials", type=int, default=200)
    parser.add_argument("--direction", choices=["minimize", "maximize"], default="minimize")
    parser.add_argument("--name", help="experiment id; a new one by default")
    args = parser.parse_args(argv)
    module, _, name = args.experiment.partition(":")
    experiment = getattr(importlib.import_module(module), name or "EXPERIMENT")
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    ship_package(spark)
    store = Store(spark, args.store, args.name) if args.name else Store(spark, args.store)
    _, best = search_pipelines(spark, experiment, store, args.trials, args.direction)
    print(f"experiment {store.experiment}")
    for key, value in best.items():
        print(f"{key}: {value}")
    return best


if __name__ == "__main__":
    main()
