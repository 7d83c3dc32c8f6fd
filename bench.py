"""Headline workloads on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]`; one JSON line.

Each workload writes its whole result to a no-op sink. The value per workload
is the median of `$BENCH_RUNS` runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_features
from tidemark.operators import features as ft, linear as ln, ordered as o, outliers as ol, prepare as pr
from tidemark.plans import shipments as ps
from tidemark.series import Series
from tidemark.session import local_session, ship_package
from workloads import fixtures as fx, pipelines as wp
from workloads.fixtures import table
from workloads.series import categorical


def b1_gap_fill_lags(spark, sf):
    d = fx.hourly_user(spark, sf)
    s = Series.measure(d, ["user_id"], "h")
    d = pr.fill_gaps(d, s, "v", "1 hour", 0)
    return o.add_lags(calendar_features(d, "h"), s, ["v"], [1, 2, 3, 24])


def b2_one_hot_scale(spark, sf):
    d = categorical(spark, sf, "l_quantity", "l_extendedprice")
    d = ft.one_hot(d, ["flag", "p_brand", "p_type"], 0.039)
    return ft.scale(d, ["l_quantity", "l_extendedprice"])


def b3_ridge_cv(spark, sf):
    d = fx.segment_orders(spark, sf)
    options = [ln.candidate("ridge", round(0.1 * k, 1)) for k in range(1, 41)]
    s = ln.cross_validate(d, Series.of(["seg"], "d"), "total", ["n", "bal"], options)
    return ln.cv_score(s, ["seg"])


def b4_rolling_cv(spark, sf):
    s = ln.cross_validate(fx.daily_orders(spark, sf), Series.of((), "d"), "total", ["n", "customers"], [ln.candidate()],
                          "rolling", window=610, step=1, horizons=[1])
    return ln.cv_score(s)


def b5_isolation_forest(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # The local file is one row group, which Spark reads in one task.
    d = d.repartition(spark.sparkContext.defaultParallelism)
    return ol.remove_outliers(d, "isolationforest", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                              id_cols=["l_orderkey", "l_linenumber", "l_partkey"])


def b6_pipeline_search(spark, sf):
    return wp.experiment_trials(spark, sf, 20, threads=spark.sparkContext.defaultParallelism)


def b7_shipment_pipeline(spark, sf):
    return ps.shipment_arrivals(wp.shipment_tables(spark, sf), as_of="2001-06-01")


def b8_backward_fill(spark, sf):
    """One series without any value to the end: every row looks all the way."""
    d = table(spark, sf, "lineitem").select(F.lit(1).alias("k"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"),
                                            F.when(F.col("l_orderkey") < 0, F.col("l_quantity")).alias("v"))
    d = d.select("k", F.timestamp_seconds("n").alias("ts"), "v")
    return o.fill(d, Series.of(["k"], "ts"), ["v"], "bfill")


WORKLOADS = [b1_gap_fill_lags, b2_one_hot_scale, b3_ridge_cv, b4_rolling_cv, b5_isolation_forest, b6_pipeline_search, b7_shipment_pipeline,
             b8_backward_fill]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = set(sys.argv[1:])
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g", app="bench")
    spark.sparkContext.setLogLevel("OFF")
    ship_package(spark)
    seconds = {}
    for w in WORKLOADS:
        name = w.__name__
        if only and name.split("_")[0] not in only:
            continue
        taken = []
        # The search takes long; its stages are warm from the runs before.
        warm, timed = (0, 1) if w is b6_pipeline_search else (1, runs)
        for i in range(warm + timed):
            start = time.perf_counter()
            w(spark, sf).write.format("noop").mode("overwrite").save()
            if i >= warm:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf).replace("sf", "")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
