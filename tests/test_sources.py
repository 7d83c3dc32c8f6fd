"""Store, CSV, SQL cache, nested columns, distributions, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal, distributions as ds, nested as ne
from tidemark.operators import clean
from tidemark.sources.csv import read_csv_series
from tidemark.sources.sql import clear_cache, run_query
from tidemark.sources.store import Store, land


def test_store_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    d = spark.createDataFrame([("train", 1.0), ("val", float("nan"))], "split string, v double")
    out = land(spark, lambda s: d, store)
    assert {(r.split, r.v) for r in out.collect()} == {("train", 1.0), ("val", None)}
    store.write(d.limit(1), "stage", trial=1), store.write(d, "stage", trial=2)
    assert store.read("stage", 1).count() == 1 and store.read("stage", 2, "val").count() == 1
    for v in (0.123456, None):
        store.write_result({"best_params": {"alpha": 0.123456, "n": 3}, "train": v}, "x" * 150)
    got = store.read_results().orderBy(F.col("metrics.train").desc_nulls_last()).collect()
    assert [len(r.name) for r in got] == [100, 100] and got[0].params == {"alpha": "0.1235", "n": "3"} and got[1].metrics["train"] is None
    assert Store(spark, "x").experiment != Store(spark, "x").experiment


def test_csv_strict_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,Close\n2024-01-02 00:00:00,1.5,9\n2024-01-02T00:00:00,2,9\n2024-01-03 23:00:00-05:00,x,9\n")
    plain = read_csv_series(spark, str(tmp_path / "a.csv"), name="stock").collect()
    assert [(str(r.date), r.stock) for r in plain] == [("2024-01-02", 1.5), ("None", 2.0), ("None", None)]
    both = read_csv_series(spark, str(tmp_path / "a.csv"), offset_fmt="yyyy-MM-dd HH:mm:ssXXX").collect()
    assert str(both[2].date) == "2024-01-04"


def test_query_cache_is_shared(spark):
    clear_cache()
    a = run_query(spark, "SELECT '2024-01-02' AS d, 'bad' AS e", parse_dates=["d", "e"])
    assert run_query(spark, "SELECT '2024-01-02' AS d, 'bad' AS e", parse_dates=["e", "d"]) is a
    assert run_query(spark, "SELECT '2024-01-02' AS d, 'bad' AS e") is not a
    r = a.first()
    assert str(r.d) == "2024-01-02 00:00:00" and r.e is None
    clear_cache()


def test_deep_sum_rules(spark):
    d = spark.sql("""SELECT named_struct('a', 1, 'b', array(2.5D, NULL, double('NaN')), 'c', map('x', array(3), 'skip', array(100)), 't', 'text') AS o""")
    r = ne.deep_sum_count(d, "o", "s", ["skip"]).first()
    assert (r.s_sum, r.s_count) == (6.5, 3)
    assert np.isnan(ne.deep_sum(d, "o", "s", ["skip"], ignore_na=False).first().s)
    leaves = {r.path: r.value for r in ne.numeric_leaves(d, "o", exclude=["skip"]).collect()}
    assert leaves.keys() == {"o.a", "o.b[0]", "o.b[2]", "o.c.x[0]"} and leaves["o.b[0]"] == 2.5
    with pytest.raises(ValueError):
        ne.numeric_leaves(d.select(F.col("o.t").alias("o")), "o")


def test_flatten(spark):
    d = spark.sql("SELECT array(array(array(1, 2), NULL), NULL, array(array(3))) AS l, map('a', map('b', 1), 'c', map('d', 2)) AS m")
    assert ne.flatten_lists(d, "l").first().l == [1, 2, 3]
    assert {tuple(r) for r in ne.flatten_map(d.select("m"), "m", ["x", "y"], "v").collect()} == {("a", "b", 1), ("c", "d", 2)}


def test_divergences(spark):
    d = spark.createDataFrame([(0, 0.5, 0.5), (0, 0.5, 0.5), (1, 1.0, 0.0), (1, 0.0, 1.0), (2, 0.75, 0.5), (2, 0.25, 0.5)], "k int, a double, p double")
    js = {r.k: r.jsd for r in ds.js_divergence(d, ["k"], "a", "p").collect()}
    back = {r.k: r.jsd for r in ds.js_divergence(d, ["k"], "p", "a").collect()}
    assert js[0] == 0 and js[1] == pytest.approx(1) and 0 < js[2] < 1 and js[2] == pytest.approx(back[2])
    kl = {r.k: r.kl for r in ds.kl_divergence(d, ["k"], "a", "p").collect()}
    assert kl[0] == 0 and kl[1] == float("inf")


def test_probabilities_sum_to_one(spark):
    d = spark.createDataFrame([(0, 4.0, 3.0), (1, 0.5, 2.0), (2, 3.0, 1.0), (3, 2.0, 0.0)], "k int, mean double, std double")
    nb = {r.k: (r.s, r.lo) for r in ds.nb_probabilities(d, ["k"], 3).groupBy("k").agg(F.sum("prob").alias("s"), F.min("support").alias("lo")).collect()}
    assert nb.keys() == {0, 1} and all(s == pytest.approx(1) and lo == 0 for s, lo in nb.values())
    norm = {r.k: r.s for r in ds.norm_probabilities(d, ["k"], 2).groupBy("k").agg(F.sum("prob").alias("s")).collect()}
    assert norm.keys() == {0, 1, 2} and all(s == pytest.approx(1) for s in norm.values())
    assert ds.nb_params(d).filter("nb_p IS NULL").count() == 2


def test_variance_equal_to_the_mean_is_no_overdispersion(spark):
    # Their deviation, rounded and squared, is above 2.5; both moments are 2.5.
    even = [3, 5, 1, 2, 2, 1, 7, 1, 1, 4, 2, 2, 1, 1, 2, 4, 5, 4, 1, 3, 4, 2, 2, 2, 2, 1]
    rows = [("even", n) for n in even] + [("back", n) for n in even[::-1]] + [("over", n) for n in [*even, 8]] + [("one", 3)]
    rows += [("large", n * 10**15 + 1) for n in (1, 2, 4)]
    m = ds.count_moments(spark.createDataFrame(rows, "k string, n long").repartition(5), ["k"], "n")
    got = {r.k: r for r in ds.nb_params(m, var="var").collect()}
    assert (got["even"].mean, got["even"].var) == (got["back"].mean, got["back"].var) == (2.5, 2.5)
    assert {k for k, r in got.items() if r.nb_p is None} == {"even", "back", "one"} and got["one"].std is None
    assert got["large"].var == pytest.approx(7e30 / 3, rel=1e-15)
    p = ds.nb_probabilities(m.filter("k <> 'large'"), ["k"], 3, var="var")
    assert {r.k for r in p.select("k").distinct().collect()} == {"over"}


def test_row_wise_operators_on_a_stream(spark, tmp_path):
    spark.range(20).select(F.expr("date_add(DATE'2024-01-01', int(id))").alias("date"), F.col("id").alias("q")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("date date, q long").parquet(str(tmp_path / "in"))
    out = cal.calendar_features(clean.day_group(clean.keep(stream, "q"), "date"), "date")
    job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 19 and got.filter("day NOT BETWEEN 1 AND 20").count() == 0
