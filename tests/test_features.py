"""Imputation, encoding, scaling and outliers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import aggregate as ag, clean, features as ft, outliers as ol, prepare as pr
from tidemark.series import Series


def holes(seed=0, n=600):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    full = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(scale=0.1, size=n) + 50, "c": a - 1 + rng.normal(scale=0.1, size=n)})
    gaps = full.mask(pd.DataFrame(rng.random((n, 3)) < 0.2, columns=list("abc")))
    return full, gaps


def test_chained_imputer_invariants(spark):
    full, gaps = holes()
    d = spark.createDataFrame(gaps.assign(id=range(len(gaps)), split=["train"] * 500 + ["test"] * 100))
    d = d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abc"})
    got = pr.impute(d, "iterative", Series.of((), "id"), "a", ["a", "b", "c"]).orderBy("id").toPandas()
    values = got[["a", "b", "c"]].to_numpy()
    assert not np.isnan(values).any()
    seen = gaps.notna().to_numpy()
    np.testing.assert_array_equal(values[seen], gaps.to_numpy()[seen])
    partly = ~seen & seen.any(axis=1)[:, None]
    mean = np.broadcast_to(np.nanmean(gaps.to_numpy()[:500], axis=0), values.shape)
    error = lambda guess: np.sqrt(((guess - full.to_numpy())[partly] ** 2).mean())
    assert error(values) < 0.35 * error(mean)


def plain_chain(x, rounds, alpha, tol):
    """Row by row what the imputer does with moments: (filled rows, rounds used)."""
    means, holes = np.nanmean(x, axis=0), np.isnan(x)
    v = np.where(holes, 0.0, x - means)
    for r in range(rounds):
        before = v.copy()
        for j in np.argsort(holes.sum(0), kind="stable"):
            if not holes[:, j].any():
                continue
            rest, own = [k for k in range(x.shape[1]) if k != j], ~holes[:, j]
            a, b = v[own][:, rest], v[own, j]
            ca, cb = a - a.mean(0), b - b.mean()
            w = np.linalg.solve(ca.T @ ca + alpha * np.eye(len(rest)), ca.T @ cb)
            v[holes[:, j], j] = v[holes[:, j]][:, rest] @ w + b.mean() - a.mean(0) @ w
        if np.abs(v - before).max() < tol * np.nanmax(np.abs(x)):
            return v + means, r + 1
    return v + means, rounds


@pytest.mark.parametrize("held", [20_000, 0])
def test_chained_imputer_equals_plain_rounds(spark, monkeypatch, held):
    monkeypatch.setattr(pr, "DRIVER_PATTERNS", held)
    _, gaps = holes()
    d = spark.createDataFrame(gaps.assign(id=range(len(gaps)), split="train")).repartition(4)
    d = d.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abc"})
    fitted = pr.ChainedImputer.fit(d, ["a", "b", "c"], 4 if held else 2, tol=0.0)
    assert len(fitted.steps) == (12 if held else 6)
    got = fitted.transform(d).orderBy("id").toPandas()[["a", "b", "c"]].to_numpy()
    np.testing.assert_allclose(got, plain_chain(gaps.to_numpy(), len(fitted.steps) // 3, 1e-3, 0.0)[0], rtol=1e-8)
    # The bound on what moved never ends the rounds early.
    some = pr.ChainedImputer.fit(d, ["a", "b", "c"], 6, tol=1e-2)
    assert len(some.steps) // 3 >= plain_chain(gaps.to_numpy(), 6, 1e-3, 1e-2)[1]


def test_imputers_by_name_and_estimator(spark):
    d = spark.createDataFrame([("train", 1.0), ("train", None), ("train", 3.0), ("test", None)], "split string, v double")
    assert [r.v for r in pr.impute(d, "mean", Series.of((), "v"), "v", ["v"]).collect()] == [1, 2, 3, 2]
    out = pr.impute(d, Imputer(inputCols=["v"], outputCols=["w"]), Series.of((), "v"), "v")
    assert [r.w for r in out.collect()] == [1, 2, 3, 2]
    with pytest.raises(ValueError):
        pr.impute(d, "nearest", Series.of((), "v"), "v")


def test_many_rare_values_stay_a_table_whatever_the_limit(spark):
    n = ft.MOST_LISTED + 1
    d = spark.range(2 * n).select(F.when(F.col("id") < n, F.concat(F.lit("r"), F.col("id"))).when(F.col("id") > n, "hot").alias("c"))
    enc = ft.OneHot.fit(d, ["c"], 0.01, max_listed=10**9)
    assert isinstance(enc.rare["c"], DataFrame) and enc.names() == ["c_hot", "c_infrequent_val"]
    assert tuple(enc.transform(d).agg(F.sum("c_hot"), F.sum("c_infrequent_val"), F.count(F.lit(1))).first()) == (n - 1, n + 1, 2 * n)


def test_one_hot_rules(spark):
    rows = [("train", "x")] * 6 + [("train", "y")] * 3 + [("train", "z")] + [("train", None)] * 5 + [("test", v) for v in ("x", "z", "new", None)]
    d = spark.createDataFrame(rows, "split string, c string")
    out = ft.one_hot(d, ["c"], 0.1).filter("split = 'test'").drop("split").collect()
    assert out[0].asDict().keys() == {"c_x", "c_y", "c_None", "c_infrequent_val"}
    assert [tuple(r) for r in out] == [(1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 1, 0)]
    # The path for more rare values than can be listed gives the same table.
    wide = ft.OneHot.fit(d, ["c"], 0.1, max_listed=0).transform(d).filter("split = 'test'").drop("split")
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, out))
    assert ft.OneHot.fit(d, ["c"], 5).names() == ["c_x", "c_None", "c_infrequent_val"]
    assert ft.one_hot(d.drop("c"), []).columns == ["split"]
    with pytest.raises(ValueError):
        ft.OneHot.fit(d, ["c"], None, max_columns=2)


def test_encodable_columns_are_sorted(spark):
    d = spark.createDataFrame([("a", 1, "b", "train")], "z string, n int, a string, split string")
    assert ft.encodable(d, ["n", "gone"]) == ["a", "n", "z"]


def test_min_max_and_constant_column(spark):
    d = spark.createDataFrame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("test", 5.0, 7.0)], "split string, v double, c double")
    assert [tuple(r) for r in ft.scale(d, ["v", "c"]).select("v", "c").collect()] == [(0, 0), (1, 0), (2, 2)]
    by = ft.scale_by_series(d.withColumn("k", F.lit("a")), Series.of(["k"], "v"), ["v"])
    assert [r.v for r in by.collect()] == [0, 1, 2]


def test_quantile_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 20_000, p=[0.9, 0.1]), "v": np.round(rng.lognormal(size=20_000), 2)})
    d = spark.createDataFrame(pdf)
    probs = (0.0, 0.25, 0.5, 0.991, 1.0)
    for rows in (10**6, 10):
        got = {r.k: r.q for r in ol.exact_quantiles(d, ["k"], "v", probs, group_rows=rows, accuracy=200).collect()}
        for k in "ab":
            np.testing.assert_allclose(got[k], pdf[pdf.k == k].v.quantile(list(probs)))


def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2_000, 3))
    x[::100] += 12
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(2_000), split="train"))


def test_forest_finds_planted_rows_and_is_stable(spark):
    d = planted(spark)
    flag = lambda x: {r.id for r in ol.flag_outliers(x, "isolationforest", list("abc"), id_cols=["id"], seed=3).filter("is_outlier").collect()}
    first = flag(d)
    assert set(range(0, 2_000, 100)) <= first and len(first) < 400
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert flag(d.repartition(5)) == first
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_forest_scores_match_a_slow_walk(spark):
    d = planted(spark)
    forest = ol.IsolationForest.fit(d, list("abc"), ["id"], trees=5, sample=64)
    got = d.withColumn("s", forest.score()).orderBy("id").limit(200).toPandas()
    for r in got.itertuples():
        depth = 0.0
        for t in forest.trees:
            node = 0
            while node < len(t["feature"]):
                node = 2 * node + 1 + (r[1 + t["feature"][node]] > t["cut"][node])
            depth += t["path"][node - len(t["feature"])]
        assert r.s == pytest.approx(2 ** (-depth / 5 / float(ol.average_path(64))))


def test_removal_guard(spark):
    d = planted(spark)
    assert ol.remove_outliers(d, "boxplot", list("abc")).count() < 2_000
    assert ol.remove_outliers(d, "boxplot", list("abc"), seq_len=3_000).count() == 2_000
    assert ol.remove_outliers(d, None, list("abc")) is d
    later = d.withColumn("split", F.when(F.col("id") < 1_000, "train").otherwise("test"))
    kept = ol.remove_outliers(later, "zscore", list("abc"))
    assert kept.filter("split = 'test'").count() == 1_000 and kept.filter("split = 'train'").count() == 990
    half = d.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a") + 100).otherwise(F.col("a")))
    assert ol.remove_outliers(half, "isolationforest", ["a"], id_cols=["id"], sample=16).count() in (2_000, half.count())
    with pytest.raises(ValueError):
        ol.flag_outliers(d, "svmoneclass", ["a"])


def test_map_values_and_events(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    look = spark.createDataFrame([("a", 1), ("a", 1), ("z", 2)], "s string, t int")
    assert [r.c for r in clean.map_values(d, "c", look, "s", "t").collect()] == [1, None, None]
    with pytest.raises(ValueError):
        clean.map_values(d, "c", look.unionAll(spark.createDataFrame([("a", 9)], "s string, t int")), "s", "t")
    with pytest.raises(ValueError):
        ag.units_by_event_date(d, "WarehouseId", "departure", {"arrival": {"WarehouseId": "x"}}, "q")


def test_all_null_column_profile(spark):
    d = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a string, b double")
    assert {r.column: (r.missing, r.high) for r in ag.missing_profile(d).collect()} == {"a": (1.0, True), "b": (0.5, True)}
