"""The whole experiment, on a small panel."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.functions.calendar import calendar_features
from tidemark.operators.ordered import add_lags
from tidemark.plans import experiment as ex
from tidemark.sources.store import Store


def load(spark):
    rng = np.random.default_rng(0)
    parts = []
    for k in ("a", "b"):
        d = pd.date_range("2023-01-01", periods=260)
        x = rng.normal(size=260)
        y = 10 + 3 * np.sin(np.arange(260) * 2 * np.pi / 7) + 2 * np.roll(x, 1) + rng.normal(scale=0.2, size=260)
        parts.append(pd.DataFrame({"k": k, "d": d, "x": x, "y": y}).drop(index=[50, 51, 120]))
    return spark.createDataFrame(pd.concat(parts)).withColumn("d", F.to_date("d"))


def hook(params, df, s):
    return add_lags(calendar_features(df, s.ts), s, ["y", "x"], [1, 7]).drop("x", "day", "week", "month")


def settings(**changes):
    base = dict(loader=load, target="y", keys=("k",), ts="d", every="1 day", target_gap_fill="ffill", make_features=hook,
                categorical=("dayofweek",), imputers=("ffill", "mean"), outlier_methods=(None, "zscore", "nonsense"), models=("ridge", "lasso"),
                inner_trials=4)
    return ex.Experiment(**{**base, **changes})


EXPERIMENT = settings(models=("ridge",), imputers=("mean",), outlier_methods=(None,))


def test_search_beats_the_mean_and_keeps_everything(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    trials, best = ex.search_pipelines(spark, settings(), store, 6)
    rows = trials.orderBy("trial").collect()
    assert [r.trial for r in rows] == list(range(6))
    assert all(r.score == r.val for r in rows) and all(r.outlier_method in (None, "zscore") for r in rows)
    top = min(rows, key=lambda r: (r.score, r.trial))
    assert best["model"][0] == top.model and best["performance"]["val"] == pytest.approx(top.val)
    spread = store.read("eda").agg(F.var_pop("y")).first()[0]
    assert top.val < 0.5 * spread
    pred = store.read("modeling", top.trial)
    assert {r.split for r in pred.select("split").distinct().collect()} == {"train", "val", "test"}
    assert store.read("landed_data").count() == 514 and store.read("eda").count() == 520
    assert store.read_results().count() == 1


@pytest.mark.parametrize("model, space", [
    ("xgb", {"max_depth": ("int", 2, 3, 1), "subsample": ("float", 0.5, 1.0, 0.1), "n_estimators": ("int", 8, 12, 1)}),
    ("sarimax", {"max_p": ("int", 1, 2, 1), "max_d": ("int", 0, 1, 1), "max_q": ("int", 0, 1, 1)})])
def test_other_models_run(spark, tmp_path, model, space):
    e = settings(models=(model,), imputers=("mean",), outlier_methods=(None,), model_spaces={model: space}, inner_trials=2, cv_folds=2, scored_on="test")
    trials, best = ex.search_pipelines(spark, e, Store(spark, str(tmp_path)), 1)
    r = trials.first()
    assert r.score == r.test and r.train_cv_score > 0 and None not in (r.train, r.val, r.test)
    assert set(best["model"][1][0]) == set(space)


def test_grid_search_tries_every_combination(spark, tmp_path):
    e = settings(models=("ridge",), imputers=("mean",), outlier_methods=(None,), inner_search="grid",
                 model_grids={"ridge": {"alpha": [0.1, 50.0], "fit_intercept": [True]}})
    assert ex._inner_candidates(spark, e, "ridge") == [{"alpha": 0.1, "fit_intercept": True}, {"alpha": 50.0, "fit_intercept": True}]
    _, best = ex.search_pipelines(spark, e, Store(spark, str(tmp_path)), 1)
    assert best["model"][1][0] == {"alpha": 0.1, "fit_intercept": True}
    with pytest.raises(ValueError):
        ex._inner_candidates(spark, settings(models=("lgbm",), inner_search="grid"), "lgbm")
    with pytest.raises(ValueError):
        settings(inner_search="bayes")


def test_marks_follow_the_folds(spark):
    d = spark.range(60).selectExpr("'a' AS k", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS d", "CAST(id AS DOUBLE) AS y")
    folds = ex.Folds.of(settings(cv_folds=2), d.union(d.limit(30).selectExpr("'b'", "d", "y")), ex.Series.of(["k"], "d"))
    try:
        rows = folds.marked().collect()
        for k, n in (("a", 60), ("b", 30)):
            t = n // 3
            mine = sorted((r.y, list(r["__marks"])) for r in rows if r.k == k)
            assert [m for _, m in mine] == [[2 if (f + 1) * t <= i < (f + 2) * t else int(i < (f + 1) * t) for f in range(2)] + [1] for i in range(n)]
    finally:
        folds.release()


def test_same_result_in_any_order_and_thread_count(spark, tmp_path):
    tables = [ex.search_pipelines(spark, settings(threads=t), Store(spark, str(tmp_path)), 4)[0].orderBy("trial").toPandas() for t in (1, 4)]
    pd.testing.assert_frame_equal(*tables, rtol=1e-9)


@pytest.mark.parametrize("changes, want", [
    ({"cv_folds": 2}, [(20, 20), (40, 20)]),
    ({"cv_folds": 2, "cv_mode": "sliding", "cv_window": 10}, [(10, 20), (10, 20)]),
    ({"cv_folds": 3, "cv_scheme": "kfold"}, [(40, 20), (40, 20), (40, 20)]),
    ({"cv_scheme": "rolling", "cv_window": 30, "cv_step": 15, "horizons": (1, 3)}, [(30, 2), (45, 2)])])
def test_folds_of_every_model_follow_the_settings(spark, changes, want):
    """Train rows and used test rows of each fold; no row is copied."""
    d = spark.range(60).selectExpr("'a' AS k", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS d", "CAST(id AS DOUBLE) AS y")
    folds = ex.Folds.of(settings(**changes), d.union(d.selectExpr("'b'", "d", "y")), ex.Series.of(["k"], "d"))
    try:
        got = []
        for f in range(folds.count):
            train, test = folds.parts(f)
            got.append((train.filter("k = 'a'").count(), test.filter("__used AND k = 'a'").count()))
            last = train.agg(F.max("y")).first()[0]
            if changes.get("cv_scheme") == "rolling":
                assert [r.y - last for r in test.filter("__used AND k = 'b'").orderBy("y").collect()] == [1, 3]
        assert got == want
    finally:
        folds.release()


def test_settings_are_checked():
    with pytest.raises(ValueError):
        settings(models=("prophet",))
    with pytest.raises(ValueError):
        settings(outlier_methods=("nonsense",))
    with pytest.raises(ValueError):
        settings(scored_on="future")
    assert settings(outlier_methods=("nonsense", None)).outlier_methods == (None,)


def test_command_line(spark, tmp_path, capsys):
    best = main(["tests.test_experiment:EXPERIMENT", "--store", str(tmp_path), "--trials", "1", "--name", "run"])
    assert best["model"][0] == "ridge" and "experiment run" in capsys.readouterr().out
