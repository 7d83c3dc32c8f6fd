"""Linear models against closed forms, folds, trees, autoregression, search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import arima, boost as bo, folds as fo, linear as ln, metrics as mt, models as md, search as se, statespace as ss
from tidemark.series import Series

DAY = Series.of(["k"], "d")


def frame(n=300, p=3, seed=0, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    parts = []
    for i, k in enumerate(keys):
        x = rng.normal(loc=1000 * (i + 1), scale=3, size=(n, p))
        y = x @ np.arange(1, p + 1) + 5 + rng.normal(size=n)
        parts.append(pd.DataFrame({"k": k, "d": pd.date_range("2020-01-01", periods=n), **{f"x{j}": x[:, j] for j in range(p)}, "y": y}))
    return pd.concat(parts, ignore_index=True)


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("d", F.to_date("d"))


def closed_form(x, y, alpha, intercept):
    if intercept:
        mx, my = x.mean(0), y.mean()
        w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
        return w, my - mx @ w
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y), 0.0


@pytest.mark.parametrize("jvm_terms", [10_000, 0])
@pytest.mark.parametrize("intercept", [True, False])
def test_ridge_matches_closed_form(spark, monkeypatch, jvm_terms, intercept):
    monkeypatch.setattr(ln, "JVM_TERMS", jvm_terms)
    pdf = frame()
    cols = ["x0", "x1", "x2"]
    options = [ln.candidate("ridge", a, fit_intercept=intercept) for a in (0.1, 2.0)] + [ln.candidate(fit_intercept=intercept)]
    got = ln.fit_linear(spark_frame(spark, pdf), ["k"], "y", cols, options).toPandas()
    for r in got.itertuples():
        part = pdf[pdf.k == r.k]
        w, b = closed_form(part[cols].to_numpy(), part["y"].to_numpy(), options[r.candidate]["alpha"], intercept)
        np.testing.assert_allclose(r.coef, w, rtol=1e-6)
        assert r.intercept == pytest.approx(b, abs=1e-4)
        assert r.n == 300


def test_absolute_penalty_satisfies_optimality():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    y = x @ [3, 0, -2, 0, 0, 1] + rng.normal(size=200)
    g, q = x.T @ x, x.T @ y
    alpha, l1 = np.array([0.5, 0.3, 5.0]), np.array([1.0, 0.4, 1.0])
    for w, a, r in zip(ln.solve_all(g, q, 200, alpha, l1), alpha, l1):
        slope = (q - g @ w) / 200 - a * (1 - r) * w
        on = w != 0
        np.testing.assert_allclose(slope[on], a * r * np.sign(w[on]), atol=1e-8)
        assert (np.abs(slope[~on]) <= a * r + 1e-8).all()


@pytest.mark.parametrize("unit", [1e5, 1e7])
def test_light_penalty_on_dependent_columns_satisfies_optimality(unit):
    # Full sets of indicators sum to a constant; against such a target the penalty is tiny.
    k = np.arange(200)
    x = np.column_stack([np.eye(5)[k % 5], np.eye(4)[(k // 30) % 4], np.ones(200)])
    y = unit * (k % 5 + np.sin(k))
    x, y = x - x.mean(0), y - y.mean()
    g, q = x.T @ x, x.T @ y
    alpha, l1 = np.array([1.0, 3.9, 0.1]), np.array([1.0, 1.0, 0.9])
    for w, a, r in zip(ln.solve_all(g, q, 200, alpha, l1), alpha, l1):
        slope = (q - g @ w) / 200 - a * (1 - r) * w
        on = w != 0
        np.testing.assert_allclose(slope[on], a * r * np.sign(w[on]), atol=1e-3 * a)
        assert (np.abs(slope[~on]) <= a * r + 1e-3 * a).all()


def test_singular_columns_still_predict(spark):
    pdf = frame(keys=("a",))
    pdf["x2"] = pdf["x0"] + pdf["x1"]
    d = spark_frame(spark, pdf)
    m = ln.fit_linear(d, ["k"], "y", ["x0", "x1", "x2"])
    got = ln.predict_linear(d, m, ["k"], ["x0", "x1", "x2"]).orderBy("d").toPandas()
    x = np.column_stack([pdf[["x0", "x1"]], np.ones(len(pdf))])
    want = x @ np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    np.testing.assert_allclose(got["predicted"], want, atol=1e-5)


def unit(train, other):
    lo, hi = train.min(0), train.max(0)
    return (other - lo) / (hi - lo)


@pytest.mark.parametrize("scaled", [True, False])
@pytest.mark.parametrize("metric", ["mse", "mape"])
@pytest.mark.parametrize("scheme", ["equal", "sliding", "kfold", "rolling", "rolling_sliding"])
def test_cross_validation_equals_refits(spark, scaled, metric, scheme):
    pdf = frame(n=100, p=2)
    n = 100
    if scheme in ("equal", "sliding"):
        cuts = [n - (5 - f) * (n // 6) for f in range(5)]
        want = [(list(range(max(0, c - 30) if scheme == "sliding" else 0, c)), list(range(c, c + n // 6))) for c in cuts]
        args = dict(scheme="equal", mode=fo.SLIDING if scheme == "sliding" else fo.EXPANDING, max_train=30)
    elif scheme == "kfold":
        want = [([i for i in range(n) if not f * 20 <= i < f * 20 + 20], list(range(f * 20, f * 20 + 20))) for f in range(5)]
        args = dict(scheme="kfold")
    else:
        slide = scheme == "rolling_sliding"
        want = [(list(range(c - 39 if slide else 0, c + 1)), [c + 1, c + 3]) for c in range(39, n, 15) if c + 3 <= n - 1]
        args = dict(scheme="rolling", window=40, step=15, horizons=[1, 3], mode=fo.SLIDING if slide else fo.EXPANDING)
    options = [ln.candidate("ridge", 0.7), ln.candidate("ridge", 3.0, fit_intercept=False)]
    got = ln.cross_validate(spark_frame(spark, pdf), DAY, "y", ["x0", "x1"], options, metric=metric, scaled=scaled, **args).toPandas()
    assert len(got) == 2 * 2 * len(want)
    for r in got.itertuples():
        part = pdf[pdf.k == r.k]
        x, y = part[["x0", "x1"]].to_numpy(), part["y"].to_numpy()
        train, test = want[r.fold]
        tx, ty, vx, vy = x[train], y[train], x[test], y[test]
        if scaled:
            tx, ty, vx, vy = unit(tx, tx), unit(ty, ty), unit(x[train], vx), unit(y[train], vy)
        w, b = closed_form(tx, ty, options[r.candidate]["alpha"], options[r.candidate]["fit_intercept"])
        e = vy - vx @ w - b
        score = np.mean(e**2) if metric == "mse" else np.mean(np.abs(e) / np.maximum(np.abs(vy), mt.MAPE_EPSILON))
        assert r.score == pytest.approx(score, rel=1e-5, abs=1e-9)


def test_rolling_folds_in_slices_equal_plain(spark):
    d = spark_frame(spark, frame(n=120, p=2))
    options = [ln.candidate("ridge", 0.7)]
    args = dict(scheme="rolling", window=30, step=1, horizons=[2], scaled=True)
    plain, sliced = [
        ln.cross_validate(d, Series.measure(d, ["k"], "d", rows=r), "y", ["x0", "x1"], options, **args).toPandas().sort_values(
            ["k", "fold"]).reset_index(drop=True) for r in (1_000, 25)]
    np.testing.assert_allclose(plain["score"], sliced["score"], rtol=1e-7)
    assert len(plain) == 2 * (120 - 30 - 1)


def test_folds_are_disjoint_and_ordered(spark):
    d = spark_frame(spark, frame(n=50, p=1))
    lengths = fo.series_length(d, DAY)
    assert fo.folds_equal(lengths, ["k"]).filter("train_hi > test_lo OR test_hi > 50 OR train_lo >= train_hi").count() == 0
    rows = fo.assign_folds(d, DAY, fo.folds_equal(lengths, ["k"])).groupBy("k", "fold", "rn").count()
    assert rows.filter("count > 1").count() == 0
    rolled = fo.folds_rolling(lengths, ["k"], 10, 5, [1, 2], fo.SLIDING)
    assert rolled.filter("train_hi - train_lo <> 10 OR train_hi - 1 + array_max(horizons) > 49").count() == 0
    assert fo.folds_rolling(lengths, ["k"], 10, 5, [1, 2], seq_len=6).agg(F.min("train_hi")).first()[0] == 4
    assert fo.folds_equal(fo.series_length(d.limit(4), DAY), ["k"]).count() == 0


@pytest.mark.parametrize("mode", [fo.EXPANDING, fo.SLIDING])
@pytest.mark.parametrize("window, step, horizons", [(None, None, None), (12, None, [1, 3]), (None, 4, None), (12, 8, [2])])
def test_rolling_folds_of_ragged_series(spark, mode, window, step, horizons):
    pdf = pd.concat([frame(n=n, p=2, seed=n, keys=(k,)) for n, k in ((60, "a"), (97, "b"), (5, "c"))])
    got = {(r.k, r.fold): r.score for r in ln.cross_validate(
        spark_frame(spark, pdf), DAY, "y", ["x0", "x1"], [ln.candidate("ridge", 1.0)], "rolling", mode=mode, window=window, step=step,
        horizons=horizons, scaled=True, target_units=True).collect()}
    want = {}
    for k, g in pdf.groupby("k"):
        n, x, y = len(g), g[["x0", "x1"]].to_numpy(), g.y.to_numpy()
        w, st = window or n // 6, step or n // 6
        hs = horizons or range(1, n // 6 + 1)
        if min(w, st) < 1 or not len(list(hs)):
            continue
        for fold, c in enumerate(range(w - 1, n - max(hs), st)):
            lo = c - w + 1 if mode == fo.SLIDING else 0
            a, b = x[lo:c + 1], y[lo:c + 1]
            span, top = np.ptp(a, axis=0), np.ptp(b)
            coef, base = closed_form((a - a.min(0)) / span, (b - b.min()) / top, 1.0, True)
            test = [c + h for h in hs]
            guess = ((x[test] - a.min(0)) / span @ coef + base) * top + b.min()
            want[k, fold] = ((y[test] - guess) ** 2).mean()
    assert got.keys() == want.keys() and len(want) > 5
    for key, v in want.items():
        assert got[key] == pytest.approx(v, rel=1e-6)


def test_metrics_and_empty_split(spark):
    d = spark.createDataFrame([("train", 0.0, 1.0), ("train", 2.0, 1.0), ("test", 4.0, 2.0)], "split string, actual double, predicted double")
    got = {r.split: r for r in mt.evaluate(d, {"mse": "mse", "mae": "mae", "wape": "wape", "mape": "mape"}).collect()}
    assert got["val"].rows == 0 and got["val"].mse is None
    assert got["train"].mse == 1 and got["train"].wape == 1 and got["test"].mape == 0.5
    assert got["train"].mape == pytest.approx((1 / mt.MAPE_EPSILON + 0.5) / 2)
    with pytest.raises(ValueError):
        mt.metric_of("r2")


def test_boosted_trees_beat_the_mean(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, size=(1500, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": np.sin(2 * x[:, 0]) + x[:, 1] ** 2, "split": ["train"] * 1000 + ["test"] * 500})
    d = spark.createDataFrame(pdf)
    m = md.fit_gbt(d, "y", ["a", "b"], {"max_depth": 4, "learning_rate": 0.5, "colsample_bytree": 1.0}, rounds=10)
    p = md.predict_gbt(m, d.filter("split = 'test'")).toPandas()
    assert ((p.y - p.predicted) ** 2).mean() < 0.2 * p.y.var()
    with pytest.raises(ValueError):
        md.fit_gbt(d, "y", ["a", "b"], {"nonsense": 1})


def plain_boost(x, y, s, use, rounds, seed_model):
    """Trees one row at a time of thought: exhaustive cuts, best leaf first."""
    pred = np.full(len(y), y[use].mean())
    score = lambda g, n: max(abs(g) - s["l1"], 0) ** 2 / (n + s["l2"]) if n + s["l2"] > 0 else 0.0
    for _ in range(rounds):
        g = pred - y

        def best(rows, depth):
            if depth == s["depth"]:
                return None
            top = None
            r = rows[use[rows]]
            for f in range(x.shape[1]):
                for cut in np.unique(x[r, f][~np.isnan(x[r, f])]):
                    for miss in (True, False):
                        left = np.where(np.isnan(x[r, f]), miss, x[r, f] <= cut)
                        nl, nr = left.sum(), (~left).sum()
                        if min(nl, nr) < max(1, s["least"]):
                            continue
                        gain = (score(g[r][left].sum(), nl) + score(g[r][~left].sum(), nr) - score(g[r].sum(), len(r))) / 2
                        if gain > 0 and gain >= s["gain"] and (top is None or gain > top[0] + 1e-9):
                            top = (gain, f, cut, miss)
            return top

        leaves = [(np.arange(len(y)), 0, best(np.arange(len(y)), 0))]
        while True:
            open_ = [k for k, leaf in enumerate(leaves) if leaf[2] is not None]
            if not open_ or (s["leaves"] and len(leaves) >= s["leaves"]):
                break
            k = max(open_, key=lambda k: leaves[k][2][0])
            rows, depth, (_, f, cut, miss) = leaves.pop(k)
            left = np.where(np.isnan(x[rows, f]), miss, x[rows, f] <= cut)
            for part in (rows[left], rows[~left]):
                leaves.append((part, depth + 1, best(part, depth + 1)))
        for rows, _, _ in leaves:
            r = rows[use[rows]]
            total = g[r].sum()
            pred[rows] -= s["rate"] * np.sign(total) * max(abs(total) - s["l1"], 0) / (len(r) + s["l2"])
    return pred


def test_many_boosted_models_equal_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(bo, "KEPT_TREES", 2)
    monkeypatch.setattr(bo, "BLOCK", 50)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (240, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 5) * 7 - x[:, 2] * x[:, 0] / 5 + rng.normal(size=240)
    x[rng.random((240, 3)) < 0.15] = np.nan
    fold = np.arange(240) % 3
    d = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t), int(f)) for r, t, f in zip(x, y, fold)],
                              "a double, b double, c double, y double, f int")
    params = [{"max_depth": 3, "min_child_weight": 5, "gamma": 1.0, "lambda_l2": 1.0},
              {"max_depth": 6, "num_leaves": 5, "min_data_in_leaf": 10, "lambda_l1": 2.0, "learning_rate": 0.1}]
    marks = F.array(*[F.when(F.col("f") == k, bo.TESTED).otherwise(bo.TRAINED).cast("tinyint") for k in range(2)])
    got, blocks = bo.fit_many(d, "y", ["a", "b", "c"], params, marks, 2, rounds=3)
    monkeypatch.setattr(bo, "CELLS", 5_000)  # two waves
    again, _ = bo.fit_many(d, "y", ["a", "b", "c"], params, marks, 2, rounds=3)
    bins = got.binned(x)
    for m, p in enumerate(params):
        for f in range(2):
            s = bo.settings(p, rounds=3)
            want = plain_boost(x, y, s, fold != f, 3, m)
            np.testing.assert_allclose(got.predictions(bins, 2 * m + f), want, rtol=1e-9)
            np.testing.assert_allclose(again.predictions(bins, 2 * m + f), want, rtol=1e-9)
    assert max((t.feature < 0).sum() for t in got.trees[2]) == 5
    held = bo.tested(got, blocks, 2).groupBy("model").agg(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)).alias("mse")).collect()
    assert len(held) == 4
    for r in held:
        test = fold == r.model % 2
        assert r.mse == pytest.approx(((y - got.predictions(bins, r.model)) ** 2)[test].mean())
    out = bo.predict(got, d, 3).toPandas()
    np.testing.assert_allclose(out.predicted, got.predictions(bins, 3))


@pytest.mark.parametrize("depth", [0, 1, 4, 6, 8])
def test_rows_reach_the_leaf_that_a_walk_reaches(depth, monkeypatch):
    rng = np.random.default_rng(depth)
    n, bins = 2 ** (depth + 1) - 1, rng.integers(0, 30, (500, 3)).astype(np.uint16)
    feature = np.where(np.arange(n) < n // 2, rng.integers(0, 3, n), -1)
    t = bo.Tree(feature, rng.integers(0, 28, n), rng.random(n) < 0.5, rng.normal(size=n), 2 * np.arange(n) + 1, 1 + np.arange(n))
    want = []
    for b in bins:
        k = 0
        while t.feature[k] >= 0:
            v = int(b[t.feature[k]]) - 1
            k = t.left[k] + (not (t.missing_left[k] if v < 0 else v <= t.cut[k]))
        want.append(k)
    assert t.nodes(bins).tolist() == want and t.nodes(bins[:0]).shape == (0,)
    # Trees of few leaves are looked up, not walked.
    assert ("masks" in vars(t)) == (depth <= 6)


def test_rows_are_not_written_again_after_the_last_tree(spark, monkeypatch):
    stages, write = [], bo.written
    monkeypatch.setattr(bo, "written", lambda d, name: stages.append(name) or write(d, name))
    monkeypatch.setattr(bo, "KEPT_TREES", 2)
    d = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    models, _ = bo.fit_many(d, "y", ["a"], [{"max_depth": 1}], rounds=4)
    assert len(models.trees[0]) == 4 and len(stages) == 2


def test_boosted_samples_rows_and_columns_by_tree(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame(pd.DataFrame({**{c: rng.normal(size=400) for c in "abcd"}, "y": rng.normal(size=400)}))
    m = bo.fit_many(d, "y", list("abcd"), [{"subsample": 0.5, "colsample_bytree": 0.25, "max_depth": 3, "max_bin": 4}], rounds=6)[0]
    used = [{int(f) for f in t.feature if f >= 0} for t in m.trees[0]]
    assert all(len(u) <= 1 for u in used) and len(set().union(*used)) > 1
    assert all(len({(int(f), int(c)) for f, c in zip(t.feature, t.cut) if f >= 0}) <= 3 for t in m.trees[0])
    empty = bo.fit_many(d.filter("y > 100"), "y", list("abcd"), [{}], rounds=2)[0]
    assert bo.predict(empty, d).filter("predicted <> 0").isEmpty()


def planted_arima(seed, n=1500, d=0):
    rng = np.random.default_rng(seed)
    e, u, x = rng.normal(size=n), np.zeros(n), rng.normal(size=n)
    for t in range(2, n):
        u[t] = 0.6 * u[t - 1] - 0.3 * u[t - 2] + e[t]
    v = u if d == 0 else u.cumsum()
    return pd.DataFrame({"k": f"s{seed}", "d": pd.date_range("2010-01-01", periods=n), "x": x, "y": 2 * x + 10 + v})


def test_arimax_recovers_planted_coefficients(spark):
    d = spark_frame(spark, pd.concat([planted_arima(1), planted_arima(2, d=1)]))
    m = {r.k: r for r in arima.fit_arimax(d, DAY, "y", ["x"], 2, 1, 1).collect()}
    for r in m.values():
        assert r.beta[0] == pytest.approx(2, abs=0.1)
    assert m["s2"].d == 1
    plain = arima.fit_arimax(d.filter("k = 's1'"), DAY, "y", ["x"], 2, 0, 0).first()
    np.testing.assert_allclose(plain.ar, [0.6, -0.3], atol=0.07)


def test_arimax_forecast_equals_recursion_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(arima, "FORECAST_BLOCK", 7)
    pdf = planted_arima(3)
    d = spark_frame(spark, pdf).withColumn("split", F.when(F.col("d") < "2013-06-01", "train").otherwise("test"))
    train, later = d.filter("split = 'train'"), d.filter("split = 'test'")
    m = arima.fit_arimax(train, DAY, "y", ["x"], 2, 0, 0)
    r = m.first()
    got = arima.forecast_arimax(m, later, DAY, ["x"]).orderBy("d").toPandas()
    u = list((pdf.y - r.beta[0] * pdf.x - r["mean"])[:train.count()])
    for _ in range(len(got)):
        u.append(sum(a * u[-1 - k] for k, a in enumerate(r.ar)))
    want = np.array(u[train.count():]) + r["mean"] + r.beta[0] * got.x
    np.testing.assert_allclose(got.predicted, want, atol=1e-9)
    fitted = arima.fitted_arimax(m, train, DAY, "y", ["x"]).filter("predicted IS NOT NULL").toPandas()
    assert ((fitted.y - fitted.predicted) ** 2).mean() == pytest.approx(1.0, abs=0.1)


def test_arimax_in_slices_equals_plain(spark):
    d = spark_frame(spark, planted_arima(4, n=400))
    plain, sliced = [arima.fit_arimax(d, Series.measure(d, ["k"], "d", rows=r), "y", ["x"], 1, 1, 1).first() for r in (1_000, 90)]
    assert (plain.p, plain.d, plain.q, plain.n) == (sliced.p, sliced.d, sliced.q, sliced.n)
    np.testing.assert_allclose([*plain.ar, *plain.ma, *plain.beta, plain.aic], [*sliced.ar, *sliced.ma, *sliced.beta, sliced.aic], rtol=1e-7)


def plain_filter(v, ar, d, ma, mean):
    """One-step expectations and the last state, one step at a time (None is a hole)."""
    f, c, g, at = ss.transition(ar, d, ma, mean)
    m, p = ss.before(ar, d, ma, mean, v[0])
    out = []
    for x in v:
        m, p = f @ m + c, f @ p @ f.T + np.outer(g, g)
        out.append(m[at])
        if x is not None:
            gain = p[:, at] / p[at, at]
            m, p = m + gain * (x - m[at]), p - np.outer(gain, p[at])
    return np.array(out), m


@pytest.mark.parametrize("steps,fan", [(1024, 1024), (7, 3)])
def test_scan_equals_the_plain_filter_over_holes(spark, monkeypatch, steps, fan):
    monkeypatch.setattr(ss, "SLICE_STEPS", steps)
    monkeypatch.setattr(ss, "FAN", fan)
    rng = np.random.default_rng(5)
    models = {"a": ([0.6], 0, [], 3.0), "b": ([0.5, -0.2], 1, [0.4], 0.1), "c": ([], 2, [0.3, 0.2], 0.0), None: ([], 0, [], 1.0)}
    rows, want = [], {}
    for k, (ar, d, ma, mean) in models.items():
        v = rng.normal(size=90)
        for _ in range(d):
            v = v.cumsum()
        v = [None if 0 < i < 89 and (rng.random() < 0.3 or 30 <= i < 55) else float(x) for i, x in enumerate(v + mean)]
        rows += [(k, i + 4, x) for i, x in enumerate(v) if x is not None]
        want[k] = plain_filter(v, ar, d, ma, mean)
    model = spark.createDataFrame([(k, len(ar), d, len(ma), ar, ma, mean) for k, (ar, d, ma, mean) in models.items()],
                                  "k string, p int, d int, q int, ar array<double>, ma array<double>, mean double")
    scan = ss.Scan(spark.createDataFrame(rows, "k string, g long, v double"), model, ["k"])
    for r in scan.last_states().collect():
        np.testing.assert_allclose(r.state, want[r.k][1], atol=1e-5)
    got = scan.one_step().collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.expected == pytest.approx(want[r.k][0][r.g - 4], abs=1e-5)


def test_arimax_origin_survives_dropped_rows(spark):
    d = spark_frame(spark, pd.DataFrame({"k": "a", "d": pd.date_range("2020-01-01", periods=110), "y": np.arange(110.0)}))
    d = d.withColumn("g", F.datediff("d", F.lit("2020-01-01").cast("date")))
    m = arima.fit_arimax(d.filter("g < 100"), DAY, "y", [], 1, 1, 0, step="g")
    whole = {r.g: r.predicted for r in arima.forecast_arimax(m, d.filter("g >= 100"), DAY, step="g").collect()}
    part = {r.g: r.predicted for r in arima.forecast_arimax(m, d.filter("g >= 107"), DAY, step="g").collect()}
    assert part == {g: whole[g] for g in (107, 108, 109)}
    assert whole[109] == pytest.approx(109, abs=0.2)


def test_kpss_is_the_textbook_statistic(spark):
    rng = np.random.default_rng(3)
    walk, noise = rng.normal(size=300).cumsum(), rng.normal(size=300)

    def plain(x):
        e, n = x - x.mean(), len(x)
        lag = int(3 * np.sqrt(n) / 13)
        lr = (e @ e + 2 * sum((1 - j / (lag + 1)) * (e[j:] @ e[:-j]) for j in range(1, lag + 1))) / n
        return (e.cumsum() ** 2).sum() / (n * n * lr)

    pdf = pd.concat([pd.DataFrame({"k": k, "d": pd.date_range("2020-01-01", periods=300), "v": v})
                     for k, v in (("walk", walk), ("noise", noise), ("flat", np.ones(300)))])
    d = spark_frame(spark, pdf)
    for s in (DAY, Series.measure(d, ["k"], "d", rows=70)):
        got = {r.k: r.kpss for r in arima.kpss(d, s, "v").collect()}
        assert got["walk"] == pytest.approx(plain(walk)) and got["noise"] == pytest.approx(plain(noise)) and got["flat"] is None
        order = {r.k: r.d for r in arima.difference_order(d, s, "v", 2).collect()}
        assert order == {"walk": 1, "noise": 0, "flat": 0}


def test_sample_space_ranges_and_determinism(spark):
    space = {**se.SEARCH_SPACES["elasticnet"], **se.SEARCH_SPACES["sarimax"], "lr": ("float", 0.01, 0.3, None)}
    a = se.sample_space(spark, space, 400, seed=1).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = se.sample_space(spark, space, 400, seed=1).repartition(5).orderBy("trial").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    pd.testing.assert_frame_equal(a, b)
    assert a.alpha.between(0.1, 4).all() and a.l1_ratio.between(0, 1).all() and set(a.max_p) == {2, 4, 6, 8, 10}
    assert np.allclose((a.alpha * 10).round(), a.alpha * 10) and a.lr.between(0.01, 0.3).all() and a.fit_intercept.nunique() == 2
    assert not a.equals(se.sample_space(spark, space, 400, seed=2).toPandas())


def test_grid_and_best_trial(spark):
    assert se.expand_grid({"a": [1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    t = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0), (3, None)], "trial long, score double")
    assert se.best_trial(t).first().trial == 1
    assert se.best_trial(t, direction="maximize").first().trial == 0
    assert se.best_trial(t.filter("score IS NULL")).count() == 0
