"""Queries of folds, linear models, metrics, cross-validation and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import arima, boost as bo, features as ft, folds as fo, linear as ln, metrics as mt, models as md, prepare as pr, search as se
from tidemark.operators.ordered import add_lags, number_rows
from tidemark.series import Series
from workloads import fixtures as fx
from workloads.fixtures import ctes, table
from workloads.registry import flat, query

SEG_DAY = Series.of(["seg"], "d")
DAY = Series.of((), "d")
SEG = ctes("segment_orders")
LEN = ", z AS (SELECT seg, count(*) AS len FROM segment_orders GROUP BY 1)"
NUM = ", x AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY seg) AS len FROM segment_orders)"
# Equal folds as SQL: fold 0..4, first test row, block length.
EQUAL = ", f AS (SELECT seg, len, fold, len - (5 - fold) * (len // 6) AS lo, len // 6 AS t FROM (SELECT DISTINCT seg, len FROM x), (SELECT unnest(range(5)) AS fold))"


@query("k1_equal_folds", SEG + LEN + """
SELECT seg, fold, CAST(0 AS BIGINT) AS train_lo, len - (5 - fold) * (len // 6) AS train_hi, len - (5 - fold) * (len // 6) AS test_lo,
       len - (4 - fold) * (len // 6) AS test_hi FROM z, (SELECT unnest(range(5)) AS fold)""")
def k1(spark, sf):
    return flat(fo.folds_equal(fo.series_length(fx.segment_orders(spark, sf), SEG_DAY), ["seg"]))


@query("k1_equal_folds_sliding", SEG + LEN + """
SELECT seg, fold, greatest(0, len - (5 - fold) * (len // 6) - 200) AS train_lo, len - (5 - fold) * (len // 6) AS train_hi,
       len - (5 - fold) * (len // 6) AS test_lo, len - (4 - fold) * (len // 6) AS test_hi FROM z, (SELECT unnest(range(5)) AS fold)""")
def k1s(spark, sf):
    return flat(fo.folds_equal(fo.series_length(fx.segment_orders(spark, sf), SEG_DAY), ["seg"], max_train=200))


@query("k2_rolling_folds", SEG + LEN + """
SELECT seg, (c - 189) // 1 AS fold, c - 189 AS train_lo, c + 1 AS train_hi, h AS horizon FROM (SELECT seg, len, unnest(generate_series(189, len - 3)) AS c FROM z WHERE len >= 192), (SELECT unnest([1, 2]) AS h)""")
def k2(spark, sf):
    lengths = fo.series_length(fx.segment_orders(spark, sf), SEG_DAY)
    d = fo.folds_rolling(lengths, ["seg"], 190, 1, [1, 2], fo.SLIDING)
    return flat(d.select("seg", "fold", "train_lo", "train_hi", F.explode("horizons").alias("horizon")))


@query("k2_rolling_folds_default", SEG + LEN + """
, w AS (SELECT seg, len, len // 6 AS w FROM z)
SELECT seg, (c - (w - 1)) // w AS fold, 0::BIGINT AS train_lo, c + 1 AS train_hi, w AS reach
FROM (SELECT seg, len, w, unnest(generate_series(w - 1, len - 1 - w, w)) AS c FROM w)""")
def k2d(spark, sf):
    d = fo.folds_rolling(fo.series_length(fx.segment_orders(spark, sf), SEG_DAY), ["seg"])
    return flat(d.select("seg", "fold", "train_lo", "train_hi", F.size("horizons").alias("reach")))


@query("c10_fold_membership", SEG + NUM + EQUAL + """
SELECT x.seg, CAST(d AS VARCHAR) AS d, fold, CASE WHEN i < lo THEN 'train' ELSE 'test' END AS role FROM x JOIN f ON x.seg = f.seg AND i < lo + t""")
def c10(spark, sf):
    d = fx.segment_orders(spark, sf)
    return flat(fo.assign_folds(d, SEG_DAY, fo.folds_equal(fo.series_length(d, SEG_DAY), ["seg"])).select("seg", "d", "fold", "role"))


@query("k3_least_squares", SEG + """
SELECT seg, round(regr_slope(total, n), 6) AS slope, round(regr_intercept(total, n), 6) AS intercept, count(*) AS n FROM segment_orders GROUP BY 1""")
def k3(spark, sf):
    m = ln.fit_linear(fx.segment_orders(spark, sf), ["seg"], "total", ["n"])
    return flat(m.select("seg", F.col("coef")[0].alias("slope"), "intercept", "n"))


@query("k3_two_features", SEG + """
, s AS (SELECT seg, var_pop(n) AS a, var_pop(bal) AS b, covar_pop(n, bal) AS c, covar_pop(n, total) AS u, covar_pop(bal, total) AS v,
        avg(n) AS mn, avg(bal) AS mb, avg(total) AS mt FROM segment_orders GROUP BY 1)
SELECT seg, round((b * u - c * v) / (a * b - c * c), 6) AS w_n, round((a * v - c * u) / (a * b - c * c), 6) AS w_bal,
       round(mt - mn * (b * u - c * v) / (a * b - c * c) - mb * (a * v - c * u) / (a * b - c * c), 6) AS intercept FROM s""")
def k3t(spark, sf):
    m = ln.fit_linear(fx.segment_orders(spark, sf), ["seg"], "total", ["n", "bal"])
    return flat(m.select("seg", F.col("coef")[0].alias("w_n"), F.col("coef")[1].alias("w_bal"), "intercept"))


_GRID = "(SELECT unnest([0.1, 0.5, 0.8, 1.0, 2.0]) AS alpha)"
_S = ", s AS (SELECT seg, count(*) AS len, covar_pop(n, total) * count(*) AS xy, var_pop(n) * count(*) AS xx, avg(n) AS mx, avg(total) AS my FROM segment_orders GROUP BY 1)"


def _grid_fit(spark, sf, kind, **extra):
    grid = se.expand_grid({"alpha": [0.1, 0.5, 0.8, 1.0, 2.0]})
    m = ln.fit_linear(fx.segment_orders(spark, sf), ["seg"], "total", ["n"], [ln.candidate(kind, **g, **extra) for g in grid])
    alphas = F.array(*[F.lit(g["alpha"]) for g in grid])
    return flat(m.select("seg", F.get(alphas, F.col("candidate")).alias("alpha"), F.col("coef")[0].alias("slope"), "intercept"))


@query("k3_ridge", SEG + _S + f" SELECT seg, CAST(alpha AS DOUBLE) AS alpha, round(xy / (xx + alpha), 6) AS slope, round(my - mx * xy / (xx + alpha), 6) AS intercept FROM s, {_GRID}")
def k3r(spark, sf):
    return _grid_fit(spark, sf, "ridge")


@query("k3_lasso", SEG + _S + f"""
, w AS (SELECT *, sign(xy) * greatest(abs(xy / len) - alpha, 0) / (xx / len) AS w FROM s, {_GRID})
SELECT seg, CAST(alpha AS DOUBLE) AS alpha, round(w + 0.0, 6) AS slope, round(my - mx * w, 6) AS intercept FROM w""")
def k3l(spark, sf):
    return _grid_fit(spark, sf, "lasso")


@query("k3_elastic_net", SEG + _S + f"""
, w AS (SELECT *, sign(xy) * greatest(abs(xy / len) - alpha * 0.25, 0) / (xx / len + alpha * 0.75) AS w FROM s, {_GRID})
SELECT seg, CAST(alpha AS DOUBLE) AS alpha, round(w + 0.0, 6) AS slope, round(my - mx * w, 6) AS intercept FROM w""")
def k3e(spark, sf):
    return _grid_fit(spark, sf, "elasticnet", l1_ratio=0.25)


@query("k3_no_intercept", SEG + " SELECT seg, round(sum(n * total) / sum(n * n), 6) AS slope, 0.0::DOUBLE AS intercept FROM segment_orders GROUP BY 1")
def k3n(spark, sf):
    m = ln.fit_linear(fx.segment_orders(spark, sf), ["seg"], "total", ["n"], [ln.candidate(fit_intercept=False)])
    return flat(m.select("seg", F.col("coef")[0].alias("slope"), "intercept"))


@query("j4_fold_scaling", SEG + NUM + EQUAL + """
, r AS (SELECT f.seg, fold, lo, t, min(n) AS nl, max(n) - min(n) AS nr, min(total) AS tl, max(total) - min(total) AS tr FROM f JOIN x ON x.seg = f.seg AND i < lo GROUP BY 1, 2, 3, 4),
u AS (SELECT r.seg, fold, lo, t, i, (n - nl) / nr AS a, (total - tl) / tr AS y FROM r JOIN x ON x.seg = r.seg AND i < lo + t),
c AS (SELECT seg, fold, covar_pop(a, y) * count(*) AS xy, var_pop(a) * count(*) AS xx, avg(a) AS ma, avg(y) AS my FROM u WHERE i < lo GROUP BY 1, 2)
SELECT u.seg, u.fold, round(avg(pow(y - (my + (a - ma) * xy / (xx + 0.5)), 2)), 6) AS score FROM u JOIN c ON u.seg = c.seg AND u.fold = c.fold WHERE i >= lo GROUP BY 1, 2""")
def j4(spark, sf):
    s = ln.cross_validate(fx.segment_orders(spark, sf), SEG_DAY, "total", ["n"], [ln.candidate("ridge", 0.5)], scaled=True)
    return flat(s.select("seg", "fold", "score"))


_FOLD_FIT = """, c AS (SELECT f.seg, fold, regr_slope(total, n) AS w, regr_intercept(total, n) AS b FROM f JOIN x ON x.seg = f.seg AND i < lo GROUP BY 1, 2),
e AS (SELECT f.seg, f.fold, total AS y, b + w * n AS p FROM f JOIN x ON x.seg = f.seg AND i >= lo AND i < lo + t JOIN c ON c.seg = f.seg AND c.fold = f.fold)"""


@query("k9_cv_score", SEG + NUM + EQUAL + _FOLD_FIT + """
SELECT seg, round(avg(s), 6) AS cv_score, count(*) AS folds FROM (SELECT seg, fold, avg(pow(y - p, 2)) AS s FROM e GROUP BY 1, 2) GROUP BY 1""")
def k9(spark, sf):
    s = ln.cross_validate(fx.segment_orders(spark, sf), SEG_DAY, "total", ["n"], [ln.candidate()])
    return flat(ln.cv_score(s, ["seg"]).drop("candidate"))


@query("k9_cv_score_mae", SEG + NUM + EQUAL + _FOLD_FIT + """
SELECT seg, fold, round(avg(abs(y - p)), 6) AS score FROM e GROUP BY 1, 2""")
def k9m(spark, sf):
    s = ln.cross_validate(fx.segment_orders(spark, sf), SEG_DAY, "total", ["n"], [ln.candidate()], metric="neg_mean_absolute_error")
    return flat(s.drop("candidate"))


@query("k9_rolling_origin", ctes("daily_orders") + """
, x AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS len FROM daily_orders),
c AS (SELECT i AS c, regr_slope(total, n) OVER w AS w, regr_intercept(total, n) OVER w AS b FROM x WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c - 609 AS fold, round(pow(total - (b + w * n), 2), 6) AS score FROM c JOIN x ON i = c + 1 WHERE c >= 609""")
def k9r(spark, sf):
    s = ln.cross_validate(fx.daily_orders(spark, sf), DAY, "total", ["n"], [ln.candidate()], "rolling", window=610, step=1, horizons=[1])
    return flat(s.select("fold", "score"))


@query("k9_rolling_origin_sliding", ctes("daily_orders") + """
, x AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS len FROM daily_orders),
c AS (SELECT i AS c, len, regr_slope(total, n) OVER w AS w, regr_intercept(total, n) OVER w AS b FROM x WINDOW w AS (ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
SELECT (c - 199) // 50 AS fold, round(avg(abs(total - (b + w * n))), 6) AS score FROM c JOIN x ON i IN (c + 1, c + 3)
WHERE c >= 199 AND (c - 199) % 50 = 0 AND c + 3 <= c.len - 1 GROUP BY 1""")
def k9s(spark, sf):
    s = ln.cross_validate(fx.daily_orders(spark, sf), DAY, "total", ["n"], [ln.candidate()], "rolling", mode=fo.SLIDING, window=200,
                          step=50, horizons=[1, 3], metric="mae")
    return flat(s.select("fold", "score"))


_KFOLD = """, f AS (SELECT seg, len, fold, fold * (len // 5) + least(fold, len % 5) AS lo,
       (fold + 1) * (len // 5) + least(fold + 1, len % 5) AS hi FROM (SELECT DISTINCT seg, len FROM x), (SELECT unnest(range(5)) AS fold))"""


@query("k10_plain_folds", SEG + NUM + _KFOLD + " SELECT seg, fold, lo AS test_lo, hi AS test_hi FROM f")
def k10(spark, sf):
    return flat(fo.folds_plain(fo.series_length(fx.segment_orders(spark, sf), SEG_DAY), ["seg"]))


@query("k10_kfold_scores", SEG + NUM + _KFOLD + """
, c AS (SELECT f.seg, fold, regr_slope(total, n) AS w, regr_intercept(total, n) AS b FROM f JOIN x ON x.seg = f.seg AND NOT (i >= lo AND i < hi) GROUP BY 1, 2)
SELECT f.seg, f.fold, round(avg(pow(total - (b + w * n), 2)), 6) AS score FROM f JOIN x ON x.seg = f.seg AND i >= lo AND i < hi
JOIN c ON c.seg = f.seg AND c.fold = f.fold GROUP BY 1, 2""")
def k10s(spark, sf):
    return flat(ln.cross_validate(fx.segment_orders(spark, sf), SEG_DAY, "total", ["n"], [ln.candidate()], "kfold").drop("candidate"))


@query("k11_grid_search", SEG + NUM + EQUAL + """
, g AS (SELECT row_number() OVER () - 1 AS candidate, alpha FROM (SELECT unnest([0.1, 0.5, 0.8, 1.0, 2.0]) AS alpha)),
c AS (SELECT f.seg, fold, covar_pop(n, total) * count(*) AS xy, var_pop(n) * count(*) AS xx, avg(n) AS mx, avg(total) AS my FROM f JOIN x ON x.seg = f.seg AND i < lo GROUP BY 1, 2),
e AS (SELECT f.seg, f.fold, candidate, alpha, avg(pow(total - (my + (n - mx) * xy / (xx + alpha)), 2)) AS s FROM f JOIN x ON x.seg = f.seg AND i >= lo AND i < lo + t
      JOIN c ON c.seg = f.seg AND c.fold = f.fold, g GROUP BY 1, 2, 3, 4)
SELECT seg, candidate, CAST(alpha AS DOUBLE) AS alpha, round(avg(s), 6) AS cv_score FROM e GROUP BY 1, 2, 3""")
def k11(spark, sf):
    spec = {"alpha": [0.1, 0.5, 0.8, 1.0, 2.0]}
    s = ln.cross_validate(fx.segment_orders(spark, sf), SEG_DAY, "total", ["n"], [ln.candidate("ridge", **g) for g in se.expand_grid(spec)])
    # The grid has five rows.
    return flat(ln.cv_score(s, ["seg"]).join(F.broadcast(se.grid_frame(spark, spec)), "candidate").drop("folds"))


@query("k12_random_search")
def k12(spark, sf):
    space = se.SEARCH_SPACES["elasticnet"]
    drawn = se.sample_space(spark, space, 20, seed=7)
    options = [ln.candidate("elasticnet", **{k: r[k] for k in space}) for r in drawn.orderBy("trial").collect()]
    d = fx.segment_orders(spark, sf)
    scores = ln.cv_score(ln.cross_validate(d, SEG_DAY, "total", ["n", "bal"], options, scaled=True), ["seg"])
    return flat(scores.withColumnRenamed("candidate", "trial").join(F.broadcast(drawn), "trial"))

# --- predictions and losses

_FIT = """
, x AS (SELECT *, CASE WHEN d < DATE '1999-06-01' THEN 'train' WHEN d < DATE '2000-06-01' THEN 'val' ELSE 'test' END AS split FROM segment_orders),
c AS (SELECT seg, regr_slope(total, n) AS w, regr_intercept(total, n) AS b FROM x WHERE split = 'train' GROUP BY 1),
p AS (SELECT x.seg, d, split, total AS actual, b + w * n AS predicted FROM x JOIN c USING (seg))"""


def _predictions(spark, sf):
    d = pr.split(fx.segment_orders(spark, sf), "d", "1999-06-01", "2000-06-01")
    m = ln.fit_linear(d.filter("split = 'train'"), ["seg"], "total", ["n"])
    return mt.actual_vs_predicted(ln.predict_linear(d, m, ["seg"], ["n"]), ["seg"], "d", "total")


@query("k6_predict", SEG + _FIT + " SELECT seg, CAST(d AS VARCHAR) AS d, split, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM p")
def k6(spark, sf):
    return flat(_predictions(spark, sf))


@query("k7_evaluate_empty_split", SEG + _FIT + """
SELECT s.split, coalesce(rows, 0) AS rows, mse FROM (SELECT unnest(['train', 'val', 'test']) AS split) s
LEFT JOIN (SELECT split, count(*) AS rows, round(avg(pow(actual - predicted, 2)), 6) AS mse FROM p WHERE split <> 'val' GROUP BY 1) e ON s.split = e.split""")
def k7(spark, sf):
    return flat(mt.evaluate(_predictions(spark, sf).filter("split <> 'val'"), {"mse": "neg_mean_squared_error"}))


@query("k8_metrics", SEG + _FIT + """
SELECT seg, split, count(*) AS rows, round(avg(pow(actual - predicted, 2)), 6) AS mse, round(avg(abs(actual - predicted)), 6) AS mae,
       round(avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)), 6) AS mape,
       round(sum(abs(actual - predicted)) / sum(abs(actual)), 6) AS wape FROM p GROUP BY 1, 2""")
def k8(spark, sf):
    return flat(mt.evaluate(_predictions(spark, sf), {m: m for m in ("mse", "mae", "mape", "wape")}, ["seg"]))


@query("u4_custom_metric", SEG + _FIT + """
SELECT split, count(*) AS rows, round(max(abs(actual - predicted)), 6) AS worst, round(sum(CASE WHEN predicted > actual THEN predicted - actual ELSE 0 END), 6) AS over FROM p GROUP BY 1""")
def u4(spark, sf):
    worst = lambda y, p: F.max(F.abs(y - p))
    over = lambda y, p: F.sum(F.greatest(p - y, F.lit(0.0)))
    return flat(mt.evaluate(_predictions(spark, sf), {"worst": worst, "over": over}))


@query("k14_performance", SEG + _FIT + """
SELECT 'linear_regression' AS model, round(avg(CASE WHEN split = 'train' THEN pow(actual - predicted, 2) END), 6) AS train,
       round(avg(CASE WHEN split = 'val' THEN pow(actual - predicted, 2) END), 6) AS val, round(avg(CASE WHEN split = 'test' THEN pow(actual - predicted, 2) END), 6) AS test FROM p""")
def k14(spark, sf):
    from tidemark.session import shared_dir
    from tidemark.sources.store import Store

    losses = {r["split"]: r["loss"] for r in mt.evaluate(_predictions(spark, sf), {"loss": "mse"}).collect()}
    store = Store(spark, shared_dir(spark))
    store.write_result(se.performance_row({"model": "linear_regression"}, losses["train"], losses["val"], losses["test"], None), "modeling_model_linear_regression")
    return flat(store.read_results().select(F.col("params.model").alias("model"), *[F.col(f"metrics.{s}").alias(s) for s in ("train", "val", "test")]))

# --- boosted trees and autoregression: rows only


_RAGGED = """
WITH r AS (SELECT user_id, d, n, v, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS len FROM (
  SELECT user_id, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)),
f AS (SELECT user_id, len, len // 6 AS w, unnest(range(len)) AS fold FROM (SELECT DISTINCT user_id, len FROM r) WHERE len // 6 >= 1),
c AS (SELECT * FROM f WHERE w + fold * w + w <= len),
m AS (SELECT c.user_id, fold, w, w + fold * w AS hi, avg(v) AS my, avg(n) AS mx, sum(n * v) - sum(n) * sum(v) / count(*) AS sxy,
             sum(n * n) - sum(n) * sum(n) / count(*) AS sxx
      FROM c JOIN r ON r.user_id = c.user_id AND i < w + fold * w AND i >= LOW GROUP BY 1, 2, 3)
SELECT m.user_id, fold, count(*) AS rows, round(avg(pow(v - my - sxy / (sxx + 1) * (n - mx), 2)), 1) AS score
FROM m JOIN r ON r.user_id = m.user_id AND i >= hi AND i < hi + w GROUP BY 1, 2"""


def _ragged(spark, sf, mode):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    s = Series.of(["user_id"], "d")
    scores = ln.cross_validate(d, s, "v", ["n"], [ln.candidate("ridge", 1.0)], "rolling", mode=mode, target_units=True)
    width = F.floor(F.count(F.lit(1)) / 6).alias("rows")
    return flat(scores.join(d.groupBy("user_id").agg(width), "user_id").select("user_id", "fold", "rows", "score"), 1)


@query("k9_rolling_ragged", _RAGGED.replace("LOW", "0"))
def k9r(spark, sf):
    """Series of different lengths: each has its own window, step and horizons."""
    return _ragged(spark, sf, fo.EXPANDING)


@query("k9_rolling_ragged_sliding", _RAGGED.replace("LOW", "fold * w"))
def k9rs(spark, sf):
    return _ragged(spark, sf, fo.SLIDING)


_ITEMS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
# Every cut between two values of a column, with the halved gain of squared error.
_CUTS = """
WITH t AS (SELECT *, l_extendedprice - avg(l_extendedprice) OVER () AS r FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-06-01'),
x AS (""" + " UNION ALL ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS x, r FROM t" for i, c in enumerate(_ITEMS)) + """),
v AS (SELECT f, x, sum(r) AS g, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT f, x, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY f) AS ga, sum(n) OVER (PARTITION BY f) AS na,
             row_number() OVER (PARTITION BY f ORDER BY x DESC) AS back FROM v WINDOW w AS (PARTITION BY f ORDER BY x)),
s AS (SELECT f, x, nl, na, (gl * gl / (nl + 1) + (ga - gl) * (ga - gl) / (na - nl + 1) - ga * ga / (na + 1)) / 2 AS gain FROM c WHERE back > 1)"""


@query("k4_first_cut", _CUTS + """
SELECT f AS feature, x AS upper, CAST(nl AS BIGINT) AS rows_left, CAST(na AS BIGINT) AS rows_all, round(gain / 1e6, 2) AS gain FROM s ORDER BY gain DESC, f LIMIT 1""")
def k4f(spark, sf):
    d = pr.split(table(spark, sf, "lineitem"), "l_shipdate", "1999-06-01", "2000-06-01").filter("split = 'train'")
    m, blocks = bo.fit_many(d, "l_extendedprice", _ITEMS, [{"max_depth": 1, "lambda_l2": 1.0}], rounds=0)
    wave = bo.Wave(m, [bo.settings({"max_depth": 1, "lambda_l2": 1.0})], [0], [[]])
    first = bo.first_cuts(blocks, wave)
    upper = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in m.edges]), F.col("feature") + 1)
    return flat(first.select("feature", F.element_at(upper, F.col("cut") + 1).alias("upper"), F.col("n_left").alias("rows_left"),
                             F.col("n_all").alias("rows_all"), F.round(F.col("gain") / 1e6, 2).alias("gain")))


@query("k4_stump_losses", _CUTS + """
, b AS (SELECT f, x FROM s ORDER BY gain DESC, f LIMIT 1),
m AS (SELECT avg(l_extendedprice) AS base FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-06-01'),
d AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-06-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-06-01' THEN 'val' ELSE 'test' END AS split,
             l_extendedprice AS y, CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount WHEN 2 THEN l_tax ELSE l_linenumber END <= x AS lefts
      FROM lineitem, b),
l AS (SELECT lefts, sum(y - base) / (count(*) + 1) AS step FROM d, m WHERE split = 'train' GROUP BY 1)
SELECT split, count(*) AS rows, round(avg(pow(y - base - 0.5 * step, 2)) / 1e6, 2) AS mse FROM d JOIN l USING (lefts), m GROUP BY 1""")
def k4s(spark, sf):
    d = pr.split(table(spark, sf, "lineitem"), "l_shipdate", "1999-06-01", "2000-06-01")
    m = md.fit_gbt(d, "l_extendedprice", _ITEMS, {"max_depth": 1, "lambda_l2": 1.0, "learning_rate": 0.5}, rounds=1)
    p = md.predict_gbt(m, d).select("split", F.col("l_extendedprice").alias("actual"), "predicted")
    return flat(mt.evaluate(p, {"mse": "mse"}).withColumn("mse", F.round(F.col("mse") / 1e6, 2)))


@query("k4_boosted_trees")
def k4(spark, sf):
    d = pr.split(table(spark, sf, "lineitem"), "l_shipdate", "1999-06-01", "2000-06-01")
    m = md.fit_gbt(d, "l_extendedprice", _ITEMS, {"max_depth": 4, "subsample": 0.8}, rounds=10)
    p = md.predict_gbt(m, d)
    return flat(mt.evaluate(p.select("split", F.col("l_extendedprice").alias("actual"), "predicted"), {"mse": "mse", "mae": "mae"}))


# An autoregression of one lag by the engine's rules, from `y` (k, g, v: series, grid step, value): NULL lags at holes.
_AR1 = """
, c AS (SELECT k, avg(v) AS mean FROM y GROUP BY 1),
u AS (SELECT y.k, g, v - mean AS u, mean FROM y JOIN c USING (k)),
l AS (SELECT a.k, a.u, b.u AS l1 FROM u a JOIN u b ON a.k = b.k AND b.g = a.g - 1 JOIN u e ON a.k = e.k AND e.g = a.g - 2
      JOIN u f ON a.k = f.k AND f.g = a.g - 3),
m AS (SELECT k, count(*) AS n, sum(u * u) AS s00, sum(u * l1) AS s01, sum(l1 * l1) AS s11 FROM l GROUP BY 1),
ar AS (SELECT k, CASE WHEN n > 3 AND abs(s01 / s11) < 0.999 AND n * ln((s00 - s01 * s01 / s11) / n) + 4 < n * ln(s00 / n) + 2
                      THEN s01 / s11 ELSE 0 END AS phi FROM m WHERE n > 2)"""


@query("k5_one_step_over_holes", """
WITH y AS (SELECT user_id AS k, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS g, round(sum(value), 2) AS v FROM events GROUP BY 1, 2)""" + _AR1 + """
SELECT k AS user_id, g, round(mean + CASE WHEN gap IS NULL THEN 0 ELSE pow(phi, gap) * before END, 6) AS predicted
FROM (SELECT u.*, g - lag(g) OVER w AS gap, lag(u.u) OVER w AS before FROM u WINDOW w AS (PARTITION BY k ORDER BY g)) JOIN ar USING (k)""")
def k5h(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.round(F.sum("value"), 2).alias("v"))
    d = d.withColumn("g", F.datediff("d", F.lit("2024-01-01").cast("date")))
    s = Series.of(["user_id"], "d")
    m = arima.fit_arimax(d, s, "v", [], max_p=1, max_d=0, max_q=0, step="g")
    return flat(arima.fitted_arimax(m, d, s, "v", [], step="g").select("user_id", "g", "predicted").filter("predicted IS NOT NULL"))


@query("k5_dropped_rows", SEG + """
, z AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY d) AS g,
               CASE WHEN d < DATE '2000-06-01' THEN 'train' WHEN d < DATE '2000-12-01' THEN 'val' ELSE 'test' END AS split FROM segment_orders),
r AS (SELECT *, row_number() OVER (PARTITION BY seg, split ORDER BY d) AS i FROM z),
y AS (SELECT seg AS k, g, total AS v FROM r WHERE split = 'train' AND i > 7)""" + _AR1 + """
, s AS (SELECT k, max(g) AS last, max_by(u, g) AS u, max(mean) AS mean FROM u GROUP BY 1)
SELECT seg, CAST(d AS VARCHAR) AS d, split, round(mean + pow(phi, g - last) * u, 6) AS predicted
FROM r JOIN s ON r.seg = s.k JOIN ar ON r.seg = ar.k WHERE split <> 'train' AND i > 7""")
def k5d(spark, sf):
    d = number_rows(fx.segment_orders(spark, sf), SEG_DAY, "g")
    d = pr.split(d, "d", "2000-06-01", "2000-12-01")
    d = ft.apply_features(d, SEG_DAY, lambda p, x, s: add_lags(x, s, ["n"], [1, 7]))
    m = arima.fit_arimax(d.filter("split = 'train'"), SEG_DAY, "total", [], max_p=1, max_d=0, max_q=0, step="g")
    p = arima.forecast_arimax(m, d.filter("split <> 'train'"), SEG_DAY, [], step="g")
    return flat(p.select("seg", "d", "split", "predicted"))


@query("k5_difference_order", SEG + """
, z AS (SELECT seg, d, 0 AS o, total AS v FROM segment_orders
        UNION ALL SELECT seg, d, 1, total - lag(total) OVER w FROM segment_orders WINDOW w AS (PARTITION BY seg ORDER BY d)
        UNION ALL SELECT seg, d, 2, total - 2 * lag(total) OVER w + lag(total, 2) OVER w FROM segment_orders WINDOW w AS (PARTITION BY seg ORDER BY d)),
e AS (SELECT seg, o, d, v - avg(v) OVER (PARTITION BY seg, o) AS e, count(*) OVER (PARTITION BY seg, o) AS n FROM z WHERE v IS NOT NULL),
s AS (SELECT seg, o, n, sum(e) OVER w AS s, row_number() OVER w AS r, CAST(floor(3 * sqrt(n) / 13) + 1 AS BIGINT) AS width
      FROM e WINDOW w AS (PARTITION BY seg, o ORDER BY d)),
t AS (SELECT a.seg, a.o, a.n, sum(a.s * a.s) / (a.n * sum(pow(a.s - coalesce(b.s, 0), 2) + CASE WHEN a.r > a.n - a.width THEN a.s * a.s ELSE 0 END) / any_value(a.width)) AS kpss
      FROM s a LEFT JOIN s b ON a.seg = b.seg AND a.o = b.o AND b.r = a.r - a.width GROUP BY 1, 2, 3)
SELECT seg, min(o) AS d, round(min_by(kpss, o), 6) AS kpss FROM t WHERE kpss <= 0.463 OR o = 2 GROUP BY 1""")
def k5k(spark, sf):
    return flat(arima.difference_order(fx.segment_orders(spark, sf), SEG_DAY, "total", 2))


@query("k5_arimax")
def k5(spark, sf):
    d = pr.split(fx.segment_orders(spark, sf), "d", "2000-06-01", "2000-12-01")
    train = d.filter("split = 'train'")
    m = arima.fit_arimax(train, SEG_DAY, "total", ["n"], max_p=2, max_d=1, max_q=2)
    p = arima.forecast_arimax(m, d.filter("split <> 'train'"), SEG_DAY, ["n"])
    return flat(p.select("seg", "d", "split", F.col("total").alias("actual"), "predicted"))
