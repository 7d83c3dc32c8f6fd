"""ARIMA with exogenous columns on a grid of time steps.

The model is a regression with ARIMA errors. The differencing order is the
first at which the KPSS test (Kwiatkowski and others 1992) finds the residuals
of the regression stationary; the statistic needs running sums only. The other
orders and the coefficients come from least squares on lags and lagged
residuals, on sub-blocks of one moment matrix, so all orders of a series are
compared on the same rows (Hannan and Rissanen 1982). Everything is done for
all series at once.

Rows carry a grid step. Steps without a complete row are holes: no lag reaches
over one, and the Kalman filter (`statespace`) only moves its state there. A
forecast is keyed by its step, so rows that are not asked for change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.columns import attach, col, join_on
from tidemark.operators.linear import Moments, _key_schema, candidate, complete_rows, dot, fit_linear, least_squares, moments
from tidemark.operators.ordered import number_rows, over_neighbours, running_totals
from tidemark.operators.statespace import Scan, difference_weights, transition
from tidemark.series import Series
from tidemark.session import written

# Steps one forecast task writes.
FORECAST_BLOCK = 100_000
# Critical value of the KPSS statistic (level) at 5 %. Fixed value.
KPSS_LIMIT = 0.463
# Columns of a model table; keys need other names.
RESERVED = ("p", "d", "q", "ar", "ma", "aic", "n", "beta", "mean", "last", "state", "kpss")


def on_grid(df: DataFrame, s: Series, step: str | None) -> tuple[DataFrame, Series]:
    """The rows with their grid step as `tm_g`, and the series ordered by it."""
    d = number_rows(df, s, "tm_g") if step is None else df.withColumn("tm_g", col(step).cast("long"))
    return d.filter(F.col("tm_g").isNotNull()), Series(s.keys, "tm_g", s.slice_rows if s.sliced else None, s.slice_rows)


def with_holes(rows: DataFrame, g: Series) -> DataFrame:
    """A row of NULLs for every absent step between two rows of a series."""
    keep = [c for c in rows.columns if c not in (*g.keys, "tm_g")]
    d = over_neighbours(rows, g, 1, lambda r, w: r.withColumn("tm_before", F.lag("tm_g").over(w)))
    d = d.withColumnRenamed("tm_g", "tm_here")
    d = d.withColumn("tm_g", F.explode(F.sequence(F.coalesce(F.col("tm_before") + 1, "tm_here"), "tm_here")))
    own = F.col("tm_g") == F.col("tm_here")
    return d.select(*[col(k) for k in g.keys], "tm_g", *[F.when(own, col(c)).alias(c) for c in keep])


def _lags(df: DataFrame, g: Series, spec: Mapping[str, int]) -> DataFrame:
    """Add `{c}_{k}` for k = 1..n of each column in `spec`; rows are one a step."""
    reach = max([1, *spec.values()])
    return over_neighbours(df, g, reach, lambda r, w: r.withColumns(
        {f"{c}_{k}": F.lag(c, k).over(w) for c, n in spec.items() for k in range(1, n + 1)}))


def _difference(c: str, d: int) -> Column:
    return sum((F.col(c if not k else f"{c}_{k}") * w for k, w in enumerate(difference_weights(d))), F.lit(0.0))


def kpss(df: DataFrame, s: Series, value: str) -> DataFrame:
    """One row a series: `n`, `kpss` (level stationarity; NULL for a constant series).

    Residuals from the mean are summed up in order of `s`; NULL values are left
    out. The long-run variance has Bartlett weights up to lag floor(3 sqrt(n) / 13):
    it is the mean square of moving sums of one value more, and a moving sum is
    a difference of two running sums.
    """
    keys = list(s.keys)
    d = df.filter(col(value).isNotNull()).select(*[col(k) for k in keys], col(s.ts), col(value).cast("double").alias("tm_v"))
    stats = d.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("tm_n"), F.avg("tm_v").alias("tm_mean"))
    d = attach(d, stats, keys).withColumn("tm_e", F.col("tm_v") - F.col("tm_mean"))
    d = running_totals(d, s, {"tm_s": ("sum", F.col("tm_e")), "tm_r": ("sum", F.lit(1).cast("long"))})
    width = F.floor(F.sqrt("tm_n") * 3 / 13) + 1
    d = d.select(*[col(k) for k in keys], "tm_r", "tm_n", "tm_s", width.alias("tm_width"))
    far = d.select(*[col(k) for k in keys], (F.col("tm_r") + F.col("tm_width")).alias("tm_r"), F.col("tm_s").alias("tm_far"))
    both = join_on(d, far, [*keys, "tm_r"], "left")
    # The running sum ends at 0, so the moving sums past the end are those of the last rows.
    moving = F.pow(F.col("tm_s") - F.coalesce("tm_far", F.lit(0.0)), 2)
    tail = F.when(F.col("tm_r") > F.col("tm_n") - F.col("tm_width"), F.pow("tm_s", 2)).otherwise(0.0)
    out = both.groupBy(*[col(k) for k in keys]).agg(
        F.first("tm_n").alias("n"), F.sum(F.pow("tm_s", 2)).alias("tm_ss"),
        (F.sum(moving + tail) / F.first("tm_width")).alias("tm_lr"))
    tiny = F.col("tm_lr") <= 1e-12 * F.col("tm_ss")
    return out.select(*[col(k) for k in keys], "n", F.when(~tiny, F.col("tm_ss") / (F.col("n") * F.col("tm_lr"))).alias("kpss"))


def difference_order(df: DataFrame, s: Series, value: str, max_d: int) -> DataFrame:
    """One row a series: `d`, the first order whose KPSS statistic is not above
    the limit (else `max_d`), and the statistic there. Rows are one a step."""
    g = s.within("tm_d")
    levels = _lags(df.select(*[col(k) for k in s.keys], col(s.ts), col(value).alias("tm_v")), s, {"tm_v": max_d})
    each = F.array(*[F.struct(F.lit(k).alias("tm_d"), _difference("tm_v", k).alias("tm_z")) for k in range(max_d + 1)])
    tests = kpss(levels.select(*[col(k) for k in s.keys], col(s.ts), F.inline(each)), g, "tm_z")
    passed = F.coalesce(F.col("kpss") <= KPSS_LIMIT, F.lit(True)) | (F.col("tm_d") == max_d)
    found = tests.groupBy(*[col(k) for k in s.keys]).agg(
        F.min_by(F.struct(F.col("tm_d").alias("d"), "kpss"), F.when(passed, F.col("tm_d"))).alias("tm_o"))
    return found.select(*[col(k) for k in s.keys], "tm_o.*")


def fit_arimax(df: DataFrame, s: Series, target: str, exog: Sequence[str] = (), max_p: int = 2, max_d: int = 1,
               max_q: int = 2, step: str | None = None) -> DataFrame:
    """One row a series: orders d (by test) and p, q (by AIC), coefficients, and
    the last step with the state a forecast starts from.

    `step` names the grid step of a row, else rows are numbered. Rows with a
    missing value are holes in the grid.
    """
    keys = list(s.keys)
    taken = set(keys) & set(RESERVED)
    if taken:
        raise ValueError(f"key columns {sorted(taken)} have the names of model columns; rename them")
    names, nk = [target, *exog], len(keys)
    rows, g = on_grid(df, s, step)
    rows = complete_rows(rows, names).select(*[col(k) for k in keys], "tm_g", *[
        col(c).cast("double").alias(f"tm_c{i}") for i, c in enumerate(names)])
    x = [f"tm_c{i}" for i in range(1, len(names))]
    dense = with_holes(rows, g).persist()
    try:
        level = fit_linear(rows, keys, "tm_c0", x, [candidate()]).select(
            *[col(k) for k in keys], F.col("coef").alias("tm_b"), F.col("intercept").alias("tm_a"))
        flat = attach(dense, level, keys)
        flat = flat.withColumn("tm_w", F.col("tm_c0") - F.col("tm_a") - (dot(F.col("tm_b"), x) if x else F.lit(0.0)))
        orders = difference_order(flat, g, "tm_w", max_d)
        d = attach(_lags(dense, g, {f"tm_c{i}": max_d for i in range(len(names))}), orders.select(*[col(k) for k in keys], F.col("d").alias("tm_d")), keys)
        z = {f"tm_z{i}": F.when(F.col("tm_d") == 0, F.col(f"tm_c{i}")) for i in range(len(names))}
        for k in range(1, max_d + 1):
            z = {c: v.when(F.col("tm_d") == k, _difference(f"tm_c{c[4:]}", k)) for c, v in z.items()}
        d = d.withColumns(z).select(*[col(k) for k in keys], "tm_g", *z)
        zx = [f"tm_z{i}" for i in range(1, len(names))]
        reg = fit_linear(complete_rows(d, list(z)), keys, "tm_z0", zx, [candidate()]).select(
            *[col(k) for k in keys], F.col("coef").alias("beta"), F.col("intercept").alias("mean"))
        d = attach(d, reg, keys)
        d = d.withColumn("tm_u", F.col("tm_z0") - F.col("mean") - (dot(F.col("beta"), zx) if zx else F.lit(0.0)))
        tried = _orders_tried(d.select(*[col(k) for k in keys], "tm_g", "tm_u"), g, max_p, max_q)
        best = tried.groupBy(*[col(k) for k in keys]).agg(
            F.min_by(F.struct("p", "q", "ar", "ma", "aic", "n"), F.struct("aic", "p", "q")).alias("o"))
        best = best.select(*[col(k) for k in keys], "o.*")
        model = best.crossJoin(orders).crossJoin(reg) if not nk else join_on(join_on(best, orders, keys), reg, keys)
        model = written(model, "arima")
        levels = _levels(rows, model, keys, x)
        last = levels.groupBy(*[col(k) for k in keys]).agg(F.max("g").alias("last"))
        states = Scan(levels, model, keys).last_states()
        model = model.crossJoin(last).crossJoin(states) if not nk else join_on(join_on(model, last, keys), states, keys)
        return written(model, "arima")
    finally:
        dense.unpersist()


def _levels(rows: DataFrame, model: DataFrame, keys: Sequence[str], x: Sequence[str]) -> DataFrame:
    """keys, g, v: the target less its regression part."""
    d = attach(rows, model.select(*[col(k) for k in keys], F.col("beta").alias("tm_beta")), keys)
    part = dot(F.col("tm_beta"), x) if x else F.lit(0.0)
    d = d.filter("tm_beta IS NOT NULL") if keys else d
    return d.select(*[col(k) for k in keys], F.col("tm_g").alias("g"), (F.col("tm_c0") - part).alias("v"))


def _orders_tried(d: DataFrame, g: Series, max_p: int, max_q: int) -> DataFrame:
    """Every p, q with its coefficients and AIC, all on the rows that the largest orders leave."""
    keys, reach = list(g.keys), max_p + max_q + 2
    nk = len(keys)
    d = _lags(d, g, {"tm_u": reach})
    long_lags = [f"tm_u_{k}" for k in range(1, reach + 1)]
    far = fit_linear(complete_rows(d, [*long_lags, "tm_u"]), keys, "tm_u", long_lags, [candidate(fit_intercept=False)])
    d = attach(d, far.select(*[col(k) for k in keys], F.col("coef").alias("far")), keys)
    d = d.withColumn("tm_e", F.col("tm_u") - dot(F.col("far"), long_lags))
    d = _lags(d, g, {"tm_e": max_q})
    terms = [*[f"tm_u_{k}" for k in range(1, max_p + 1)], *[f"tm_e_{k}" for k in range(1, max_q + 1)]]
    cols = [*terms, "tm_u"]
    # Innovations only stand at rows with all long lags, so every order meets the same rows.
    m = moments(complete_rows(d, [*cols, *long_lags]), keys, cols, [0.0] * len(cols))
    at = np.zeros(len(cols))
    schema = f"{_key_schema(d, keys)}p int, q int, ar array<double>, ma array<double>, aic double, n long"

    def orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mom = Moments(np.array(r.tm_m), at)
                for p in range(max_p + 1):
                    for q in range(max_q + 1):
                        ids = [*range(p), *range(max_p, max_p + q)]
                        if mom.n <= len(ids) + 2:
                            continue
                        block, b = mom.m[np.ix_(ids, ids)], mom.m[ids, -1]
                        w = least_squares(block, b) if ids else np.zeros(0)
                        rss = max(float(mom.m[-1, -1] - b @ w), 1e-300)
                        aic = mom.n * math.log(rss / mom.n) + 2 * (p + q + 1)
                        if _settled(w[:p]):
                            out.append((*r[:nk], p, q, w[:p], w[p:], aic, int(mom.n)))
            yield pd.DataFrame(out, columns=[*keys, "p", "q", "ar", "ma", "aic", "n"])

    return m.mapInPandas(orders, schema)


def _settled(ar: np.ndarray) -> bool:
    """True if the autoregression dies out (roots outside the unit circle)."""
    if not len(ar):
        return True
    companion = np.eye(len(ar), k=-1)
    companion[0] = ar
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 0.999)



def _start(r: Any) -> tuple[np.ndarray, np.ndarray, int]:
    """Transition matrix with the constant, the state after the last step, and where the level stands."""
    f, c, _, at = transition(r.ar, int(r.d), r.ma, r.mean)
    n = len(f)
    a = np.eye(n + 1)
    a[:n, :n], a[:n, n] = f, c
    return a, np.append(r.state, 1.0), at


def forecast_arimax(model: DataFrame, future: DataFrame, s: Series, exog: Sequence[str] = (), out: str = "predicted",
                    step: str | None = None) -> DataFrame:
    """Forecast every row of `future` by its distance from the last fitted step.

    Without `step` the first row of `future` follows the last fitted one. Rows
    at or before the last step have no forecast. Steps are dealt into blocks;
    each jumps to its first horizon by a matrix power and walks on from there.
    """
    keys = [*s.keys]
    if step is None:
        d = number_rows(future, s, "__h")
    else:
        last = model.select(*[col(k) for k in keys], F.col("last").alias("__from"))
        d = attach(future, last, keys).withColumn("__h", col(step).cast("long") - F.col("__from")).drop("__from")
    d = d.withColumn("__block", F.when(F.col("__h") > 0, F.floor((F.col("__h") - 1) / FORECAST_BLOCK)))
    blocks = d.filter("__block IS NOT NULL").groupBy(*[col(k) for k in keys], "__block").agg(F.collect_set("__h").alias("__hs"))
    work = attach(blocks, model.select(*[col(k) for k in keys], F.struct("d", "ar", "ma", "mean", "state").alias("__m")), keys)
    work = work.select(*[col(k) for k in keys], "__block", "__hs", "__m.*").filter("state IS NOT NULL")
    work = work.repartition(*[col(k) for k in keys], "__block").withColumnsRenamed({"__block": "block", "__hs": "hs"})
    nk = len(keys)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False, name="R"):
                wanted = np.sort(np.asarray(r.hs))
                a, state, at = _start(r)
                first = int(r.block) * FORECAST_BLOCK
                state = np.linalg.matrix_power(a, first) @ state
                values = np.empty(int(wanted[-1]) - first)
                for i in range(len(values)):
                    state = a @ state
                    values[i] = state[at]
                frame = {k: [r[i]] * len(wanted) for i, k in enumerate(keys)}
                yield pd.DataFrame({**frame, "__h": wanted, "__v": values[wanted - first - 1]})

    levels = work.mapInPandas(walk, f"{_key_schema(future, keys)}__h long, __v double")
    joined = join_on(d, levels, [*keys, "__h"], "left")
    joined = attach(joined, model.select(*[col(k) for k in keys], F.col("beta").alias("__beta")), keys)
    x = dot(F.col("__beta"), exog) if exog else F.lit(0.0)
    return joined.withColumn(out, F.col("__v") + x).drop("__h", "__block", "__v", "__beta")


def fitted_arimax(model: DataFrame, df: DataFrame, s: Series, target: str, exog: Sequence[str], out: str = "predicted",
                  step: str | None = None) -> DataFrame:
    """One-step predictions from the rows before each; NULL where a row is incomplete."""
    keys, names = list(s.keys), [target, *exog]
    rows, _ = on_grid(df, s, step)
    inner = complete_rows(rows, names).select(*[col(k) for k in keys], "tm_g", *[
        col(c).cast("double").alias(f"tm_c{i}") for i, c in enumerate(names)])
    expected = Scan(_levels(inner, model, keys, [f"tm_c{i}" for i in range(1, len(names))]), model, keys).one_step("tm_expected")
    d = join_on(rows, expected.withColumnRenamed("g", "tm_g"), [*keys, "tm_g"], "left")
    d = attach(d, model.select(*[col(k) for k in keys], F.col("beta").alias("__beta")), keys)
    x = dot(F.col("__beta"), exog) if exog else F.lit(0.0)
    return d.withColumn(out, F.col("tm_expected") + x).select(*[col(c) for c in df.columns], out)
