"""Linear models from second moments.

Every model of the family depends on the data only through sums of products.
One aggregate yields them per series (or per fold block); a p-by-p solve then
gives the coefficients. Expanding folds are running totals of block moments,
k-fold training sets are the total minus a block, and the squared error of a
test block follows from its moments as well, so cross-validation never copies
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.columns import attach, col, join_on, small_side
from tidemark.operators.folds import EXPANDING, SLIDING, folds_equal, folds_plain, rolling_defaults
from tidemark.operators.metrics import metric_of
from tidemark.operators.ordered import number_rows, running_totals
from tidemark.series import Series

KINDS = ("linear_regression", "ridge", "lasso", "elasticnet")


def candidate(kind: str = "linear_regression", alpha: float = 1.0, l1_ratio: float = 0.5, fit_intercept: bool = True) -> dict[str, Any]:
    """Parameters of one model, normalised so that equal models compare equal."""
    if kind not in KINDS:
        raise ValueError(f"unknown linear model {kind!r}; known: {KINDS}")
    l1 = {"linear_regression": 0.0, "ridge": 0.0, "lasso": 1.0}.get(kind, float(l1_ratio))
    return {"kind": kind, "alpha": 0.0 if kind == "linear_regression" else float(alpha), "l1_ratio": l1,
            "fit_intercept": bool(fit_intercept)}


# --- moments -------------------------------------------------------------

def centre(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Column means, used only to keep the sums of products well conditioned."""
    row = df.agg(*[F.avg(col(c).cast("double")) for c in cols]).first()
    return [0.0 if v is None or math.isnan(v) else float(v) for v in row]


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _terms(cols: Sequence[str], shift: Sequence[float]) -> dict[str, Column]:
    """Row-level terms whose sums are the moments of the shifted columns."""
    z = [col(c).cast("double") - F.lit(m) for c, m in zip(cols, shift)]
    terms = {"tm_n": F.lit(1.0)}
    terms |= {f"tm_s{i}": v for i, v in enumerate(z)}
    terms |= {f"tm_m{i}_{j}": z[i] * z[j] for i, j in _pairs(len(cols))}
    return terms


def _names(p: int) -> list[str]:
    return ["tm_n", *[f"tm_s{i}" for i in range(p)], *[f"tm_m{i}_{j}" for i, j in _pairs(p)]]


def _extremes(cols: Sequence[str]) -> dict[str, tuple[str, Column]]:
    out: dict[str, tuple[str, Column]] = {}
    for i, c in enumerate(cols):
        v = col(c).cast("double")
        out |= {f"tm_lo{i}": ("min", v), f"tm_hi{i}": ("max", v)}
    return out


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


# More aggregates than this and Spark leaves generated code for slow ones.
JVM_TERMS = 90


def moments(df: DataFrame, group: Sequence[str], cols: Sequence[str], shift: Sequence[float], ranges: bool = False) -> DataFrame:
    """One row per group with packed arrays: `tm_m` (n, sums, products), `tm_lo`, `tm_hi`.

    A few columns are summed in generated code. For many columns each task
    first multiplies its rows in numpy and hands on one partial row per group.
    """
    p = len(cols)
    x = [col(c).cast("double") for c in cols]
    group = list(group)
    rows = df.select(*[col(g) for g in group], *[v.alias(f"tm_x{i}") for i, v in enumerate(x)])
    if len(_names(p)) + (2 * p if ranges else 0) > JVM_TERMS:
        part = _partial_moments(rows, group, p, shift)
        sums = [f"sum(tm_m[{k}])" for k in range(len(_names(p)))]
        ends = [[f"{f}({a}[{i}])" for i in range(p)] for f, a in (("min", "tm_lo"), ("max", "tm_hi"))]
    else:
        part = rows.withColumns({f"tm_z{i}": F.col(f"tm_x{i}") - F.lit(m) for i, m in enumerate(shift)})
        sums = ["CAST(count(1) AS DOUBLE)", *[f"sum(tm_z{i})" for i in range(p)], *[f"sum(tm_z{i} * tm_z{j})" for i, j in _pairs(p)]]
        ends = [[f"{f}(tm_x{i})" for i in range(p)] for f in ("min", "max")]
    return part.groupBy(*[col(g) for g in group]).agg(
        F.expr(f"array({', '.join(sums)})").alias("tm_m"),
        *[F.expr(f"CAST(array({', '.join(e) if ranges else ''}) AS array<double>)").alias(n) for e, n in zip(ends, ("tm_lo", "tm_hi"))])


def _partial_moments(rows: DataFrame, group: Sequence[str], p: int, shift: Sequence[float], held_groups: int = 2_000) -> DataFrame:
    """Moments per task and group; sums are handed on when many groups are open."""
    at, (iu, ju), names = np.array(shift), np.triu_indices(p), [*group, "tm_m", "tm_lo", "tm_hi"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        flush = lambda: pd.DataFrame([(*k, *v) for k, v in held.items()], columns=names)
        for pdf in batches:
            if not len(pdf):
                continue
            code = pdf.groupby(list(group), dropna=False, sort=False).ngroup().to_numpy() if group else np.zeros(len(pdf), int)
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.diff(code[order], prepend=-1))
            x = pdf.iloc[:, len(group):].to_numpy(float)[order]
            z = x - at
            count = np.diff(np.append(start, len(x)))[:, None]
            sums = np.hstack([count, np.add.reduceat(z, start), np.add.reduceat(z[:, iu] * z[:, ju], start)])
            lo, hi = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
            labels = pdf.iloc[order[start], :len(group)].astype(object)
            labels = labels.where(labels.notna(), None).itertuples(index=False, name=None) if group else [()]
            for k, key in enumerate(labels):
                if key in held:
                    old = held[key]
                    held[key] = [old[0] + sums[k], np.minimum(old[1], lo[k]), np.maximum(old[2], hi[k])]
                else:
                    held[key] = [sums[k], lo[k], hi[k]]
            if len(held) > held_groups:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return rows.mapInPandas(partial, f"{_key_schema(rows, group)}tm_m array<double>, tm_lo array<double>, tm_hi array<double>")


def _packed(df: DataFrame, keep: Sequence[str], p: int, ranges: bool) -> DataFrame:
    empty = F.array().cast("array<double>")
    lo, hi = [(F.array(*[F.col(f"tm_{e}{i}") for i in range(p)]) if ranges else empty).alias(f"tm_{e}") for e in ("lo", "hi")]
    return df.select(*keep, F.array(*[F.col(c) for c in _names(p)]).alias("tm_m"), lo, hi)


class Moments:
    """Second moments of shifted columns, target last, in numpy."""

    def __init__(self, packed: np.ndarray, shift: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        p = len(shift)
        self.n, self.s, self.shift = packed[0], packed[1:p + 1], shift
        self.m = np.zeros((p, p))
        self.m[np.triu_indices(p)] = packed[p + 1:]
        self.m = self.m + np.triu(self.m, 1).T
        self.scaled = lo is not None and len(lo) == p
        self.lo = lo if self.scaled else np.zeros(p)
        span = (hi - lo) if self.scaled else np.ones(p)
        self.unit = np.where(span == 0, 1.0, span)

    def solve(self, candidates: Sequence[Mapping[str, Any]]) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (one row per candidate) and intercepts of all candidates,
        fitted in scaled units and returned for the columns as they are."""
        s, m, n = self.s / self.unit, self.m / np.outer(self.unit, self.unit), self.n
        offset = (self.shift - self.lo) / self.unit
        w, b = np.zeros((len(candidates), len(s) - 1)), np.zeros(len(candidates))
        for intercept in (True, False):
            ids = [i for i, c in enumerate(candidates) if c["fit_intercept"] is intercept]
            if not ids:
                continue
            if intercept:
                g = m - np.outer(s, s) / n
            else:
                g = m + np.outer(offset, s) + np.outer(s, offset) + n * np.outer(offset, offset)
            alpha = np.array([candidates[i]["alpha"] for i in ids])
            l1 = np.array([candidates[i]["l1_ratio"] for i in ids])
            w[ids] = solve_all(g[:-1, :-1], g[:-1, -1], n, alpha, l1)
            if intercept:
                mean = s / n + offset
                b[ids] = mean[-1] - w[ids] @ mean[:-1]
        v = w * self.unit[-1] / self.unit[:-1]
        return v, self.lo[-1] + b * self.unit[-1] - v @ self.lo[:-1]

    def squared_errors(self, v: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of squared errors on these rows, per candidate."""
        a = np.hstack([-v, np.ones((len(v), 1))])
        off = b - a @ self.shift
        return np.einsum("ci,ij,cj->c", a, self.m, a) - 2 * off * (a @ self.s) + self.n * off * off


def least_squares(g: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Solve g w = q for a Gram matrix that may be singular."""
    size = np.sqrt(np.maximum(np.diag(g), 0))
    size = np.where(size > 0, size, 1.0)
    value, vector = np.linalg.eigh(g / np.outer(size, size))
    keep = value > 1e-11 * max(value.max(initial=0.0), 1e-300)
    part = vector[:, keep]
    return part @ ((part.T @ (q / size)) / value[keep]) / size


# Sweeps of coordinate descent before open penalties are settled one by one.
SWEEPS = 100


def _settled(a: np.ndarray, r: np.ndarray, lasso: float, start: np.ndarray) -> np.ndarray | None:
    """The w that minimises w'aw/2 - r'w + lasso*|w|, from `start`, or None where
    rounding keeps it from the optimality conditions.

    Feature-sign search (Lee et al. 2007): with the signs held the problem is a
    linear solve. A step ends where the first coefficient reaches 0, which then
    leaves; where no sign is wrong the column that breaks the conditions most
    comes in. Columns that depend on each other slide along what does not change
    the fit until one of them is 0. Each step lowers the loss.
    """
    size = np.sqrt(np.maximum(np.diag(a), 0))
    used = np.flatnonzero(size > 0)
    size = size[used]
    a, r, floor, w = a[np.ix_(used, used)] / np.outer(size, size), r[used] / size, lasso / size, start[used] * size
    slack = 1e-9 * floor + 1e-13 * np.abs(r).max(initial=0.0)
    for _ in range(50 * len(used) + 50):
        down, signs = r - a @ w, np.sign(w)
        off = signs == 0
        if (np.abs(down - floor * signs) <= slack)[~off].all():
            over = np.where(off, np.abs(down) - floor - slack, -1.0)
            j = int(np.argmax(over)) if len(over) else 0
            if not len(over) or over[j] <= 0:
                out = np.zeros(len(start))
                out[used] = w / size
                return out
            signs[j] = np.sign(down[j])
        on = np.flatnonzero(signs)
        value, vector = np.linalg.eigh(a[np.ix_(on, on)])
        keep = value > 1e-11 * value.max()
        pull = vector.T @ (down - floor * signs)[on]
        slide = vector[:, ~keep] @ pull[~keep]
        free = np.abs(slide).max(initial=0.0) > slack[on].max()
        step = slide if free else vector[:, keep] @ (pull[keep] / value[keep])
        back = np.flatnonzero((step * signs[on] < 0) & (w[on] != 0))
        reach = -w[on][back] / step[back]
        if len(back) and (free or reach.min() < 1):
            k = int(np.argmin(reach))
            w[on] += reach[k] * step
            w[on[back[k]]] = 0.0
        elif free:
            return None
        else:
            w[on] += step
    return None


def solve_all(g: np.ndarray, q: np.ndarray, n: float, alpha: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """One row of coefficients per (alpha, l1_ratio), for one Gram matrix.

    No penalty: least squares. Squared penalty: a shifted solve. Absolute
    penalty: coordinate descent on the Gram matrix (Friedman et al. 2010), for
    all penalties side by side. Columns that depend on each other under a light
    penalty make its steps tiny; what is still open after `SWEEPS` sweeps is
    solved by `_settled`, whose steps follow the columns, not the penalty.
    """
    p = len(q)
    w = np.zeros((len(alpha), p))
    if p == 0:
        return w
    plain, ridge = alpha == 0, (alpha > 0) & (l1 == 0)
    if plain.any():
        w[plain] = least_squares(g, q)
    if ridge.any():
        w[ridge] = np.linalg.solve(g + alpha[ridge][:, None, None] * np.eye(p), np.broadcast_to(q[:, None], (ridge.sum(), p, 1)))[..., 0]
    rest = np.flatnonzero(~plain & ~ridge)
    if not len(rest):
        return w
    h, r = g / n, q / n
    lasso, square = (alpha * l1)[rest], (alpha * (1 - l1))[rest]
    v = np.zeros((len(rest), p))
    open_rows = np.arange(len(rest))
    for sweep in range(20_000):
        if sweep == SWEEPS:
            done = np.zeros(len(open_rows), bool)
            for k, i in enumerate(open_rows):
                found = _settled(h + square[i] * np.eye(p), r, lasso[i], v[i])
                if found is not None:
                    v[i], done[k] = found, True
            open_rows = open_rows[~done]
            if not len(open_rows):
                break
        now = v[open_rows]
        moved = np.zeros(len(open_rows))
        for j in range(p):
            weight = h[j, j] + square[open_rows]
            rho = r[j] - now @ h[j] + h[j, j] * now[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - lasso[open_rows], 0) / np.where(weight > 0, weight, 1.0)
            new = np.where(weight > 0, new, 0.0)
            moved = np.maximum(moved, np.abs(new - now[:, j]))
            now[:, j] = new
        v[open_rows] = now
        open_rows = open_rows[moved > 1e-11 * np.maximum(1.0, np.abs(now).max(axis=1))]
        if not len(open_rows):
            break
    w[rest] = v
    return w


# --- fit and predict ------------------------------------------------------

_MODEL = "candidate int, coef array<double>, intercept double"


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows over a few tasks a core: a row of moments has few bytes and takes long to
    solve, so its partitions must not be merged by their size."""
    spark = df.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *[col(c) for c in by]) if by else df


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows a linear model can use: no NULL and no NaN in its columns."""
    return df.na.drop(subset=[c for c in dict.fromkeys(cols)])


def fit_linear(df: DataFrame, keys: Sequence[str], target: str, cols: Sequence[str],
               candidates: Sequence[Mapping[str, Any]] = (), scaled: bool = False, shift: Sequence[float] | None = None) -> DataFrame:
    """One row per series and candidate: keys, candidate, coef, intercept, n.

    With `scaled` the columns are min-max scaled for the fit and the returned
    coefficients are turned back to the original units.
    """
    candidates = list(candidates) or [candidate()]
    names = [*cols, target]
    rows = complete_rows(df, names)
    shift = centre(rows, names) if shift is None else shift
    m = moments(rows, keys, names, shift, scaled)
    at = np.array(shift)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if not r.tm_m[0]:
                    continue
                mom = Moments(np.array(r.tm_m), at, np.array(r.tm_lo), np.array(r.tm_hi))
                w, b = mom.solve(candidates)
                out += [(*r[:len(keys)], k, w[k], float(b[k]), int(mom.n)) for k in range(len(candidates))]
            yield pd.DataFrame(out, columns=[*keys, "candidate", "coef", "intercept", "n"])

    m = m.withColumn("tm_m", F.transform("tm_m", lambda v: F.coalesce(v, F.lit(0.0))))
    return _dealt(m, keys).mapInPandas(solve, f"{_key_schema(df, keys)}{_MODEL}, n long")


def dot(coef: Column, cols: Sequence[str]) -> Column:
    x = F.array(*[col(c).cast("double") for c in cols])
    return F.aggregate(F.zip_with(coef, x, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def predict_linear(df: DataFrame, model: DataFrame, keys: Sequence[str], cols: Sequence[str], out: str = "predicted") -> DataFrame:
    """Add predictions of a model table with one row per series."""
    d = attach(df, model.select(*keys, F.col("coef").alias("__coef"), F.col("intercept").alias("__b")), keys)
    return d.withColumn(out, dot(F.col("__coef"), cols) + F.col("__b")).drop("__coef", "__b")


# --- cross-validation -----------------------------------------------------

_SCORE = "candidate int, fold long, score double"
_FOLD_MODEL = "fold long, candidate int, coef array<double>, intercept double, y_lo double, y_unit double"


def cross_validate(df: DataFrame, s: Series, target: str, cols: Sequence[str], candidates: Sequence[Mapping[str, Any]],
                   scheme: str = "equal", k: int = 5, mode: str = EXPANDING, max_train: int | None = None,
                   window: int | None = None, step: int | None = None, horizons: Sequence[int] | None = None,
                   metric: str = "mse", scaled: bool = False, shift: Sequence[float] | None = None,
                   target_units: bool = False) -> DataFrame:
    """Score of every candidate on every fold: keys, candidate, fold, score.

    Schemes: `equal` (k equal test blocks), `kfold` (contiguous blocks, train is
    the rest) and `rolling` (moving origin). With `scaled`, predictors and
    target are min-max scaled on the fold's train rows and the score is taken
    in scaled units, or with `target_units` in those of the target. `shift` are
    numbers near the column means (`centre`); they only keep the arithmetic accurate.
    """
    names = [*cols, target]
    rows = complete_rows(df, names)
    # One pass gives the length of every series and, from it, the column means.
    measured = rows.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"), *(
        [F.sum(col(c).cast("double")).alias(f"tm_c{i}") for i, c in enumerate(names)] if shift is None else []))
    measured = small_side(measured)
    if shift is None:
        total = measured.agg(F.sum("n"), *[F.sum(f"tm_c{i}") for i in range(len(names))]).first()
        shift = [float(v / total[0]) for v in total[1:]] if total[0] else [0.0] * len(names)
    lengths = measured.select(*s.keys, "n")
    if scheme == "rolling":
        return _rolling(rows, s, lengths, names, shift, candidates, window, step, horizons, mode, metric, scaled, k, target_units)
    if scheme not in ("equal", "kfold"):
        raise ValueError(f"unknown scheme {scheme!r}")
    return _blocks(rows, s, lengths, names, shift, candidates, scheme, k, mode, max_train, metric, scaled, target_units)


def cv_score(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the fold scores of each candidate."""
    return scores.groupBy(*keys, "candidate").agg(F.avg("score").alias("cv_score"), F.count("score").alias("folds"))


def _blocks(rows, s, lengths, names, shift, candidates, scheme, k, mode, max_train, metric, scaled, target_units):
    keys = list(s.keys)
    if scheme == "equal":
        if mode == SLIDING and max_train is None:
            lengths = lengths.withColumn("w", rolling_defaults(F.col("n"), k))
            folds = folds_equal(lengths, keys, k)
            folds = join_on(folds, lengths.select(*keys, "w"), keys) if keys else folds.withColumn("w", lengths.select("w").scalar())
            folds = folds.withColumn("train_lo", F.greatest(F.col("train_hi") - F.col("w"), F.lit(0))).drop("w")
        else:
            folds = folds_equal(lengths, keys, k, max_train if mode == SLIDING else None)
    else:
        folds = folds_plain(lengths, keys, k).select(
            *keys, "fold", F.lit(-1).cast("long").alias("train_lo"), F.lit(-1).cast("long").alias("train_hi"), "test_lo", "test_hi")
    bounds = ("train_lo", "train_hi", "test_lo", "test_hi")
    table = folds.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("fold", *bounds))).alias("tm_folds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(*bounds))))).alias("tm_edges"))
    table = small_side(table)
    # Rows between two neighbouring fold borders form one segment.
    d = attach(number_rows(rows, s, "__rn"), table, keys).filter("tm_edges IS NOT NULL")
    seg = F.size(F.filter("tm_edges", lambda e: e <= F.col("__rn") - 1)).cast("long")
    d = d.withColumn("tm_seg", seg)
    if not scaled and metric in ("mse", "neg_mean_squared_error"):
        d = d.drop("tm_folds", "tm_edges")
    seg_moments = moments(d, [*keys, "tm_seg"], names, shift, scaled)
    # At most 2k+2 segments per series, so a series' segments are a short list.
    packed = seg_moments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tm_seg", "tm_m", "tm_lo", "tm_hi"))).alias("tm_segs"))
    packed = _dealt(attach(packed, table, keys), keys)
    by_moments = metric_of(metric) is metric_of("mse")
    at = np.array(shift)
    nk = len(keys)

    def per_fold(r: Any) -> Iterator[tuple[int, Moments, Moments]]:
        edges = list(r.tm_edges)
        segs = {g["tm_seg"]: g for g in r.tm_segs}
        empty = np.zeros(len(r.tm_segs[0]["tm_m"]))

        def span(ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            got = [segs[i] for i in ids if i in segs]
            m = sum((np.array(g["tm_m"]) for g in got), empty)
            if not scaled or not got:
                return m, np.array([]), np.array([])
            return m, np.min([g["tm_lo"] for g in got], axis=0), np.max([g["tm_hi"] for g in got], axis=0)

        def ids(lo: int, hi: int) -> list[int]:
            return [i for i in range(len(edges) + 1) if i > 0 and lo <= edges[i - 1] and (i < len(edges) and edges[i] <= hi)]

        for f in r.tm_folds:
            test = ids(f["test_lo"], f["test_hi"])
            train = ids(f["train_lo"], f["train_hi"]) if scheme == "equal" else [i for i in segs if i not in test]
            a, lo, hi = span(train)
            b, _, _ = span(test)
            if a[0] and b[0]:
                yield f["fold"], Moments(a, at, lo, hi), Moments(b, at)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for fold, train, test in per_fold(r):
                    err = test.squared_errors(*train.solve(candidates)) / test.n / _y_scale(train, target_units)[1] ** 2
                    out += [(*r[:nk], j, fold, float(v)) for j, v in enumerate(err)]
            yield pd.DataFrame(out, columns=[*keys, "candidate", "fold", "score"])

    if by_moments:
        return packed.mapInPandas(score, f"{_key_schema(rows, keys)}{_SCORE}")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for fold, train, _ in per_fold(r):
                    w, b = train.solve(candidates)
                    out += [(*r[:nk], fold, j, w[j], float(b[j]), *_y_scale(train, target_units)) for j in range(len(w))]
            yield pd.DataFrame(out, columns=[*keys, "fold", "candidate", "coef", "intercept", "y_lo", "y_unit"])

    models = packed.mapInPandas(fit, f"{_key_schema(rows, keys)}{_FOLD_MODEL}")
    # A row is tested in one fold only: find it on the short fold list.
    mine = F.filter("tm_folds", lambda f: (f["test_lo"] <= F.col("__rn") - 1) & (F.col("__rn") - 1 < f["test_hi"]))
    tests = d.withColumn("fold", F.get(mine, F.lit(0))["fold"]).filter("fold IS NOT NULL")
    return _score_rows(tests, models, [*keys, "fold"], keys, names, metric)


def _y_scale(train: Moments, target_units: bool) -> tuple[float, float]:
    """Offset and unit in which errors are scored."""
    return (0.0, 1.0) if target_units else (float(train.lo[-1]), float(train.unit[-1]))


def _score_rows(tests: DataFrame, models: DataFrame, on: Sequence[str], keys: Sequence[str], names: Sequence[str], metric: str) -> DataFrame:
    """Score fold models on their test rows; all candidates of a fold ride along."""
    cand = F.struct("candidate", "coef", "intercept", "y_lo", "y_unit")
    per_fold = models.groupBy(*on).agg(F.collect_list(cand).alias("__c"))
    d = join_on(tests.select(*on, *[col(c) for c in dict.fromkeys(names)]), small_side(per_fold), on)
    d = d.withColumn("__c", F.explode("__c"))
    unit = lambda v: (v - F.col("__c.y_lo")) / F.col("__c.y_unit")
    y = unit(col(names[-1]).cast("double"))
    p = unit(dot(F.col("__c.coef"), names[:-1]) + F.col("__c.intercept"))
    d = d.select(*on, F.col("__c.candidate").alias("candidate"), y.alias("y"), p.alias("p"))
    return d.groupBy(*on, "candidate").agg(metric_of(metric)(F.col("y"), F.col("p")).alias("score")).select(
        *keys, "candidate", "fold", "score")


@F.pandas_udf(T.LongType())
def _gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(), b.to_numpy()))


def _sliding(blocks: DataFrame, keys: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """Totals of the last `__size` blocks of a series, each with its own size.

    Blocks are cut into runs of `__size`: a window is the end of one run and the
    start of the next, so it needs one running total from either side, whatever
    its length, and sums are never taken apart again.
    """
    d = blocks.withColumn("__run", F.floor(F.col("__b") / F.col("__size")))
    run = Window.partitionBy(*[col(k) for k in keys], "__run")
    so_far = run.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    to_end = run.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({o: _FOLD[kd](F.col(o)).over(so_far) for o, kd in kinds.items()}
                      | {f"__e_{o}": _FOLD[kd](F.col(o)).over(to_end) for o, kd in kinds.items()})
    ends = d.select(*[col(k) for k in keys], (F.col("__b") + F.col("__size") - 1).alias("__b"), *[f"__e_{o}" for o in kinds])
    d = join_on(d.drop(*[f"__e_{o}" for o in kinds]), ends, [*keys, "__b"], "left")
    whole = F.col("__b") % F.col("__size") == F.col("__size") - 1
    both = {"sum": lambda x, y: x + y, "min": F.least, "max": F.greatest}
    return d.withColumns({o: F.when(whole, F.col(o)).otherwise(both[kd](F.col(o), F.col(f"__e_{o}"))) for o, kd in kinds.items()}).drop(
        "__run", "__size", *[f"__e_{o}" for o in kinds])


def _rolling(rows, s, lengths, names, shift, candidates, window, step, horizons, mode, metric, scaled, k, target_units):
    """Rolling-origin folds from running totals; never rows times folds.

    Window, step and horizons that are not given follow each series' length.
    """
    keys, p = list(s.keys), len(names)
    horizons = sorted({int(h) for h in horizons}) if horizons is not None else None
    given = lambda v: rolling_defaults(F.col("n"), k) if v is None else F.lit(v).cast("long")
    reach = rolling_defaults(F.col("n"), k) if horizons is None else F.lit(max(horizons)).cast("long")
    plan = lengths.withColumns({"__w": given(window), "__st": given(step), "__reach": reach}).filter("__w >= 1 AND __st >= 1")
    plan = small_side(plan.withColumn("__unit", _gcd("__w", "__st")).withColumnRenamed("n", "__len"))
    settings = ["__len", "__w", "__st", "__reach", "__unit"]
    parts = {o: ("sum", c) for o, c in _terms(names, shift).items()} | (_extremes(names) if scaled else {})
    d = attach(number_rows(rows, s, "__rn"), plan, keys).filter("__unit IS NOT NULL")
    d = d.withColumn("__b", F.floor((F.col("__rn") - 1) / F.col("__unit")))
    blocks = d.groupBy(*keys, "__b").agg(F.min(s.ts).alias(s.ts), *[F.first(c).alias(c) for c in settings],
                                         *[_FOLD[kd](c).alias(o) for o, (kd, c) in parts.items()])
    kinds = {o: kd for o, (kd, _) in parts.items()}
    if mode == EXPANDING:
        summed = running_totals(blocks, s, {o: (kd, F.col(o)) for o, kd in kinds.items()})
    else:
        summed = _sliding(blocks.withColumn("__size", (F.col("__w") / F.col("__unit")).cast("long")), keys, kinds)
    cut = summed.withColumn("__hi", (F.col("__b") + 1) * F.col("__unit"))
    # The last block of a series may be short; a cut-off needs all its rows.
    past = F.col("__hi") - F.col("__w")
    cut = cut.filter((past >= 0) & (past % F.col("__st") == 0) & (F.col("__hi") + F.col("__reach") <= F.col("__len")))
    cut = cut.withColumn("fold", F.floor(past / F.col("__st")))
    packed = _dealt(_packed(cut, [*keys, "fold", "__hi", "__reach"], p, scaled), [*keys, "fold"])
    at, nk = np.array(shift), len(keys)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                train = Moments(np.array(r.tm_m), at, np.array(r.tm_lo), np.array(r.tm_hi))
                w, b = train.solve(candidates)
                out += [(*r[:nk], r.fold, r[nk + 1], r[nk + 2], j, w[j], float(b[j]), *_y_scale(train, target_units)) for j in range(len(w))]
            yield pd.DataFrame(out, columns=[*keys, "fold", "cut_row", "reach", "candidate", "coef", "intercept", "y_lo", "y_unit"])

    schema = f"{_key_schema(rows, keys)}fold long, cut_row long, reach long, candidate int, coef array<double>, intercept double, y_lo double, y_unit double"
    models = packed.mapInPandas(fit, schema)
    cand = F.struct("candidate", "coef", "intercept", "y_lo", "y_unit")
    per_fold = models.groupBy(*keys, "fold", "cut_row", "reach").agg(F.collect_list(cand).alias("__c"))
    # Test rows of a fold: row number cut_row + h (rows count from 1).
    one = F.lit(1).cast("long")
    ahead = F.sequence(one, F.col("reach")) if horizons is None else F.array(*[F.lit(h).cast("long") for h in horizons])
    wanted = per_fold.withColumn("__rn", F.explode(F.transform(ahead, lambda h: F.col("cut_row") + h)))
    t = join_on(d.select(*keys, "__rn", *[col(c) for c in dict.fromkeys(names)]), wanted.drop("cut_row", "reach"), [*keys, "__rn"])
    t = t.withColumn("__c", F.explode("__c"))
    scale = lambda v: (v - F.col("__c.y_lo")) / F.col("__c.y_unit")
    t = t.select(*keys, "fold", F.col("__c.candidate").alias("candidate"), scale(col(names[-1]).cast("double")).alias("y"),
                 scale(dot(F.col("__c.coef"), names[:-1]) + F.col("__c.intercept")).alias("p"))
    return t.groupBy(*keys, "candidate", "fold").agg(metric_of(metric)(F.col("y"), F.col("p")).alias("score"))
