"""Kalman filter of ARIMA errors over grid steps, as a scan over slices.

A step of the filter is an element (A, b, C, eta, J) of an associative product
(Särkkä and García-Fernández 2021), so the steps of a slice can be multiplied
before anyone knows the state the slice starts from. Slices of `SLICE_STEPS`
steps are multiplied in the tasks, all slices of a batch in step; products of
`FAN` neighbours are combined level by level, and states go back down the same
levels. A step without an observation only moves the state, so holes need no
values. No task holds a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.columns import attach, col, join_on
from tidemark.operators.linear import _key_schema
from tidemark.session import written

SLICE_STEPS = 1024
FAN = 1024
# Variance of a level before anything is seen, in units of the innovation's.
DIFFUSE = 1e8
ELEMENT = ("A", "b", "C", "eta", "J")
MODEL = ("p", "d", "q", "ar", "ma", "mean")


def difference_weights(d: int) -> list[float]:
    """Weights of lags 0..d in the d-th difference."""
    return [(-1.0) ** k * math.comb(d, k) for k in range(d + 1)]


def size_of(p: int, d: int, q: int) -> int:
    return max(p, q + 1) + max(d, 1)


def transition(ar: Sequence[float], d: int, ma: Sequence[float], mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(F, c, g, at): the state moves as x' = F x + c + g e and its entry `at` is the level.

    The first entries are the ARMA state, the rest the last levels.
    """
    p, q = len(ar), len(ma)
    at, n = max(p, q + 1), size_of(p, d, q)
    f, c, g = np.zeros((n, n)), np.zeros(n), np.zeros(n)
    f[:p, 0] = ar
    f[np.arange(at - 1), np.arange(1, at)] = 1.0
    g[0], g[1: q + 1] = 1.0, ma
    f[at, :at] = f[0, :at]
    f[at, at: at + d] = [-w for w in difference_weights(d)[1:]]
    f[np.arange(at + 1, n), np.arange(at, n - 1)] = 1.0
    c[at], g[at] = mean, 1.0
    return f, c, g, at


def before(ar: Sequence[float], d: int, ma: Sequence[float], mean: float, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the state before the first step."""
    f, _, g, at = transition(ar, d, ma, mean)
    t, r = f[:at, :at], np.outer(g[:at], g[:at])
    m, v = np.zeros(len(f)), np.zeros(f.shape)
    v[:at, :at] = np.linalg.solve(np.eye(at * at) - np.kron(t, t), r.ravel()).reshape(at, at)
    if d:
        m[at:] = level
        v[range(at, len(f)), range(at, len(f))] = DIFFUSE
    return m, v


class Batch:
    """The models of several slices, padded to one size, and their products or states."""

    def __init__(self, models: Sequence[tuple], n: int):
        k = len(models)
        self.f, self.c, self.q, self.at = np.zeros((k, n, n)), np.zeros((k, n)), np.zeros((k, n, n)), np.zeros(k, int)
        for i, (ar, d, ma, mean) in enumerate(models):
            f, c, g, at = transition(ar, d, ma, mean)
            m = len(f)
            self.f[i, :m, :m], self.c[i, :m], self.q[i, :m, :m], self.at[i] = f, c, np.outer(g, g), at
        rows = np.arange(k)
        self.h, self.mean = self.f[rows, self.at], self.c[rows, self.at]
        # The level's innovation has variance 1, so an observed level fixes it.
        self.gain = self.q[rows, :, self.at]
        self.A = np.broadcast_to(np.eye(n), (k, n, n)).copy()
        self.b, self.eta = np.zeros((k, n)), np.zeros((k, n))
        self.C, self.J = np.zeros((k, n, n)), np.zeros((k, n, n))

    def start(self, mean: np.ndarray, cov: np.ndarray) -> None:
        """From here on states are kept: a product whose A is zero."""
        self.A[:], self.b, self.C = 0, mean.copy(), cov.copy()

    def expected(self) -> np.ndarray:
        """The level of the next step."""
        return np.einsum("kn,kn->k", self.h, self.b) + self.mean

    def step(self, y: np.ndarray, live: np.ndarray) -> None:
        """Multiply one step; NaN is a missing level, slices not `live` stay."""
        seen = ~np.isnan(y)
        h = np.where(seen[:, None], self.h, 0.0)
        r = np.where(seen, np.nan_to_num(y) - self.mean, 0.0)
        g = np.einsum("kij,kj->ki", self.C, h)
        den = 1 + np.einsum("ki,ki->k", h, g)
        ah = np.einsum("kij,ki->kj", self.A, h)
        off = (r - np.einsum("ki,ki->k", h, self.b)) / den
        eta, j = self.eta + ah * off[:, None], self.J + ah[:, :, None] * ah[:, None, :] / den[:, None, None]
        b = self.b + g * off[:, None]
        a = self.A - g[:, :, None] * ah[:, None, :] / den[:, None, None]
        c = self.C - g[:, :, None] * g[:, None, :] / den[:, None, None]
        gain = np.where(seen[:, None], self.gain, 0.0)
        move = self.f - gain[:, :, None] * h[:, None, :]
        b = np.einsum("kij,kj->ki", move, b) + self.c + gain * r[:, None]
        c = move @ c @ move.transpose(0, 2, 1) + self.q - gain[:, :, None] * self.gain[:, None, :]
        a = move @ a
        keep = live[:, None]
        self.b, self.eta = np.where(keep, b, self.b), np.where(keep, eta, self.eta)
        wide = keep[:, :, None]
        self.A, self.C, self.J = np.where(wide, a, self.A), np.where(wide, c, self.C), np.where(wide, j, self.J)


def combine(left: Sequence[np.ndarray], right: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The product of two elements, the earlier one first."""
    a1, b1, c1, e1, j1 = left
    a2, b2, c2, e2, j2 = right
    eye = np.eye(len(a1))
    m = a2 @ np.linalg.inv(eye + c1 @ j2)
    w = a1.T @ np.linalg.inv(eye + j2 @ c1)
    return m @ a1, m @ (b1 + c1 @ e2) + b2, m @ c1 @ a2.T + c2, w @ (e2 - j2 @ b1) + e1, w @ j2 @ a1 + j1


def advance(state: Sequence[np.ndarray], element: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The state (mean, covariance) after an element."""
    m, v = state
    a, b, c, eta, j = element
    w = a @ np.linalg.inv(np.eye(len(m)) + v @ j)
    return w @ (m + v @ eta) + b, w @ v @ a.T + c


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list[dict[str, Any]], list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows of a batch without their lists, and the lists `g`, `v` of each as arrays."""
    plain = [n for n in batch.schema.names if n not in ("g", "v")]
    rows = batch.select(plain).to_pylist()
    lists = []
    offsets = batch.column("g").offsets.to_numpy()
    g, v = batch.column("g").values.to_numpy(), batch.column("v").values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:]):
        order = np.argsort(g[a:b], kind="stable")
        lists.append((g[a:b][order], v[a:b][order]))
    yield rows, lists


def _run(rows: list[dict[str, Any]], lists: list[tuple[np.ndarray, np.ndarray]], states: bool) -> tuple[Batch, list[np.ndarray]]:
    """Multiply the steps of each slice, all slices in step; expected levels where states are kept."""
    models = [(r["ar"], r["d"], r["ma"], r["mean"]) for r in rows]
    n = max(size_of(len(ar), d, len(ma)) for ar, d, ma, _ in models)
    batch = Batch(models, n)
    if states:
        mean, cov = np.zeros((len(rows), n)), np.zeros((len(rows), n, n))
        for i, r in enumerate(rows):
            m = len(r["m"])
            mean[i, :m], cov[i, :m, :m] = r["m"], np.reshape(r["cov"], (m, m))
        batch.start(mean, cov)
    steps = [int(r["hi"] - r["lo"] + 1) for r in rows]
    level = np.full((len(rows), max(steps)), np.nan)
    for i, (g, v) in enumerate(lists):
        level[i, g - rows[i]["lo"]] = v
    guesses = np.full(level.shape, np.nan)
    for t in range(level.shape[1]):
        if states:
            guesses[:, t] = batch.expected()
        batch.step(level[:, t], t < np.array(steps))
    return batch, [guesses[i, g - rows[i]["lo"]] for i, (g, _) in enumerate(lists)]


class Scan:
    """Levels `v` of series at grid steps `g`, sliced, with the products of the slices.

    `levels`: keys, g, v (observed steps only); `model`: keys and `MODEL`, one
    row a series. Steps between the first and the last that are absent are holes.
    """

    def __init__(self, levels: DataFrame, model: DataFrame, keys: Sequence[str]):
        self.keys = list(keys)
        m = model.select(*[col(k) for k in keys], *MODEL)
        at = F.floor(F.col("g") / SLICE_STEPS).alias("i")
        ends = levels.groupBy(*[col(k) for k in keys]).agg(
            F.min("g").alias("from"), F.max("g").alias("to"), F.min_by("v", "g").alias("first"))
        m = attach(m, ends, self.keys).filter("ar IS NOT NULL AND `from` IS NOT NULL")
        whole = m.select("*", F.explode(F.sequence(F.floor(F.col("from") / SLICE_STEPS), F.floor(F.col("to") / SLICE_STEPS))).alias("i"))
        lo, hi = F.greatest("from", F.col("i") * SLICE_STEPS), F.least("to", F.col("i") * SLICE_STEPS + SLICE_STEPS - 1)
        whole = whole.withColumns({"lo": lo, "hi": hi})
        gathered = levels.groupBy(*[col(k) for k in keys], at).agg(F.collect_list("g").alias("g"), F.collect_list("v").alias("v"))
        none = {"g": F.array().cast("array<long>"), "v": F.array().cast("array<double>")}
        joined = join_on(whole, gathered, [*self.keys, "i"], "left")
        self.slices = written(joined.select(*[col(k) for k in self.keys], *MODEL, "first", "i", "lo", "hi", *[
            F.coalesce(c, e).alias(c) for c, e in none.items()]), "slices")
        self.levels = [written(self._products(), "products")]
        while not self.levels[-1].filter("i <> 0").isEmpty():
            self.levels.append(written(self._combined(self.levels[-1]), "products"))

    def _schema(self, rest: str) -> str:
        return _key_schema(self.slices, self.keys) + rest

    def _element_schema(self) -> str:
        return self._schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.slices.schema if f.name in MODEL)}, first double, "
                            "i long, " + ", ".join(f"{e} array<double>" for e in ELEMENT))

    def _products(self) -> DataFrame:
        names = [*self.keys, *MODEL, "first", "i"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, lists in _batches(batch):
                    if not rows:
                        continue
                    b, _ = _run(rows, lists, False)
                    out = {n: batch.column(n) for n in names}
                    sizes = [size_of(r["p"], r["d"], r["q"]) for r in rows]
                    for e in ELEMENT:
                        x = getattr(b, e)
                        cut = [x[k, :m] if x.ndim == 2 else x[k, :m, :m] for k, m in enumerate(sizes)]
                        out[e] = pa.array([y.ravel() for y in cut], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_pydict(out)

        return self.slices.mapInArrow(run, self._element_schema())

    def _combined(self, level: DataFrame) -> DataFrame:
        """Products of `FAN` neighbours."""
        group = level.groupBy(*[col(k) for k in self.keys], F.floor(F.col("i") / FAN).alias("j")).agg(
            *[F.first(c).alias(c) for c in (*MODEL, "first")],
            F.array_sort(F.collect_list(F.struct("i", *ELEMENT))).alias("es"))
        names, kind = [*self.keys, *MODEL, "first"], to_arrow_schema(level.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, out = batch.select([*names, "j", "es"]).to_pylist(), []
                for r in rows:
                    total = None
                    for e in r.pop("es"):
                        e = _element(e)
                        total = e if total is None else combine(total, e)
                    out.append({**r, "i": r.pop("j"), **{n: x.ravel().tolist() for n, x in zip(ELEMENT, total)}})
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)

        return group.mapInArrow(run, self._element_schema())

    def last_states(self) -> DataFrame:
        """keys, state: the mean of the state after the last step of each series."""
        keys = self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                ends = [advance(before(r["ar"], r["d"], r["ma"], r["mean"], r["first"]), _element(r))[0].tolist() for r in rows]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(ends, pa.list_(pa.float64()))],
                                                 [*keys, "state"])

        return self.levels[-1].mapInArrow(run, self._schema("state array<double>"))

    def _starts(self) -> DataFrame:
        """keys, i, m, cov: the state before each slice, from the top level down."""
        keys, schema = self.keys, self._schema("i long, m array<double>, cov array<double>")

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [before(r["ar"], r["d"], r["ma"], r["mean"], r["first"]) for r in batch.to_pylist()]
                yield states(batch, batch.column("i"), got)

        def states(batch: pa.RecordBatch, at: pa.Array, got: list) -> pa.RecordBatch:
            kind = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], at, pa.array([m.tolist() for m, _ in got], kind),
                                               pa.array([v.ravel().tolist() for _, v in got], kind)], [*keys, "i", "m", "cov"])

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, r in enumerate(batch.select(["m", "cov", "es"]).to_pylist()):
                    state, got = (np.array(r["m"]), np.reshape(r["cov"], (len(r["m"]),) * 2)), []
                    for e in r["es"]:
                        got.append(state)
                        state = advance(state, _element(e))
                    one = batch.slice(k, 1).take(pa.array([0] * len(got)))
                    yield states(one, pa.array([e["i"] for e in r["es"]], pa.int64()), got)

        top = self.levels[-1].mapInArrow(first, schema)
        for level in reversed(self.levels[:-1]):
            group = level.groupBy(*[col(k) for k in keys], F.floor(F.col("i") / FAN).alias("i")).agg(
                F.array_sort(F.collect_list(F.struct("i", *ELEMENT))).alias("es"))
            top = join_on(top, group, [*keys, "i"]).select(*[col(k) for k in keys], "m", "cov", "es").mapInArrow(down, schema)
        return top

    def one_step(self, out: str = "expected") -> DataFrame:
        """keys, g, `out`: the level expected at each observed step from those before it."""
        keys, work = self.keys, join_on(self.slices, self._starts(), [*self.keys, "i"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, lists in _batches(batch):
                    if not rows:
                        continue
                    _, guesses = _run(rows, lists, True)
                    of = pa.array(np.repeat(np.arange(len(rows)), [len(g) for g, _ in lists]))
                    yield pa.RecordBatch.from_arrays([
                        *[batch.column(k).take(of) for k in keys], pa.array(np.concatenate([g for g, _ in lists])),
                        pa.array(np.concatenate(guesses))], [*keys, "g", out])

        return work.mapInArrow(run, self._schema(f"g long, {out} double"))


def _element(r: Any) -> tuple[np.ndarray, ...]:
    n = len(r["b"])
    return tuple(np.reshape(np.array(r[e]), (n, n) if e in ("A", "C", "J") else n) for e in ELEMENT)
