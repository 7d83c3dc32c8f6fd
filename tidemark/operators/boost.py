"""Boosted regression trees for many models at once.

All candidates and folds of a search grow together. A task turns its rows into
sums of gradients by (model, node, feature, bin); one aggregate adds them up,
running sums over the bins give the gain of every cut with missing values on
either side, and one row a node and column comes back: the driver holds trees,
never rows. The
number of jobs depends on rounds and depth, not on candidates times folds.

Trees are grown level by level, and then kept in the order a leaf-wise learner
would have split them: a node's gain does not depend on other nodes, so the
best-first order over the full tree is known once its levels are. Rows lie in
blocks of binned columns with the prediction of every model; blocks are written
again every `KEPT_TREES` trees, and later trees are applied on the way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.columns import col
from tidemark.operators.linear import complete_rows
from tidemark.session import written

BLOCK = 4096
# Leaves of a tree that fit a word.
BITS = 64
KEPT_TREES = 10
# Cells (model, node, feature, bin) that one pass of one wave of models may fill.
CELLS = 4_000_000
TRAINED, TESTED = 1, 2
# Names of the two adapters' parameters (fixed) and ours.
NAMES = {
    "learning_rate": "rate", "eta": "rate", "n_estimators": "rounds", "max_depth": "depth", "num_leaves": "leaves",
    "min_child_weight": "least", "min_data_in_leaf": "least", "gamma": "gain", "min_gain_to_split": "gain",
    "subsample": "rows", "bagging_fraction": "rows", "colsample_bytree": "columns", "feature_fraction": "columns",
    "lambda_l1": "l1", "reg_alpha": "l1", "lambda_l2": "l2", "reg_lambda": "l2", "max_bin": "bins", "seed": "seed",
}
DEFAULTS = {"rate": 0.3, "rounds": 100, "depth": 6, "leaves": 0, "least": 1.0, "gain": 0.0, "rows": 1.0, "columns": 1.0,
            "l1": 0.0, "l2": 0.0, "bins": 256, "seed": 0}


def settings(params: Mapping[str, Any], **defaults: Any) -> dict[str, Any]:
    """One model's parameters under our names; unknown names raise."""
    unknown = [n for n in params if n not in NAMES]
    if unknown:
        raise ValueError(f"no boosted-tree parameter {unknown}; known: {sorted(NAMES)}")
    return {**DEFAULTS, **defaults, **{NAMES[n]: v for n, v in params.items()}}


def _draw(*numbers: Any) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes of whole numbers, broadcast together."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for n in numbers:
            h = np.asarray(h ^ np.asarray(n).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)) / float(1 << 53)


@dataclass
class Tree:
    """Nodes from the root down: a node's children are `left` and the next; a feature of -1 is a leaf.

    `heap` numbers a node by its place in a full tree (root 1, children 2i and 2i + 1).
    """

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    left: np.ndarray
    heap: np.ndarray

    @cached_property
    def masks(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The leaves, and for each feature cut the leaves that a value's bin leaves
        open, as bits (Lucchese et al. 2015); of at most `BITS` leaves."""
        leaves = np.flatnonzero(self.feature < 0)
        under = [0] * len(self.feature)
        for i, k in enumerate(leaves):
            under[k] = 1 << i
        inner = np.flatnonzero(self.feature >= 0)
        for k in inner[::-1]:
            under[k] = under[self.left[k]] | under[self.left[k] + 1]
        tables = []
        for f in np.unique(self.feature[inner]):
            mine = inner[self.feature[inner] == f]
            bins = np.arange(-1, self.cut[mine].max() + 2)
            open_ = np.full(len(bins), under[0], np.uint64)
            for k in mine:
                left = np.where(bins < 0, self.missing_left[k], bins <= self.cut[k])
                open_ &= np.where(left, np.uint64(under[0] ^ under[self.left[k] + 1]), np.uint64(under[0] ^ under[self.left[k]]))
            tables.append((int(f), open_))
        return leaves, tables

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        if len(self.feature) < 2 * BITS:
            leaves, tables = self.masks
            if not tables:
                return np.zeros(len(bins), np.int64)
            # One leaf is open in all of them, so its bit is a power of two.
            found = reduce(np.bitwise_and, (t.take(bins[:, f], mode="clip") for f, t in tables))
            return leaves.take(np.frexp(found.astype(float))[1] - 1)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            b = bins[rows, np.maximum(f, 0)].astype(np.int64) - 1  # -1: missing
            left = np.where(b < 0, self.missing_left[at], b <= self.cut[at])
            at = np.where(inner, self.left[at] + ~left, at)


@dataclass
class Boosted:
    """Models over the same columns: edges of their bins, bases, trees."""

    cols: list[str]
    edges: list[np.ndarray]
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)

    def only(self, model: int) -> Boosted:
        return Boosted(self.cols, self.edges, [self.base[model]], [self.trees[model]])

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins from 1, 0 where a value is missing."""
        out = np.zeros(x.shape, np.uint16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left") + 1)
        return out

    def predictions(self, bins: np.ndarray, model: int) -> np.ndarray:
        out = np.full(len(bins), self.base[model])
        for t in self.trees[model]:
            out += t.value[t.nodes(bins)]
        return out


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int = 256) -> list[np.ndarray]:
    """Upper ends of all bins but the last, one pass for all columns: a column of
    few values has one bin a value, others about equal numbers of rows a bin."""
    if not cols:
        return []
    at = [k / bins for k in range(1, bins)]
    known = [F.nanvl(col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    row = df.agg(*[F.percentile_approx(v, at, 100 * bins).alias(f"q{i}") for i, v in enumerate(known)],
                 *[F.max(v).alias(f"m{i}") for i, v in enumerate(known)]).first()
    # The largest value ends no bin: a cut there would leave nothing on the right.
    return [np.array(sorted({v for v in row[f"q{i}"] or () if v < row[f"m{i}"]}), float) for i in range(len(cols))]


def _blocks(df: DataFrame, target: str, cols: Sequence[str], shape: Boosted, marks: Column, row_id: Column) -> DataFrame:
    """Blocks of rows: binned columns, target, marks of folds, row ids, no predictions yet."""
    x = [col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    d = df.select(*x, col(target).cast("double").alias("y"), marks.alias("marks"), row_id.alias("id"))
    schema = "n int, bins binary, y binary, marks binary, id binary, pred binary"
    p = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                x = np.array([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)], float).reshape(p, b.num_rows).T
                marks = b.column("marks").flatten().to_numpy(zero_copy_only=False).astype(np.int8)
                ids = b.column("id").to_numpy(zero_copy_only=False)
                parts = [shape.binned(x), b.column("y").to_numpy(zero_copy_only=False).astype(float), marks, ids.astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.num_rows], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in parts], pa.array([b""], pa.binary())],
                    ["n", "bins", "y", "marks", "id", "pred"])

    return d.mapInArrow(run, schema)


@dataclass
class Wave:
    """The models that grow together, and what a task needs to know of them."""

    shape: Boosted
    settings: list[dict[str, Any]]
    fold: list[int]            # column of marks a model trains on
    pending: list[list[Tree]]  # trees not yet in the blocks' predictions

    def open(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """bins, y, marks, ids and the current predictions of all models."""
        p, m = len(self.shape.cols), len(self.fold)
        for r in batch.to_pylist():
            n = r["n"]
            bins, y = np.frombuffer(r["bins"], np.uint16).reshape(n, p), np.frombuffer(r["y"])
            marks, ids = np.frombuffer(r["marks"], np.int8).reshape(n, -1), np.frombuffer(r["id"], np.int64)
            pred = np.frombuffer(r["pred"]).reshape(m, n).copy() if r["pred"] else np.repeat(np.array(self.shape.base)[:, None], n, 1)
            for k, trees in enumerate(self.pending):
                for t in trees:
                    pred[k] += t.value[t.nodes(bins)]
            yield bins, y, marks, ids, pred

    def drawn(self, model: int, tree: int, ids: np.ndarray) -> np.ndarray:
        s = self.settings[model]
        return np.ones(len(ids), bool) if s["rows"] >= 1 else _draw(s["seed"], model, tree, ids) < s["rows"]

    def columns(self, model: int, tree: int) -> list[int]:
        """The columns of a tree: at least one."""
        s, p = self.settings[model], len(self.shape.cols)
        keep = max(1, int(np.ceil(s["columns"] * p - 1e-9)))
        return sorted(np.argsort(_draw(s["seed"], model, tree, 10_007 + np.arange(p)), kind="stable")[:keep].tolist())


HISTOGRAM = "model int, node int, feature int, bin int, g double, n long"


def _histograms(blocks: DataFrame, wave: Wave, growing: Mapping[int, Tree], tree: int, depth: int) -> DataFrame:
    """Sums of gradients (prediction less target) and rows by model, node, feature and bin of one level."""
    p = len(wave.shape.cols)
    width = max((len(e) for e in wave.shape.edges), default=0) + 2
    level = {m: np.flatnonzero(t.heap >= 1 << depth) for m, t in growing.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {m: np.zeros((2, len(at), p, width)) for m, at in level.items()}
        place = {m: np.full(len(t.heap), -1) for m, t in growing.items()}
        for m, at in level.items():
            place[m][at] = np.arange(len(at))
        for batch in batches:
            for bins, y, marks, ids, pred in wave.open(batch):
                for m, t in growing.items():
                    use = np.flatnonzero((marks[:, wave.fold[m]] == TRAINED) & wave.drawn(m, tree, ids))
                    node = place[m][t.nodes(bins[use])]
                    use, node = use[node >= 0], node[node >= 0]
                    g = pred[m][use] - y[use]
                    shape = len(level[m]), width
                    for f in range(p):
                        at = node * width + bins[use, f]
                        cells[m][0, :, f] += np.bincount(at, g, shape[0] * width).reshape(shape)
                        cells[m][1, :, f] += np.bincount(at, minlength=shape[0] * width).reshape(shape)
        for m, (g, n) in ((m, c.reshape(2, -1)) for m, c in cells.items()):
            at = np.flatnonzero(n)
            node, rest = np.divmod(at, p * width)
            columns = [np.full(len(at), m), growing[m].heap[level[m][node]], rest // width, rest % width - 1]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], pa.array(g[at]), pa.array(n[at].astype(np.int64))],
                                             ["model", "node", "feature", "bin", "g", "n"])

    # A task sends a cell once, so cells go straight to where the windows want them.
    part = blocks.mapInArrow(run, HISTOGRAM).repartition("model", "node", "feature")
    return part.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


CUT = ("model int, node int, feature int, g_all double, n_all long, cut int, missing_left boolean, gain double, "
       "g_left double, n_left long")


def best_cuts(cells: DataFrame, wave: Wave, models: Sequence[int], tree: int) -> DataFrame:
    """One row a (model, node, feature): `g_all`, `n_all`, and the best cut allowed, `cut`
    (values up to the upper end of this bin go left), `missing_left`, `gain`, and the sums
    on its left, `g_left` and `n_left`. Cells of a feature lie in one task.
    """
    rows = {m: wave.settings[m] for m in models}
    top = max(rows) + 1
    param = {k: np.array([float(rows[m][k]) if m in rows else 0.0 for m in range(top)]) for k in ("least", "gain", "l1", "l2", "bins")}
    sizes = np.array([len(e) + 1 for e in wave.shape.edges], np.int64)
    use = np.zeros((top, len(sizes)), bool)
    for m in rows:
        use[m, wave.columns(m, tree)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=schema)  # a share of at most `CELLS` cells
        v = {c: t[c].to_numpy() for c in t.column_names}
        order = np.lexsort((v["bin"], v["feature"], v["node"], v["model"]))
        model, node, feature, bins, g, n = (v[c][order] for c in ("model", "node", "feature", "bin", "g", "n"))
        if not len(order):
            return
        key = np.stack([model, node, feature])
        start = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(g))))

        def so_far(x: np.ndarray) -> np.ndarray:
            total = np.cumsum(x)
            return total - (total[start] - x[start])[group]

        g_all, n_all = np.add.reduceat(g, start)[group], np.add.reduceat(n, start)[group]
        missing = bins[start] < 0
        gm, nm = np.where(missing, g[start], 0.0)[group], np.where(missing, n[start], 0)[group]
        gl, nl = so_far(g), so_far(n)
        least, floor, l1, l2, most = (param[k][model] for k in ("least", "gain", "l1", "l2", "bins"))

        def score(x: np.ndarray, k: np.ndarray) -> np.ndarray:
            return np.maximum(np.abs(x) - l1, 0) ** 2 / np.where(k + l2 > 0, k + l2, 1)

        size = sizes[feature]
        told = np.minimum(size, most)
        cut = (bins >= 0) & use[model, feature] & (np.floor((bins + 1) * told / size) > np.floor(bins * told / size))
        best = np.full(len(g), -np.inf)
        left = np.zeros(len(g), bool)
        # Without missing values the two sides are one option.
        for to_left, x, k in ((True, gl, nl), (False, gl - gm, nl - nm)):
            gain = (score(x, k) + score(g_all - x, n_all - k) - score(g_all, n_all)) / 2
            fits = cut & (k >= np.maximum(least, 1)) & (n_all - k >= np.maximum(least, 1)) & (gain > 0) & (gain >= floor)
            better = fits & (gain > best)
            best, left = np.where(better, gain, best), np.where(better, to_left, left)
        high = np.maximum.reduceat(best, start)
        at = np.full(len(start), len(best))
        np.minimum.at(at, group, np.where(best == high[group], np.arange(len(best)), len(best)))
        none = ~np.isfinite(high)
        x, k = np.where(left[at], gl[at], (gl - gm)[at]), np.where(left[at], nl[at], (nl - nm)[at])
        yield pa.RecordBatch.from_arrays(
            [pa.array(model[start]), pa.array(node[start]), pa.array(feature[start]), pa.array(g_all[start]), pa.array(n_all[start]),
             pa.array(bins[at], mask=none), pa.array(left[at], mask=none), pa.array(high, mask=none), pa.array(x, mask=none), pa.array(k, mask=none)],
            [c.split()[0] for c in CUT.split(", ")])

    schema = to_arrow_schema(cells.schema)
    return cells.mapInArrow(run, CUT)


def _leaf_wise(found: Mapping[int, Any], leaves: int, s: Mapping[str, Any]) -> Tree:
    """The tree a leaf-wise learner with so many leaves (0: any number) would have
    grown from the cuts found, by heap number."""
    cut, waiting = set(), [(-found[1]["gain"], 1)] if 1 in found and found[1]["gain"] is not None else []
    while waiting and (not leaves or len(cut) + 1 < leaves):
        _, i = heapq.heappop(waiting)
        cut.add(i)
        for k in (2 * i, 2 * i + 1):
            if found[k]["gain"] is not None:
                heapq.heappush(waiting, (-found[k]["gain"], k))
    order = [1]
    for i in order:
        if i in cut:
            order += [2 * i, 2 * i + 1]
    at, n = {i: k for k, i in enumerate(order)}, len(order)
    t = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n, np.int64), np.array(order))
    for k, i in enumerate(order):
        r = found.get(i)
        if i in cut:
            t.feature[k], t.cut[k], t.missing_left[k], t.left[k] = r["feature"], r["cut"], r["missing_left"], at[2 * i]
        elif r is not None and r["n_all"] + s["l2"] > 0:
            t.value[k] = -s["rate"] * np.sign(r["g_all"]) * max(abs(r["g_all"]) - s["l1"], 0.0) / (r["n_all"] + s["l2"])
    return t


def _grow(blocks: DataFrame, wave: Wave, tree: int, models: Sequence[int]) -> dict[int, Tree]:
    """The next tree of each model, level by level."""
    found: dict[int, dict[int, Any]] = {m: {} for m in models}
    growing = {m: _leaf_wise({}, 0, wave.settings[m]) for m in models if wave.settings[m]["depth"] > 0}
    depth = 0
    while growing:
        rows = best_cuts(_histograms(blocks, wave, growing, tree, depth), wave, list(growing), tree).collect()
        depth, grew = depth + 1, set()
        for r in sorted(rows, key=lambda r: r["feature"]):  # of equal gains the first column's
            old = found[r["model"]].get(r["node"])
            if old is None or "feature" not in old or (r["gain"] or 0) > (old["gain"] or 0):
                found[r["model"]][r["node"]] = r.asDict()
        for m, i in {(r["model"], r["node"]) for r in rows}:
            mine, r = found[m], found[m][i]
            if r["gain"] is not None:
                grew.add(m)
                left = (r["g_left"], r["n_left"])
                for k, (g, n) in ((2 * i, left), (2 * i + 1, (r["g_all"] - left[0], r["n_all"] - left[1]))):
                    mine[k] = {"g_all": g, "n_all": n, "gain": None}
        growing = {m: _leaf_wise(found[m], 0, wave.settings[m]) for m in growing if m in grew and depth < wave.settings[m]["depth"]}
    return {m: _leaf_wise(found[m], int(wave.settings[m]["leaves"]), wave.settings[m]) for m in models}


def first_cuts(blocks: DataFrame, wave: Wave) -> DataFrame:
    """The cuts that the root of each model's first tree would take (see `best_cuts`)."""
    roots = {m: _leaf_wise({}, 0, s) for m, s in enumerate(wave.settings)}
    found = best_cuts(_histograms(blocks, wave, roots, 0, 0), wave, list(roots), 0)
    first = F.max_by(F.struct("*"), F.struct("gain", -F.col("feature")))
    return found.filter("gain IS NOT NULL").groupBy("model", "node").agg(first.alias("o")).select("o.*")


def _kept(blocks: DataFrame, wave: Wave) -> DataFrame:
    """The blocks with the pending trees in their predictions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred = pa.array([p.tobytes() for *_, p in wave.open(batch)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("pred"), "pred", pred)

    return blocks.mapInArrow(run, blocks.schema)


def _bases(blocks: DataFrame, folds: int) -> list[float]:
    """Mean target of the rows each fold trains on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, folds))
        for batch in batches:
            for r in batch.to_pylist():
                used = np.frombuffer(r["marks"], np.int8).reshape(r["n"], -1) == TRAINED
                total += [np.frombuffer(r["y"]) @ used, used.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array(total[0]), pa.array(total[1])], ["fold", "s", "n"])

    rows = blocks.mapInArrow(run, "fold int, s double, n double").groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    mean = {r["fold"]: r["s"] / r["n"] if r["n"] else 0.0 for r in rows}
    return [mean.get(f, 0.0) for f in range(folds)]


def fit_many(df: DataFrame, target: str, cols: Sequence[str], params: Sequence[Mapping[str, Any]], marks: Column | None = None,
             folds: int = 1, row_id: Column | None = None, **defaults: Any) -> tuple[Boosted, DataFrame]:
    """All candidates on all folds: (models, blocks of rows).

    `marks` is an array with one entry a fold (`TRAINED`, `TESTED` or 0); where
    not given there is one fold that trains on every row. Model
    c * folds + f is candidate c on fold f. Missing features take part, rows
    without a target do not. `row_id` feeds the row samples. Waves of models
    bound what a pass sums up; their number is all that grows with the models.
    """
    every = [settings(p, **defaults) for p in params]
    rows = complete_rows(df, [target])
    edges = bin_edges(rows, cols, max(int(s["bins"]) for s in every))
    shape = Boosted(list(cols), edges, [])
    marks = F.array(F.lit(TRAINED).cast("tinyint")) if marks is None else marks
    row_id = F.xxhash64(*[col(c) for c in (*cols, target)]) if row_id is None else row_id
    blocks = written(_blocks(rows, target, cols, shape, marks, row_id), "boost-rows")
    means = _bases(blocks, folds)
    models = [(s, f) for s in every for f in range(folds)]
    out = Boosted(list(cols), edges, [means[f] for _, f in models], [[] for _ in models])
    width = max(1, len(cols)) * (max((len(e) for e in edges), default=0) + 2)
    deepest = max(int(s["depth"]) for s in every)
    size = max(1, CELLS // (width << min(deepest, 8)))
    for a in range(0, len(models), size):
        part = models[a: a + size]
        wave = Wave(Boosted(list(cols), edges, out.base[a: a + size]), [s for s, _ in part], [f for _, f in part], [[] for _ in part])
        now, alive = blocks, list(range(len(part)))
        rounds = max(int(s["rounds"]) for s, _ in part)
        for tree in range(rounds):
            alive = [m for m in alive if tree < int(part[m][0]["rounds"])]
            grown = _grow(now, wave, tree, alive)
            for m, t in grown.items():
                out.trees[a + m].append(t)
                wave.pending[m].append(t)
            if (tree + 1) % KEPT_TREES == 0 and tree + 1 < rounds:
                now = written(_kept(now, wave), "boost-rows")
                wave.pending = [[] for _ in part]
    return out, blocks


def tested(models: Boosted, blocks: DataFrame, folds: int) -> DataFrame:
    """model, actual, predicted of every row in the folds that test it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(models.cols)
        for batch in batches:
            for r in batch.to_pylist():
                bins = np.frombuffer(r["bins"], np.uint16).reshape(r["n"], p)
                y, marks = np.frombuffer(r["y"]), np.frombuffer(r["marks"], np.int8).reshape(r["n"], -1)
                for m in range(len(models.base)):
                    at = np.flatnonzero(marks[:, m % folds] == TESTED)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), m, np.int32)), pa.array(y[at]),
                                                          pa.array(models.predictions(bins[at], m))], ["model", "actual", "predicted"])

    return blocks.mapInArrow(run, "model int, actual double, predicted double")


def predict(models: Boosted, df: DataFrame, model: int = 0, out: str = "predicted") -> DataFrame:
    """A prediction for every row, also where features are missing."""
    one = models.only(model)
    shared = df.sparkSession.sparkContext.broadcast(one)

    @F.pandas_udf(T.DoubleType())
    def guess(x: pd.DataFrame) -> pd.Series:
        m = shared.value
        return pd.Series(m.predictions(m.binned(x.to_numpy(float)[:, 1:]), 0))

    # A struct of no columns has no rows, so there is one more.
    return df.withColumn(out, guess(F.struct(F.lit(0.0).alias("x"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(models.cols)])))
