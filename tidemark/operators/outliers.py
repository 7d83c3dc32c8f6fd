"""Tukey fences, z-scores and an isolation forest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from tidemark.columns import attach, col
from tidemark.session import TRAIN, written

# Fixed names and limits of the outlier step.
METHODS = (None, "boxplot", "zscore", "isolationforest")
MAX_REMOVED_SHARE = 0.3
EULER_GAMMA = 0.5772156649015329


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    group_rows: int = 1_000_000, accuracy: int = 50_000) -> DataFrame:
    """Linear-interpolated quantiles `q` (array, one per probability) per group.

    Each group goes its own way by its own size: one that fits in a task uses
    `percentile`. For a larger one a sketch first brackets each wanted rank,
    one pass counts the rows below the bracket, and only the distinct values
    inside it are ranked exactly. There are at most rows / `group_rows` such groups.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    v = df.select(*keys, col(value).cast("double").alias("tm_v")).filter("tm_v IS NOT NULL AND NOT isnan(tm_v)")
    exact = lambda d: d.groupBy(*keys).agg(F.percentile("tm_v", F.array(*map(F.lit, probs))).alias("q"))
    large = v.groupBy(*keys).count().filter(F.col("count") > group_rows)
    if large.isEmpty():
        return exact(v)
    if keys:
        marked = attach(v, large.select(*keys, F.lit(True).alias("tm_large")), keys)
        few = exact(marked.filter("tm_large IS NULL").drop("tm_large"))
        v = marked.filter("tm_large").drop("tm_large")
    else:
        few = None
    # The bracket is at least two ranks wide on either side.
    slack = 2.0 / min(accuracy, group_rows)
    edges = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    rough = v.groupBy(*keys).agg(F.percentile_approx("tm_v", edges, accuracy).alias("tm_e"), F.count(F.lit(1)).alias("tm_n"))
    d = attach(v, rough, keys)
    m = len(probs)
    low = [F.lit(float("-inf")) if p <= slack else F.col("tm_e")[k] for k, p in enumerate(probs)]
    high = [F.lit(float("inf")) if p >= 1 - slack else F.col("tm_e")[m + k] for k, p in enumerate(probs)]
    below = d.groupBy(*keys).agg(
        F.first("tm_n").alias("tm_n"), F.array(*[F.count_if(F.col("tm_v") < low[k]) for k in range(m)]).alias("tm_below"))
    inside = F.array_compact(F.array(*[
        F.when(F.col("tm_v").between(low[k], high[k]), F.lit(k)) for k in range(m)]))
    seen = d.select(*keys, "tm_v", F.explode(inside).alias("tm_k")).groupBy(*keys, "tm_k", "tm_v").count()
    upto = Window.partitionBy(*keys, "tm_k").orderBy("tm_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = attach(seen.withColumn("tm_upto", F.sum("count").over(upto)), below, keys)
    ranked = ranked.withColumn("tm_upto", F.col("tm_upto") + F.col("tm_below")[F.col("tm_k")])
    at = F.element_at(F.array(*map(F.lit, probs)), F.col("tm_k") + 1) * (F.col("tm_n") - 1)
    ranked = ranked.withColumns({"tm_at": at, "tm_r": F.floor(at)})
    pair = ranked.groupBy(*keys, "tm_k").agg(
        F.min(F.when(F.col("tm_upto") > F.col("tm_r"), F.col("tm_v"))).alias("tm_a"),
        F.min(F.when(F.col("tm_upto") > F.col("tm_r") + 1, F.col("tm_v"))).alias("tm_b"),
        F.first(F.col("tm_at") - F.col("tm_r")).alias("tm_part"))
    q = F.col("tm_a") + F.when(F.col("tm_part") > 0, F.col("tm_part") * (F.col("tm_b") - F.col("tm_a"))).otherwise(0.0)
    rows = pair.select(*keys, F.struct("tm_k", q.alias("q")).alias("tm_kq"))
    many = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("tm_kq")), lambda e: e["q"]).alias("q"))
    return many if few is None else few.unionByName(many)


def boxplot_limits(df: DataFrame, keys: Sequence[str], value: str, group_rows: int = 1_000_000) -> DataFrame:
    """Tukey fences 1.5 inter-quartile ranges outside the quartiles."""
    q = exact_quantiles(df, keys, value, (0.25, 0.75), group_rows)
    iqr = F.col("q")[1] - F.col("q")[0]
    return q.select(*keys, (F.col("q")[0] - 1.5 * iqr).alias("lower"), (F.col("q")[1] + 1.5 * iqr).alias("upper"))


def column_fences(df: DataFrame, cols: Sequence[str], group_rows: int = 1_000_000) -> dict[str, tuple[float, float]]:
    """Tukey fences of several columns over the whole table, together if it is
    small enough for exact percentiles in one aggregate."""
    if df.limit(group_rows + 1).count() <= group_rows:
        quartiles = F.array(F.lit(0.25), F.lit(0.75))
        clean = [F.when(~F.isnan(v), v) for v in (col(c).cast("double") for c in cols)]
        row = df.agg(*[F.percentile(v, quartiles) for v in clean]).first()
        found = {c: q for c, q in zip(cols, row) if q is not None}
    else:
        rows = {c: exact_quantiles(df, (), c, (0.25, 0.75), group_rows).first() for c in cols}
        found = {c: r["q"] for c, r in rows.items() if r is not None}
    return {c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in found.items()}


def _train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == TRAIN) if "split" in df.columns else df


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])


def flag_outliers(df: DataFrame, method: str, cols: Sequence[str], z: float = 3.0,
                  id_cols: Sequence[str] = (), **forest) -> DataFrame:
    """Add a boolean `is_outlier`; limits come from the train part."""
    if method == "boxplot":
        limits = column_fences(_train(df), cols)
        outside = [(col(c) < lower) | (col(c) > upper) for c, (lower, upper) in limits.items()]
        return df.withColumn("is_outlier", _any(outside) if outside else F.lit(False))
    if method == "zscore":
        row = _train(df).agg(*[f(col(c)) for c in cols for f in (F.avg, F.stddev_pop)]).first()
        far = [F.abs(col(c) - row[2 * i]) > z * row[2 * i + 1] for i, c in enumerate(cols) if row[2 * i + 1]]
        return df.withColumn("is_outlier", _any(far) if far else F.lit(False))
    if method == "isolationforest":
        return IsolationForest.fit(_train(df), cols, id_cols, **forest).transform(df)
    raise ValueError(f"unknown outlier method {method!r}; known: {METHODS}")


def remove_outliers(df: DataFrame, method: str | None, cols: Sequence[str], seq_len: int = 6,
                    seq_sampling: int = 1, **options) -> DataFrame:
    """Drop flagged train rows, unless they are 30 % of train or more, or too few
    rows would remain for sequences. Other splits are never filtered."""
    if method is None:
        return df
    flagged = flag_outliers(df, method, cols, **options)
    train = F.col("split") == TRAIN if "split" in df.columns else F.lit(True)
    if method == "isolationforest":
        # Scoring is costly: rows are scored once, and counted while they are written.
        seen = Observation()
        flagged = written(flagged.observe(seen, F.count_if(train).alias("total"), F.count_if(train & F.col("is_outlier")).alias("out")), "outliers")
        total, out = seen.get["total"], seen.get["out"]
        df = flagged.drop("is_outlier")
    else:
        total, out = flagged.filter(train).agg(F.count(F.lit(1)), F.count_if("is_outlier")).first()
    if not (out < MAX_REMOVED_SHARE * total and total - out > seq_len + seq_sampling):
        return df
    return flagged.filter(~(F.col("is_outlier") & train)).drop("is_outlier")


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + EULER_GAMMA) - 2 * (big - 1) / big))


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> dict[str, list]:
    """Random splits of a small sample as a complete tree in heap order.

    Node k has the children 2k+1 and 2k+2. Below an early leaf every split
    sends all points left, so a walk always takes `depth` steps.
    """
    inner = 2**depth - 1
    feature, cut, path = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**depth)
    todo = [(np.arange(len(x)), 0, 0)]
    while todo:
        rows, level, node = todo.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if level == depth or len(rows) <= 1 or not len(open_features):
            path[(node + 1) * 2 ** (depth - level) - 2**depth] = level + float(average_path(len(rows)))
            continue
        f = int(rng.choice(open_features))
        feature[node], cut[node] = f, rng.uniform(lo[f], hi[f])
        down = x[rows, f] <= cut[node]
        todo.append((rows[~down], level + 1, 2 * node + 2))
        todo.append((rows[down], level + 1, 2 * node + 1))
    return {"feature": feature.tolist(), "cut": cut.tolist(), "path": path.tolist()}


@dataclass(frozen=True)
class IsolationForest:
    """Trees grown on small hashed samples; rows are scored where they lie.

    `id_cols` identify a row. A hash of them picks the sample of each tree, so
    the forest depends on the seed and the data, not on partitioning.
    """

    cols: tuple[str, ...]
    trees: tuple[dict, ...]
    sample: int

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], id_cols: Sequence[str], trees: int = 100,
            sample: int = 256, seed: int = 0) -> IsolationForest:
        if not id_cols:
            raise ValueError("isolation forest needs id_cols that identify a row")
        cols = tuple(cols)
        x = df.select(*[col(c) for c in id_cols], *[col(c).cast("double").alias(f"tm_x{i}") for i, c in enumerate(cols)])
        x = x.na.drop(subset=[f"tm_x{i}" for i in range(len(cols))])
        n = x.count()
        psi = min(sample, n)
        draw = lambda *salt: (F.xxhash64(*[col(c) for c in id_cols], *map(F.lit, salt)) / F.lit(2.0**64) + 0.5)
        # A bounded pool of rows first; only the pool is offered to every tree.
        share = min(1.0, 2.0 * trees * sample / max(n, 1))
        pool = x.filter(draw(seed, -1) < share) if share < 1 else x
        rate = min(1.0, 2.0 * psi / max(n * share, 1))
        tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tm_tree")
        offered = pool.select("*", tree).withColumn("tm_u", F.xxhash64(
            *[col(c) for c in id_cols], F.lit(seed), F.col("tm_tree")) / F.lit(2.0**64) + 0.5)
        first = Window.partitionBy("tm_tree").orderBy("tm_u", *[col(c) for c in id_cols])
        # A fixed number of tasks: the samples are small, growing them is not,
        # and merging small partitions would grow all trees in one task.
        tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
        offered = offered.filter(F.col("tm_u") < rate).repartition(tasks, "tm_tree")
        taken = offered.withColumn("tm_k", F.row_number().over(first)).filter(F.col("tm_k") <= psi)
        depth = int(np.ceil(np.log2(max(psi, 2))))
        width = len(cols)

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tm_tree"].iloc[0])
            pdf = pdf.sort_values("tm_k")
            grown = _grow(pdf[[f"tm_x{i}" for i in range(width)]].to_numpy(float), depth, np.random.default_rng([seed, t]))
            return pd.DataFrame([{"tree": t, **grown}])

        schema = "tree int, feature array<int>, cut array<double>, path array<double>"
        # 100 trees of 511 numbers: a bounded model, as in any fit.
        rows = sorted(taken.groupBy("tm_tree").applyInPandas(build, schema).collect(), key=lambda r: r["tree"])
        return cls(cols, tuple({k: list(r[k]) for k in ("feature", "cut", "path")} for r in rows), psi)

    def score(self) -> Column:
        """Anomaly score in (0, 1); NULL if a value is missing."""
        trees = [(np.array(t["feature"], np.int32), np.array(t["cut"]), np.array(t["path"])) for t in self.trees]
        unit = float(average_path(self.sample)) or 1.0

        @F.pandas_udf(T.DoubleType())
        def path_score(parts: pd.DataFrame) -> pd.Series:
            x = parts.to_numpy(dtype=float)
            flat, start = x.ravel(), np.arange(len(x), dtype=np.int32) * x.shape[1]
            total = np.zeros(len(x))
            for feature, cut, path in trees:
                node = np.zeros(len(x), dtype=np.int32)
                for _ in range(len(path).bit_length() - 1):
                    right = flat.take(start + feature.take(node)) > cut.take(node)
                    node = 2 * node + 1 + right
                total += path.take(node - len(feature))
            s = pd.Series(2.0 ** (-total / len(trees) / unit))
            return s.mask(np.isnan(x).any(axis=1))

        return path_score(F.struct(*[col(c).cast("double") for c in self.cols]))

    def transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return df.withColumn("is_outlier", F.coalesce(self.score() > threshold, F.lit(False)))
