"""Regular time grids, chronological splits, imputation and sequences."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.columns import attach, epoch_micros, join_on, numeric_columns
from tidemark.operators.linear import moments
from tidemark.operators.ordered import fill, over_neighbours
from tidemark.series import Series, require_unique
from tidemark.session import TEST, TRAIN, VAL, written

FILLS = ("ffill", "bfill", "backfill")
_UNIT_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000,
                "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}
# Grid steps one task writes out.
GRID_CHUNK = 100_000


def interval_micros(every: str) -> int:
    """Length of a fixed interval such as `1 day` or `15 minutes`."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", every.lower())
    if not m or m.group(2) not in _UNIT_MICROS or int(m.group(1)) == 0:
        raise ValueError(f"not a fixed interval: {every!r}")
    return int(m.group(1)) * _UNIT_MICROS[m.group(2)]


def _step(df: DataFrame, ts: str, start: Column, steps: Column, micros: int) -> Column:
    if isinstance(df.schema[ts].dataType, T.DateType):
        day = _UNIT_MICROS["day"]
        if micros % day:
            raise ValueError("a date column needs a whole number of days")
        return F.date_add(start, (steps * (micros // day)).cast("int"))
    return start + F.expr(f"make_dt_interval(0, 0, 0, {micros} / 1000000BD)") * steps


def gap_rows(df: DataFrame, s: Series, every: str) -> DataFrame:
    """Keys and timestamps of the grid points a series lacks.

    The grid runs from the first to the last timestamp of each series. A long
    grid is cut into chunks that are spread over tasks before they are written
    out, so one series with a huge range is not expanded in one place.
    """
    micros = interval_micros(every)
    at = epoch_micros(df, s.ts)
    ends = df.groupBy(*s.keys).agg(
        F.min(s.ts).alias("__lo"), F.floor((F.max(at) - F.min(at)) / F.lit(micros)).alias("__last"))
    chunks = ends.filter("__last IS NOT NULL").select(
        *s.keys, "__lo", "__last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / GRID_CHUNK))).alias("__chunk"))
    chunks = chunks.repartition(*s.keys, "__chunk")
    first = F.col("__chunk") * GRID_CHUNK
    grid = chunks.select(*s.keys, "__lo", F.explode(
        F.sequence(first, F.least(F.col("__last"), first + (GRID_CHUNK - 1)))).alias("__i"))
    grid = grid.select(*s.keys, _step(df, s.ts, F.col("__lo"), F.col("__i"), micros).alias(s.ts))
    return join_on(grid, df.select(*s.keys, s.ts), [*s.keys, s.ts], "left_anti")


def fill_gaps(df: DataFrame, s: Series, target: str, every: str, how: str | float | int,
              check: bool = True) -> DataFrame:
    """Add the missing grid points; fill the target on the added rows only.

    Rows off the grid stay. A target that was NULL before stays NULL. Features
    are NULL on added rows. `how` is a constant or a fill direction computed
    over the whole target column. Two rows for one timestamp are an error;
    rows without a timestamp stay as they are and bound no gap.
    """
    if not s.sliced:
        return _fill_between(df, s, target, every, how)
    if check:
        require_unique(df, s)
    literal = how not in FILLS
    new = gap_rows(df, s, every).withColumn("__new", F.lit(True))
    if literal:
        new = new.withColumn(target, F.lit(how).cast(df.schema[target].dataType))
    out = df.withColumn("__new", F.lit(False)).unionByName(new, allowMissingColumns=True)
    if not literal:
        out = fill(out.withColumn("__own", F.col(target)), s, [target], how)
        out = out.withColumn(target, F.when(F.col("__new"), F.col(target)).otherwise(F.col("__own"))).drop("__own")
    return out.select(*df.columns)


def _fill_between(df: DataFrame, s: Series, target: str, every: str, how: str | float | int) -> DataFrame:
    """Gap fill of short series in one pass: each row brings along the grid
    points between itself and the row before it."""
    micros = interval_micros(every)
    w = s.window()
    upto, before = (w.rowsBetween(Window.unboundedPreceding, b) for b in (0, -1))
    # From the other end, as a frame that reaches forward is computed anew for every row.
    back = Window.partitionBy(*s.keys).orderBy(F.col(s.ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    if how == "ffill":
        value = F.last(target, ignorenulls=True).over(before)
    elif how in FILLS:
        value = F.last(target, ignorenulls=True).over(back)
    else:
        value = F.lit(how).cast(df.schema[target].dataType)
    d = df.withColumns({"__prev": F.lag(s.ts).over(w), "__lo": F.min(s.ts).over(upto), "__value": value})
    now, prev, lo = (epoch_micros(d, c) for c in (s.ts, "__prev", "__lo"))
    twice = F.raise_error(F.concat(F.lit("duplicate timestamp in series: "), F.col(s.ts).cast("string"))).cast("long")
    first = F.when(now == prev, twice).otherwise(F.floor((prev - lo) / F.lit(micros)) + 1)
    d = d.withColumns({"__a": first, "__b": F.ceil((now - lo) / F.lit(micros)) - 1})
    # Piece -1 is the row itself; the others are runs of grid points.
    pieces = F.floor((F.coalesce(F.col("__b") - F.col("__a"), F.lit(-1)) + GRID_CHUNK) / GRID_CHUNK)
    d = d.withColumn("__piece", F.explode(F.sequence(F.lit(-1).cast("long"), F.greatest(pieces, F.lit(0)) - 1)))
    start = F.col("__a") + F.col("__piece") * GRID_CHUNK
    run = F.sequence(start, F.least(F.col("__b"), start + (GRID_CHUNK - 1)))
    d = d.withColumn("__i", F.explode(F.when(F.col("__piece") < 0, F.array(F.lit(-1).cast("long"))).otherwise(run)))
    own = F.col("__i") < 0
    out = {s.ts: F.when(own, F.col(s.ts)).otherwise(_step(df, s.ts, F.col("__lo"), F.col("__i"), micros)),
           target: F.when(own, F.col(target)).otherwise(F.col("__value"))}
    return d.select(*[
        c if c in s.keys else out.get(c, F.when(own, F.col(c))).alias(c) for c in df.columns])


def split(df: DataFrame, ts: str, d1: object, d2: object, out: str = "split") -> DataFrame:
    """train before d1, val in [d1, d2), test from d2; equal dates leave val empty."""
    as_col = lambda d: d if isinstance(d, Column) else F.lit(d).cast(df.schema[ts].dataType)
    return df.withColumn(out, F.when(F.col(ts) < as_col(d1), TRAIN).when(F.col(ts) < as_col(d2), VAL).otherwise(TEST))


def default_split_dates(df: DataFrame, s: Series) -> DataFrame:
    """Per series the cuts at 70 % and 90 % of its time range, as microseconds.

    `cut1`/`cut2` are rounded up to whole microseconds, which changes no
    comparison of the form `ts < cut`.
    """
    at = epoch_micros(df, s.ts)
    r = df.groupBy(*s.keys).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    span = F.col("hi") - F.col("lo")
    return r.select(*s.keys, (F.col("hi") - F.floor(span * 3 / F.lit(10))).alias("cut1"),
                    (F.col("hi") - F.floor(span / F.lit(10))).alias("cut2"))


def split_default(df: DataFrame, s: Series, out: str = "split") -> DataFrame:
    """Split every series at its own default dates (`keys=()`: one pair for all)."""
    d = attach(df, default_split_dates(df, s), s.keys)
    at = epoch_micros(df, s.ts)
    return d.withColumn(out, F.when(at < F.col("cut1"), TRAIN).when(at < F.col("cut2"), VAL).otherwise(TEST)).drop("cut1", "cut2")


def fill_values(df: DataFrame, overrides: Mapping[str, object] | None = None, number: float = 0,
                category: str = "Not Available", s: Series | None = None) -> DataFrame:
    """Fill NULLs by column: override, else 0 for numbers and a label for text.

    An override may be a fill direction, which needs the series order `s`.
    """
    overrides = dict(overrides or {})
    directions = {c: m for c, m in overrides.items() if m in FILLS}
    for method in sorted(set(directions.values())):
        if s is None:
            raise ValueError("directional fills need a Series")
        df = fill(df, s, [c for c, m in directions.items() if m == method], method)
    constants = {}
    skip = set(directions) | (set(s.keys) | {s.ts} if s is not None else set())
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if f.name in overrides:
            constants[f.name] = overrides[f.name]
        elif isinstance(f.dataType, T.NumericType):
            constants[f.name] = number
        elif isinstance(f.dataType, T.StringType):
            constants[f.name] = category
    return df.na.fill(constants) if constants else df


def impute_fill(df: DataFrame, s: Series, method: str, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Directional fill of the features (not the target), inside each split."""
    taken = {target, s.ts, "split", *s.keys}
    cols = [c for c in (cols or df.columns) if c not in taken]
    return fill(df, s.within("split"), cols, method)


@dataclass(frozen=True)
class MeanImputer:
    """Column means of the train part; fills NULLs of every part, target included."""

    means: Mapping[str, float | None]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> MeanImputer:
        row = df.filter(F.col("split") == TRAIN).agg(*[F.avg(c).alias(c) for c in cols]).first()
        return cls({c: row[c] for c in cols})

    def transform(self, df: DataFrame) -> DataFrame:
        known = {c: m for c, m in self.means.items() if m is not None}
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in known.items()})


# Patterns of missing columns whose moments the driver holds; more stay in a table.
DRIVER_PATTERNS = 20_000
Step = tuple[int, tuple[float, ...], float]


class Patterns:
    """Rows by which columns they lack: moments and ranges of the others, centred.

    What the steps so far put into the holes of a pattern is linear in its
    observed columns, so the moments of the filled rows follow from those of
    the observed ones, without a look at any row.
    """

    def __init__(self, rows: Sequence[Any], means: np.ndarray):
        p = len(means)
        self.holes = np.array([[c == "1" for c in r["tm_pattern"]] for r in rows], bool).reshape(len(rows), p)
        packed = np.array([r["tm_m"] for r in rows]).reshape(len(rows), -1)
        self.moments = np.zeros((len(rows), p + 1, p + 1))
        i, j = np.triu_indices(p)
        self.moments[:, 0, :] = packed[:, : p + 1]
        self.moments[:, :, 0] = packed[:, : p + 1]
        self.moments[:, i + 1, j + 1] = self.moments[:, j + 1, i + 1] = packed[:, p + 1:]
        self.low, self.high = (np.array([r[c] for r in rows]).reshape(-1, p) - means for c in ("tm_lo", "tm_hi"))
        # Row k + 1 gives column k of a filled row from 1 and its observed columns; holes start at the mean.
        self.filled = np.repeat(np.eye(p + 1)[None], len(rows), axis=0)
        self.filled[:, 1:, 1:][self.holes] = 0.0

    def apply(self, steps: Sequence[Step]) -> Patterns:
        for j, w, b0 in steps:
            at, rest = self.holes[:, j], [k + 1 for k in range(self.holes.shape[1]) if k != j]
            self.filled[at, j + 1] = np.einsum("k,hkc->hc", np.array(w), self.filled[at][:, rest])
            self.filled[at, j + 1, 0] += b0
        return self

    def gram(self, j: int) -> np.ndarray:
        """Moments of the filled rows in which column `j` is observed."""
        own = ~self.holes[:, j]
        f = self.filled[own]
        return (f @ self.moments[own] @ f.transpose(0, 2, 1)).sum(axis=0)

    def moved(self, before: np.ndarray) -> float:
        """The most that a filled value can have changed since `before`."""
        d = self.filled - before
        low, high = d[:, :, 1:] * self.low[:, None], d[:, :, 1:] * self.high[:, None]
        up, down = d[:, :, 0] + np.maximum(low, high).sum(2), d[:, :, 0] + np.minimum(low, high).sum(2)
        return float(max(np.abs(up).max(initial=0), np.abs(down).max(initial=0)))


@dataclass(frozen=True)
class ChainedImputer:
    """Round-robin ridge regressions of each column on the others.

    Fitted on the train part in two passes: one for means, one for the moments
    of each pattern of missing columns. All rounds are matrix algebra on those.
    It stops early when no filled value can have moved by more than `tol` times
    the largest value.
    """

    cols: tuple[str, ...]
    means: tuple[float, ...]
    steps: tuple[Step, ...] = field(repr=False)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], rounds: int = 10, alpha: float = 1e-3,
            tol: float = 1e-3) -> ChainedImputer:
        cols = tuple(cols)
        train = df.filter(F.col("split") == TRAIN).select(*[F.col(c).cast("double") for c in cols])
        stats = train.agg(*[F.avg(c) for c in cols], *[F.count_if(F.col(c).isNull()) for c in cols],
                          F.max(F.greatest(*[F.abs(c) for c in cols], F.lit(0.0)))).first()
        p = len(cols)
        means, holes, scale = stats[:p], stats[p:2 * p], stats[-1]
        if any(m is None for m in means):
            raise ValueError("a column without any value cannot be imputed")
        order = [int(j) for j in np.argsort(holes, kind="stable") if holes[j] > 0]
        if not order:
            return cls(cols, tuple(means), ())
        marks = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols]).alias("tm_pattern")
        known = train.select(marks, *[F.coalesce(c, F.lit(float(m))).alias(f"tm_c{i}") for i, (c, m) in enumerate(zip(cols, means))])
        table = written(moments(known, ["tm_pattern"], [f"tm_c{i}" for i in range(p)], [float(m) for m in means], ranges=True), "patterns")
        at, steps = np.array(means, float), []
        here = Patterns(table.collect(), at) if table.count() <= DRIVER_PATTERNS else None
        for _ in range(rounds):
            done, before = len(steps), here.filled.copy() if here else None
            for j in order:
                g = here.gram(j) if here else _gram_of(table, at, steps, j)
                step = _ridge_step(g, j, alpha)
                steps.append(step)
                if here:
                    here.apply([step])
            moved = here.moved(before) if here else _moved_of(table, at, steps, done)
            if moved < tol * (scale or 1.0):
                break
        return cls(cols, tuple(float(m) for m in means), tuple(steps))

    def transform(self, df: DataFrame) -> DataFrame:
        """Replay the fitted steps on every row; observed cells are not touched."""
        if not self.steps:
            return MeanImputer(dict(zip(self.cols, self.means))).transform(df)
        cols, steps, means = self.cols, self.steps, np.array(self.means)
        last = {c: i for i, (c, _, _) in enumerate(steps)}

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def replay(parts: pd.DataFrame) -> pd.Series:
            raw = parts.to_numpy(dtype=float) - means
            holes = np.isnan(raw)
            now = np.where(holes, 0.0, raw)
            for j, w, b0 in steps:
                if holes[:, j].any():
                    guess = np.delete(now, j, axis=1) @ np.array(w) + b0
                    now[:, j] = np.where(holes[:, j], guess, now[:, j])
            return pd.Series(list(now + means))

        # Complete rows stay in the JVM: the Python step only sees rows with a hole.
        complete = F.lit(True)
        for c in cols:
            complete = complete & F.col(c).isNotNull()
        done = df.filter(complete).withColumns({c: F.col(c).cast("double") for c in cols})
        open_rows = df.filter(~complete).withColumn("__row", replay(F.struct(*[F.col(c).cast("double") for c in cols])))
        open_rows = open_rows.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.col("__row")[i]) for i, c in enumerate(cols)}).drop("__row")
        return done.unionByName(open_rows)


def _ridge_step(g: np.ndarray, j: int, alpha: float) -> Step:
    """Regression of column `j` on the others from their moments."""
    x = [k + 1 for k in range(len(g) - 1) if k != j]
    n, sx, sy = g[0, 0], g[0, x], g[0, j + 1]
    w = np.linalg.solve(g[np.ix_(x, x)] - np.outer(sx, sx) / n + alpha * np.eye(len(x)), g[x, j + 1] - sx * sy / n)
    return j, tuple(float(v) for v in w), float(sy / n - w @ (sx / n))


def _gram_of(table: DataFrame, means: np.ndarray, steps: Sequence[Step], j: int) -> np.ndarray:
    """`Patterns.gram` of a table of patterns, added up in its tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(means) + 1,) * 2)
        for pdf in batches:
            if len(pdf):
                total += Patterns(pdf.to_dict("records"), means).apply(steps).gram(j)
        yield pd.DataFrame({"g": [total.ravel()]})

    rows = table.mapInPandas(run, "g array<double>").collect()
    return sum(np.array(r["g"]) for r in rows).reshape(len(means) + 1, -1)


def _moved_of(table: DataFrame, means: np.ndarray, steps: Sequence[Step], done: int) -> float:
    """`Patterns.moved` of the steps from `done` on, over a table of patterns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                some = Patterns(pdf.to_dict("records"), means).apply(steps[:done])
                before = some.filled.copy()
                yield pd.DataFrame({"m": [some.apply(steps[done:]).moved(before)]})

    return table.mapInPandas(run, "m double").agg(F.max("m")).first()[0] or 0.0


def impute(df: DataFrame, how: object, s: Series, target: str, cols: Sequence[str] | None = None, rounds: int = 10) -> DataFrame:
    """Impute by name (`ffill`, `bfill`, `backfill`, `mean`, `iterative`, None) or
    with a `pyspark.ml` estimator, which is fitted on the train part."""
    if how is None:
        return df
    if isinstance(how, str) and how in FILLS:
        return impute_fill(df, s, how, target, cols)
    cols = list(cols) if cols is not None else numeric_columns(df, {*s.keys, s.ts, "split"})
    if how == "mean":
        return MeanImputer.fit(df, cols).transform(df)
    if how == "iterative":
        return ChainedImputer.fit(df, cols, rounds).transform(df)
    if hasattr(how, "fit"):
        return how.fit(df.filter(F.col("split") == TRAIN)).transform(df)
    raise ValueError(f"unknown imputer {how!r}")


def to_sequences(df: DataFrame, s: Series, cols: Sequence[str], target: str, length: int = 6,
                 sampling: int = 1, stride: int = 1) -> DataFrame:
    """One sample per row i = L, L+stride, …: the L rows before it, every
    `sampling`-th of them, as `seq`, and the target of row i itself.

    `i` counts rows from 0 inside each series. The current row is not part of
    its own sequence.
    """

    def build(d: DataFrame, w) -> DataFrame:
        i = (F.col("__rn") if s.sliced else F.row_number().over(w)) - 1
        past = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w.rowsBetween(-length, -1))
        d = d.withColumns({"i": i.cast("long"), "seq": past})
        d = d.filter((F.col("i") >= length) & ((F.col("i") - length) % stride == 0))
        return d.withColumn("seq", F.filter("seq", lambda e, k: k % sampling == 0)) if sampling > 1 else d

    out = over_neighbours(df, s, length, build)
    return out.select(*s.keys, s.ts, "i", "seq", F.col(target).cast("double").alias("target"))
