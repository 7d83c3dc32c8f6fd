"""Operators that depend on the order of rows in a series.

Every operator has two shapes with the same result. If the series fits in one
task it is a plain window over the keys. If `Series.measure` chose slices, the
heavy windows run per (series, slice) and only one small row per slice meets
its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.columns import join_on
from tidemark.series import Series

Lags = Sequence[int] | Mapping[str, Sequence[int]]


_TOTAL = {"sum": F.sum, "min": F.min, "max": F.max}
_JOIN = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def running_totals(df: DataFrame, s: Series, totals: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add running `sum`, `min` or `max` columns from the start of each series.

    A long series is totalled per slice; only the slice totals are summed up
    in one place and each slice adds what came before it.
    """
    if not s.sliced:
        w = s.window().rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: _TOTAL[k](c).over(w) for o, (k, c) in totals.items()})
    part = [*s.keys, "__slice"]
    d = df.withColumn("__slice", s.slice_of(df))
    per_slice = d.groupBy(*part).agg(*[_TOTAL[k](c).alias(f"__t_{o}") for o, (k, c) in totals.items()])
    before = Window.partitionBy(*s.keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*part, *[_TOTAL[k](f"__t_{o}").over(before).alias(f"__c_{o}") for o, (k, _) in totals.items()])
    inside = Window.partitionBy(*part).orderBy(s.ts).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__l_{o}": _TOTAL[k](c).over(inside) for o, (k, c) in totals.items()})
    d = join_on(d, carried, part)
    # A prefix with no value yet stays NULL, as in one long window.
    joined = {o: F.coalesce(_JOIN[k](F.col(f"__c_{o}"), F.col(f"__l_{o}")), f"__c_{o}", f"__l_{o}")
              for o, (k, _) in totals.items()}
    return d.withColumns(joined).drop("__slice", *[f"__{x}_{o}" for o in totals for x in "lc"])


def number_rows(df: DataFrame, s: Series, out: str = "rn") -> DataFrame:
    """Number the rows of each series 1, 2, 3, … in time order."""
    if not s.sliced:
        return df.withColumn(out, F.row_number().over(s.window()).cast("long"))
    return running_totals(df, s, {out: ("sum", F.lit(1).cast("long"))})


def over_neighbours(df: DataFrame, s: Series, before: int,
                    build: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """Run `build(df, window)` for windows that look at most `before` rows back.

    For long series the rows are dealt into blocks of consecutive row numbers
    and each block is lent the last `before` rows of the block ahead of it.
    """
    if not s.sliced:
        return build(df, s.window())
    size = max(s.slice_rows, 2 * before)
    d = number_rows(df, s, "__rn").withColumn("__home", F.floor((F.col("__rn") - 1) / F.lit(size)))
    lent = (F.col("__rn") - 1) % size >= size - before
    blocks = F.when(lent, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))
    d = d.withColumn("__block", F.explode(blocks))
    d = build(d, Window.partitionBy(*s.keys, "__block").orderBy("__rn"))
    return d.filter("__block = __home").drop("__rn", "__home", "__block")


def _per_column(cols: Sequence[str], lags: Lags) -> dict[str, list[int]]:
    return {c: list(lags[c] if isinstance(lags, Mapping) else lags) for c in cols}


def _shifted(df: DataFrame, s: Series, cols: Sequence[str], lags: Lags, dropna: bool,
             name: str, value: Callable[[str, Column], Column]) -> DataFrame:
    wanted = _per_column(cols, lags)
    reach = max(k for ks in wanted.values() for k in ks)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        new = {f"{c}_{name}{k}": value(c, F.lag(c, k).over(w)) for c, ks in wanted.items() for k in ks}
        if not dropna:
            return d.withColumns(new)
        # The first `reach` rows go by position, whatever they hold.
        seen = F.col("__rn") if s.sliced else F.row_number().over(w)
        return d.withColumns({**new, "__seen": seen}).filter(F.col("__seen") > reach).drop("__seen")

    return over_neighbours(df, s, reach, build)


def add_lags(df: DataFrame, s: Series, cols: Sequence[str], lags: Lags = (1,), dropna: bool = True) -> DataFrame:
    """Add `{col}_lag{k}`; with `dropna` the first max(lag) rows of a series go."""
    return _shifted(df, s, cols, lags, dropna, "lag", lambda c, prev: prev)


def add_diffs(df: DataFrame, s: Series, cols: Sequence[str], diffs: Lags = (1,), dropna: bool = True) -> DataFrame:
    """Add `{col}_diff{k}` = value minus the value k rows before."""
    return _shifted(df, s, cols, diffs, dropna, "diff", lambda c, prev: F.col(c) - prev)


def difference(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Replace columns by their first difference and drop each first row."""
    d = add_diffs(df, s, cols, (1,), dropna=True)
    return d.withColumns({c: F.col(f"{c}_diff1") for c in cols}).drop(*[f"{c}_diff1" for c in cols])


def full_frame(agg: Callable[[Column], Column], col: str, w: WindowSpec, first: int, last: int) -> Column:
    """Aggregate over rows `first`..`last`; NULL unless every row is there and set."""
    frame = w.rowsBetween(first, last)
    return F.when(F.count(col).over(frame) == last - first + 1, agg(F.col(col)).over(frame))


def rolling_sum(df: DataFrame, s: Series, col: str, n: int, shift: int, out: str) -> DataFrame:
    """Sum of `n` rows ending `shift` rows back."""
    return over_neighbours(df, s, n + shift - 1, lambda d, w: d.withColumn(
        out, full_frame(F.sum, col, w, -(n + shift - 1), -shift)))


def trailing_mean(df: DataFrame, s: Series, col: str, n: int, out: str) -> DataFrame:
    """Mean of the `n` rows before the current one."""
    return over_neighbours(df, s, n, lambda d, w: d.withColumn(out, full_frame(F.avg, col, w, -n, -1)))


def fill(df: DataFrame, s: Series, cols: Sequence[str], method: str) -> DataFrame:
    """Carry the last (`ffill`) or next (`bfill`, `backfill`) value into NULLs."""
    if method not in ("ffill", "bfill", "backfill"):
        raise ValueError(f"unknown fill method {method!r}")
    forward = method == "ffill"

    def nearest(c: str, part: Sequence[str], order: str, own: bool) -> Column:
        # The next value is the last one seen from the other end: a frame that
        # reaches forward would be computed anew for every row.
        w = Window.partitionBy(*part).orderBy(F.col(order).asc() if forward else F.col(order).desc())
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1))

    if not s.sliced:
        return df.withColumns({c: nearest(c, s.keys, s.ts, True) for c in cols})
    part = [*s.keys, "__slice"]
    d = df.withColumn("__slice", s.slice_of(df))
    pick = F.max_by if forward else F.min_by
    ends = d.groupBy(*part).agg(*[
        pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(s.ts))).alias(f"__e_{c}") for c in cols])
    ends = ends.select(*part, *[nearest(f"__e_{c}", s.keys, "__slice", False).alias(f"__n_{c}") for c in cols])
    d = d.withColumns({c: nearest(c, part, s.ts, True) for c in cols})
    d = join_on(d, ends, part).withColumns({c: F.coalesce(c, f"__n_{c}") for c in cols})
    return d.drop("__slice", *[f"__n_{c}" for c in cols])


def with_context(df: DataFrame, s: Series, d: int, split: str = "split",
                 order: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Prepend the last `d` rows of the split before to each later split.

    The second split borrows from the first; the third borrows from the second
    *after* that one was extended, so a short middle part reaches further back.
    """
    if d <= 0:
        return df
    last = Window.partitionBy(*s.keys).orderBy(F.col(s.ts).desc())
    out = df.filter(F.col(split) == order[0])
    extended = out
    for name in order[1:]:
        tail = (extended.withColumn("__back", F.row_number().over(last))
                .filter(F.col("__back") <= d).drop("__back").withColumn(split, F.lit(name)))
        extended = df.filter(F.col(split) == name).unionByName(tail)
        out = out.unionByName(extended)
    return out
