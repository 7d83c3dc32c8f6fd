"""Fold tables. Rows of a series are counted from 0; `hi` ends are exclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.columns import attach
from tidemark.operators.ordered import number_rows
from tidemark.series import Series

# Fixed defaults.
CV_FOLDS = 5
EXPANDING, SLIDING = "expanding", "sliding"


def series_length(df: DataFrame, s: Series) -> DataFrame:
    return df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"))


def _explode(lengths: DataFrame, keys: Sequence[str], last: Column) -> DataFrame:
    return lengths.filter(last >= 0).select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fold"))


def folds_equal(lengths: DataFrame, keys: Sequence[str] = (), k: int = CV_FOLDS, max_train: int | None = None) -> DataFrame:
    """k test blocks of n // (k+1) rows at the end; train is all before, or its
    last `max_train` rows. Series with fewer than k+1 rows have no folds."""
    t = F.floor(F.col("n") / (k + 1))
    d = _explode(lengths.filter(F.col("n") >= k + 1), keys, F.lit(k - 1).cast("long"))
    lo = F.col("n") - (k - F.col("fold")) * t
    start = F.greatest(lo - max_train, F.lit(0)) if max_train else F.lit(0)
    return d.select(*keys, "fold", start.cast("long").alias("train_lo"), lo.alias("train_hi"),
                    lo.alias("test_lo"), (lo + t).alias("test_hi"))


def folds_plain(lengths: DataFrame, keys: Sequence[str] = (), k: int = CV_FOLDS) -> DataFrame:
    """Contiguous k-fold blocks, the first n % k one row longer; train is the rest."""
    base, extra = F.floor(F.col("n") / k), F.col("n") % k
    d = _explode(lengths.filter(F.col("n") >= k), keys, F.lit(k - 1).cast("long"))
    lo = F.col("fold") * base + F.least(F.col("fold"), extra)
    return d.select(*keys, "fold", lo.alias("test_lo"),
                    (lo + base + F.when(F.col("fold") < extra, 1).otherwise(0)).alias("test_hi"))


def rolling_defaults(n: Column, k: int = CV_FOLDS) -> Column:
    """Default window and step of rolling-origin folds."""
    return F.floor(n / (k + 1))


def folds_rolling(lengths: DataFrame, keys: Sequence[str] = (), window: int | None = None, step: int | None = None,
                  horizons: Sequence[int] | None = None, mode: str = EXPANDING, seq_len: int = 0) -> DataFrame:
    """Rolling-origin folds: the cut-off row c moves from window-1 in steps while
    its furthest test row c+max(h) exists. `first_h`/`last_h` bound the horizons
    when none are given (1..window). Sequence data shortens the window."""
    w0 = F.lit(window).cast("long") if window is not None else rolling_defaults(F.col("n"))
    w = w0 - seq_len
    st = F.lit(step).cast("long") if step is not None else rolling_defaults(F.col("n"))
    reach = F.lit(max(horizons)).cast("long") if horizons is not None else w0
    d = lengths.withColumns({"__w": w, "__s": st, "__reach": reach}).filter("__w >= 1 AND __s >= 1")
    last = F.floor((F.col("n") - 1 - F.col("__reach") - (F.col("__w") - 1)) / F.col("__s"))
    d = d.withColumn("__last", last).filter("__last >= 0")
    # Cut-offs are dealt out in chunks so that one long series is not expanded in one task.
    chunk = 100_000
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / chunk))).alias("__chunk"))
    d = d.repartition(*keys, "__chunk") if keys else d.repartition("__chunk")
    first = F.col("__chunk") * chunk
    d = d.select("*", F.explode(F.sequence(first, F.least(F.col("__last"), first + chunk - 1))).alias("fold"))
    hi = F.col("__w") + F.col("fold") * F.col("__s")
    lo = hi - F.col("__w") if mode == SLIDING else F.lit(0).cast("long")
    hs = [F.lit(int(h)).cast("long") for h in horizons] if horizons is not None else None
    tests = F.array(*hs) if hs else F.sequence(F.lit(1).cast("long"), F.col("__reach"))
    return d.select(*keys, "fold", lo.alias("train_lo"), hi.alias("train_hi"), tests.alias("horizons"))


def assign_folds(df: DataFrame, s: Series, folds: DataFrame) -> DataFrame:
    """Rows with the folds they train or test (for a few folds per series).

    The folds of a series travel as one short array, so membership is a filter
    on that array and not a range join.
    """
    table = folds.groupBy(*s.keys).agg(F.collect_list(
        F.struct("fold", "train_lo", "train_hi", "test_lo", "test_hi")).alias("__folds"))
    d = attach(number_rows(df, s, "rn"), table, s.keys).withColumn("rn", F.col("rn") - 1)

    def role(lo: str, hi: str, name: str) -> Column:
        mine = F.filter("__folds", lambda f: (f[lo] <= F.col("rn")) & (F.col("rn") < f[hi]))
        return F.transform(mine, lambda f: F.struct(f["fold"].alias("fold"), F.lit(name).alias("role")))

    d = d.withColumn("__in", F.explode(F.concat(role("train_lo", "train_hi", "train"), role("test_lo", "test_hi", "test"))))
    return d.select(*[c for c in d.columns if not c.startswith("__")], "__in.fold", "__in.role")
