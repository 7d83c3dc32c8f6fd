"""Per-split feature hooks, one-hot encoding and min-max scaling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.columns import attach, col, small_side, text_columns
from tidemark.series import Series
from tidemark.session import TRAIN

# Label of the column that gathers rare categories, and of the missing category.
INFREQUENT, NO_VALUE = "infrequent_val", "None"
# Rare values of a column that the driver lists at most, whatever limit a caller gives.
MOST_LISTED = 10_000


def apply_features(df: DataFrame, s: Series, hook: Callable[[Mapping, DataFrame, Series], DataFrame],
                   params: Mapping | None = None) -> DataFrame:
    """Run a feature hook as if on each split alone: its windows restart there."""
    return hook(params or {}, df, s.within("split"))


def encodable(df: DataFrame, configured: Sequence[str] = (), skip: Sequence[str] = ()) -> list[str]:
    """Text columns and configured columns that exist, sorted."""
    return sorted((set(text_columns(df)) | (set(configured) & set(df.columns))) - set(skip) - {"split"})


@dataclass(frozen=True)
class OneHot:
    """Indicator columns for the categories of the train part.

    `frequent` holds the categories that get their own column. At most
    `1/min_frequency` values per column can pass a fractional threshold, so
    this list is short however many values the data has. Rare values share
    `{col}_infrequent_val`; they stay a table and are only looked up when they
    are too many to list (`max_listed`, `MOST_LISTED` at most). `rare_missing`
    names the columns whose missing value is rare; it is kept beside such
    tables, which hold no NULL.
    """

    frequent: Mapping[str, tuple[str | None, ...]]
    rare: Mapping[str, tuple[str | None, ...] | DataFrame]
    rare_missing: frozenset[str] = frozenset()

    @classmethod
    def from_counts(cls, cols: Sequence[str], counts: Sequence[tuple[str, str | None, int]],
                    min_frequency: float | int | None = None, max_columns: int | None = None) -> OneHot:
        """Pick categories from (column, value, count) triples of the train part.

        A fraction is a share of all rows, an integer a number of rows; below
        it a category is rare. `max_columns` turns more columns of one category
        into an error; there is no such limit unless it is given.
        """
        order = lambda values: tuple(sorted(values, key=lambda v: (v is None, v)))
        frequent, rare = {}, {}
        for c in cols:
            mine = [(v, n) for name, v, n in counts if name == c]
            floor = min_frequency * sum(n for _, n in mine) if isinstance(min_frequency, float) else (min_frequency or 0)
            frequent[c] = order(v for v, n in mine if n >= floor)
            few = order(v for v, n in mine if n < floor)
            if few:
                rare[c] = few
        wide = {c: len(v) for c, v in frequent.items() if max_columns is not None and len(v) > max_columns}
        if wide:
            raise ValueError(f"too many categories for columns {wide}; raise min_frequency")
        return cls(frequent, rare)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], min_frequency: float | int | None = None,
            max_columns: int | None = None, max_listed: int = 2_000) -> OneHot:
        if not cols:
            return cls({}, {})
        max_listed = min(max_listed, MOST_LISTED)
        train = df.filter(F.col("split") == TRAIN) if "split" in df.columns else df
        counts = category_counts(train, cols).persist()
        try:
            # Usually there are few values and one small read says it all.
            few_rows = counts.limit(max_listed + 1).collect()
            if len(few_rows) <= max_listed:
                return cls.from_counts(cols, [tuple(r) for r in few_rows], min_frequency, max_columns)
            total = counts.groupBy("column").agg(F.sum("count").alias("total"))
            if isinstance(min_frequency, float):
                floor = F.lit(min_frequency) * F.col("total")
            else:
                floor = F.lit(min_frequency or 0)
            # At most one total per encoded column.
            rated = counts.join(F.broadcast(total), "column").withColumn("rare", F.col("count") < floor)
            sizes = {(r["column"], r["rare"]): r["n"]
                     for r in rated.groupBy("column", "rare").agg(F.count(F.lit(1)).alias("n")).collect()}
            wide = {c: n for (c, is_rare), n in sizes.items() if not is_rare and max_columns is not None and n > max_columns}
            if wide:
                raise ValueError(f"too many categories for columns {wide}; raise min_frequency")

            def listed(is_rare: bool, names: Sequence[str]) -> dict[str, tuple[str | None, ...]]:
                rows = rated.filter((F.col("rare") == is_rare) & F.col("column").isin(list(names))).collect()
                return {c: tuple(sorted((r["value"] for r in rows if r["column"] == c),
                                        key=lambda v: (v is None, v))) for c in names}

            few = [c for c in cols if 0 < sizes.get((c, True), 0) <= max_listed]
            many = [c for c in cols if sizes.get((c, True), 0) > max_listed]
            rare: dict[str, tuple[str | None, ...] | DataFrame] = dict(listed(True, few))
            for c in many:
                rare[c] = _rare_values(train, c, min_frequency)
            missing = rated.filter(F.col("rare") & F.col("value").isNull()).select("column").collect()
            return cls(listed(False, list(cols)), rare, frozenset(r["column"] for r in missing))
        finally:
            counts.unpersist()

    def names(self) -> list[str]:
        out = []
        for c, values in self.frequent.items():
            out += [f"{c}_{NO_VALUE if v is None else v}" for v in values]
            out += [f"{c}_{INFREQUENT}"] if c in self.rare else []
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the encoded columns; a value never seen in train gives zeros."""
        flags: dict[str, Column] = {}
        for c, values in self.frequent.items():
            text = col(c).cast("string")
            for v in values:
                flags[f"{c}_{NO_VALUE if v is None else v}"] = text.eqNullSafe(F.lit(v))
            if c not in self.rare:
                continue
            held = self.rare[c]
            if isinstance(held, DataFrame):
                df = _mark_rare(df, c, values, held, c in self.rare_missing)
                flags[f"{c}_{INFREQUENT}"] = F.col(f"__rare_{c}")
            else:
                known = [v for v in held if v is not None]
                hit = F.coalesce(text.isin(known), F.lit(False)) if known else F.lit(False)
                flags[f"{c}_{INFREQUENT}"] = hit | text.isNull() if None in held else hit
        kept = [col(c) for c in df.columns if c not in self.frequent and not c.startswith("__rare_")]
        return df.select(*kept, *[f.cast("double").alias(n) for n, f in flags.items()])


def category_counts(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column, value, count) over several columns, in one pass."""
    text = train.select(*[col(c).cast("string").alias(c) for c in cols])
    return text.unpivot([], list(cols), "column", "value").groupBy("column", "value").count()


def _rare_values(train: DataFrame, c: str, min_frequency: float | int | None) -> DataFrame:
    counts = train.groupBy(col(c).cast("string").alias("__value")).count()
    if isinstance(min_frequency, float):
        n = train.agg(F.count(F.lit(1)).alias("n"))
        return counts.filter(F.col("count") < F.lit(min_frequency) * n.scalar()).select("__value")
    return counts.filter(F.col("count") < min_frequency).select("__value")


def _mark_rare(df: DataFrame, c: str, frequent: Sequence[str | None], rare: DataFrame, missing: bool) -> DataFrame:
    """Look rare values up in a table; frequent (hot) and missing values bypass the join."""
    text = col(c).cast("string")
    listed = [v for v in frequent if v is not None]
    hot = text.isNull() | (F.coalesce(text.isin(listed), F.lit(False)) if listed else F.lit(False))
    flag = f"__rare_{c}"
    side = small_side(rare.filter("__value IS NOT NULL").withColumn(flag, F.lit(True)))
    cold = df.filter(~hot).join(side, text == F.col("__value"), "left").drop("__value")
    cold = cold.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return df.filter(hot).withColumn(flag, text.isNull() & F.lit(missing)).unionByName(cold)


def one_hot(df: DataFrame, cols: Sequence[str] | None = None, min_frequency: float | int | None = None) -> DataFrame:
    """Fit on train and encode; without a list every text column is encoded."""
    return OneHot.fit(df, encodable(df) if cols is None else sorted(set(cols)), min_frequency).transform(df)


def _unit(c: Column, lo: Column, hi: Column) -> Column:
    """(c-lo)/(hi-lo); a constant column becomes its distance from that constant."""
    return (c - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)


@dataclass(frozen=True)
class MinMax:
    """Column ranges of the train part."""

    ranges: Mapping[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> MinMax:
        train = df.filter(F.col("split") == TRAIN) if "split" in df.columns else df
        row = train.agg(*[f(col(c).cast("double")) for c in cols for f in (F.min, F.max)]).first()
        return cls({c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(cols) if row[2 * i] is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: _unit(col(c).cast("double"), F.lit(lo), F.lit(hi)) for c, (lo, hi) in self.ranges.items()})


def scale(df: DataFrame, cols: Sequence[str], how: object = "minmax") -> DataFrame:
    """Scale by name or with a `pyspark.ml` estimator fitted on train."""
    if how is None:
        return df
    if how == "minmax":
        return MinMax.fit(df, cols).transform(df)
    if hasattr(how, "fit"):
        train = df.filter(F.col("split") == TRAIN) if "split" in df.columns else df
        return how.fit(train).transform(df)
    raise ValueError(f"unknown scaler {how!r}")


def scale_by_series(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Min-max scaling with one range per series, fitted on train."""
    ranges = df.filter(F.col("split") == TRAIN).groupBy(*s.keys).agg(
        *[F.min(col(c)).cast("double").alias(f"__lo_{c}") for c in cols],
        *[F.max(col(c)).cast("double").alias(f"__hi_{c}") for c in cols])
    d = attach(df, ranges, s.keys)
    d = d.withColumns({c: _unit(col(c), col(f"__lo_{c}"), col(f"__hi_{c}")) for c in cols})
    return d.drop(*[f"__{k}_{c}" for c in cols for k in ("lo", "hi")])


def scale_sequences(train: DataFrame, others: Sequence[DataFrame] = (), seq: str = "seq") -> list[DataFrame]:
    """Scale every step of every sequence by the ranges of the train steps.

    The ranges are those of the distinct steps. A minimum and a maximum do not
    change when repeats are dropped, so no distinct (and no shuffle) is needed.
    """
    steps = train.select(F.explode(seq).alias("e")).select(F.posexplode("e").alias("k", "v"))
    ranges = steps.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    ranges.sort(key=lambda r: r["k"])
    lo, span = [float(r.lo) for r in ranges], [float(r.hi - r.lo) or 1.0 for r in ranges]
    low, wide = F.array(*map(F.lit, lo)), F.array(*map(F.lit, span))
    unit = lambda e: F.zip_with(F.zip_with(e, low, lambda v, a: v - a), wide, lambda v, b: v / b)
    return [d.withColumn(seq, F.transform(seq, unit)) for d in (train, *others)]
