"""Grouped sums, pivots, ratios and distributions of a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.columns import is_missing, join_on, small_side, text_columns

# Fixed defaults: missing share that counts as high, label of a missing category.
MISSING_THRESHOLD = 0.4
MISSING_CATEGORY = "Not Available"


def sum_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])


def units_by_event_date(df: DataFrame, leg: str, move: str, event_dates: Mapping[str, Mapping[str, str]],
                        value_col: str, keep_node: bool = False) -> DataFrame:
    """Daily units at one node type; the move picks the date column.

    `event_dates` maps move -> leg -> date column. The quantity is summed. Rows
    whose event has not happened (no date) belong to no day.
    """
    try:
        date_col = event_dates[move][leg]
    except KeyError:
        known = sorted((m, node) for m, nodes in event_dates.items() for node in nodes)
        raise ValueError(f"no date column for {move} at {leg}; known pairs: {known}") from None
    keys = [F.col(date_col).alias("date")] + ([F.col(leg)] if keep_node else [])
    return df.filter(F.col(date_col).isNotNull()).groupBy(*keys).agg(F.sum(value_col).alias("units"))


def conditional_sums(value: str, bucket: str, types: Sequence[int], name: str = "Type_{}_Units",
                     none_name: str = "No_Type_Units") -> list[Column]:
    """One sum per bucket value and one for rows without a bucket."""
    hit = {name.format(t): F.col(bucket) == t for t in types}
    hit[none_name] = F.col(bucket).isNull()
    return [F.sum(F.when(cond, F.col(value)).otherwise(0)).alias(out) for out, cond in hit.items()]


def share_by(df: DataFrame, keys: Sequence[str], value: str, part: Column, out: str) -> DataFrame:
    """Share of `value` that satisfies `part`, for keys that have such rows.

    One conditional aggregate instead of joining the part to the whole.
    """
    agg = df.groupBy(*keys).agg(F.sum(value).alias("__all"), F.sum(F.when(part, F.col(value))).alias("__part"))
    return agg.filter("__part IS NOT NULL").select(*keys, F.try_divide("__part", "__all").alias(out))


def missing_profile(df: DataFrame, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    """Missing share of every column, in one pass over the table."""
    cols = df.columns
    shares = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in cols])
    rows = shares.unpivot([], cols, "column", "missing")
    return rows.withColumn("high", F.coalesce(F.col("missing") > threshold, F.lit(False)))


def category_histogram(df: DataFrame, cols: Sequence[str] | None = None,
                       fill: Mapping[str, str] | None = None) -> DataFrame:
    """Count of every value of the text columns; missing gets a label."""
    cols = list(cols) if cols is not None else text_columns(df)
    fill = fill or {}
    filled = df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit(fill.get(c, MISSING_CATEGORY))).alias(c) for c in cols])
    return filled.unpivot([], cols, "column", "value").groupBy("column", "value").count()


def class_distribution(df: DataFrame, keys: Sequence[str], col: str, classes: DataFrame) -> DataFrame:
    """Share of each class per group, on a template of classes.

    Classes absent from a group get 0; values outside the template are not
    shown but count in the denominator. `classes` has one column named `col`.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    template = classes.select(col).distinct().agg(F.collect_list(col).alias("__classes"))
    # The template is a short list; it rides along with each group's total.
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    grid = totals.withColumn("__classes", template.scalar()).select(
        *keys, "__total", F.explode("__classes").alias(col))
    out = join_on(grid, counts, [*keys, col], "left")
    return out.select(*keys, col, (F.coalesce("__n", F.lit(0)) / F.col("__total")).alias("prob"))


def distinct_lookup(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of some columns, broadcast when few."""
    return small_side(df.select(*cols).distinct())
