"""Projections and filters that tidy landed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.columns import BROADCAST_ROWS


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist; others are left alone."""
    return df.withColumnsRenamed(dict(mapping))


def keep(df: DataFrame, quantity: str | None = None, member: str | None = None,
         allowed: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with a positive quantity and, optionally, a listed label."""
    if quantity is not None:
        df = df.filter(F.col(quantity) > 0)
    if member is not None and allowed is not None:
        df = df.filter(F.col(member).isin(list(allowed)))
    return df


def clean_text(df: DataFrame, trim: Iterable[str] = (), as_text: Iterable[str] = ()) -> DataFrame:
    """Trim text columns and turn identifiers into text."""
    return df.withColumns({**{c: F.trim(c) for c in trim}, **{c: F.col(c).cast("string") for c in as_text}})


def to_dates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.to_date(c) for c in cols})


def leg_durations(df: DataFrame, legs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add whole-day durations; `legs` maps a new column to (start, end) dates."""
    return df.withColumns({out: F.datediff(end, start) for out, (start, end) in legs.items()})


def journey_legs(events: Sequence[str], names: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Pair ordered event dates into consecutive legs, named in travel order."""
    if len(names) != len(events) - 1:
        raise ValueError("one name is needed per pair of consecutive events")
    return {n: (a, b) for n, a, b in zip(names, events[:-1], events[1:])}


def map_values(df: DataFrame, col: str, lookup: DataFrame, source: str, value: str) -> DataFrame:
    """Replace `col` through a lookup table; values without a match become NULL.

    Repeated lookup rows are folded. A source value with two different targets
    is an error. The lookup is broadcast only after it was counted.
    """
    table = lookup.groupBy(F.col(source).alias("__from")).agg(
        F.min(value).alias("__to"), F.max(value).alias("__other"))
    size, clashes = table.agg(
        F.count(F.lit(1)), F.count_if(F.col("__to") != F.col("__other"))).first()
    if clashes:
        raise ValueError(f"{clashes} values of {source} map to more than one {value}")
    table = table.drop("__other")
    side = F.broadcast(table) if size <= BROADCAST_ROWS else table
    return df.join(side, F.col(col) == F.col("__from"), "left").withColumn(col, F.col("__to")).drop("__from", "__to")


def flag_values(df: DataFrame, col: str, flags: Mapping[str, str]) -> DataFrame:
    """Add 0/1 columns, one per label; NULL labels give 0."""
    return df.withColumns({out: F.when(F.col(col) == v, 1).otherwise(0) for out, v in flags.items()})


def add_flags(df: DataFrame, out: str, parts: Sequence[str]) -> DataFrame:
    """Add the sum of several flags."""
    return df.withColumn(out, sum((F.col(c) for c in parts[1:]), F.col(parts[0])))


def override_on_dates(df: DataFrame, col: str, date: str, dates: Sequence[str], label: str) -> DataFrame:
    """Set a label on given dates and keep it elsewhere."""
    hit = F.col(date).cast("date").isin([F.lit(d).cast("date") for d in dates])
    return df.withColumn(col, F.when(hit, F.lit(label)).otherwise(F.col(col)))


def day_group(df: DataFrame, date: str, out: str = "day") -> DataFrame:
    """0 for Thursday to Saturday, 1 for the rest of a Sunday-started week."""
    return df.withColumn(out, F.when(F.weekday(date).between(3, 5), 0).otherwise(1))


def ceil_product(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.ceil(F.col(a) * F.col(b)))


def power(df: DataFrame, col: str, exponent: float) -> DataFrame:
    return df.withColumn(col, F.pow(col, F.lit(float(exponent))))


def select_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep some columns and the rows where all of them are set."""
    return df.select(*cols).na.drop()


def label_case(col: str, recode: Mapping[str, str], other: str) -> Column:
    """CASE over one column with a default."""
    out = None
    for source, target in recode.items():
        hit = F.col(col) == source
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out.otherwise(other) if out is not None else F.lit(other)
