"""Calendar columns, week starts, roundings and date cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    """`day`, `dayofweek` (Monday = 0), ISO `week` and `month`."""
    return df.withColumns({
        "day": F.dayofmonth(date), "dayofweek": F.weekday(date),
        "week": F.weekofyear(date), "month": F.month(date)})


def sunday_week(date: Column | str) -> Column:
    """The Sunday on or before a date."""
    d = F.to_date(date)
    return F.date_sub(d, F.dayofweek(d) - 1)


def monday_week(ts: Column | str) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def before_week_cut(week: Column | str, as_of: str, days: int = 14) -> Column:
    """Weeks that start before the Sunday of `as_of` plus two weeks."""
    cut = F.date_add(sunday_week(F.lit(as_of).cast("date")), days)
    return (F.col(week) if isinstance(week, str) else week) < cut


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def level_adjusted(value: Column, week: Column, cut: str, factor: float = 0.97) -> Column:
    """Scale and round values of weeks up to a cut-off date."""
    return F.when(week <= F.lit(cut).cast("date"), F.round(value * factor)).otherwise(value)
