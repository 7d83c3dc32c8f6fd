"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A lookup is broadcast only when a count proves it has at most this many rows.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8_000_000
# Rows read first, to learn their width.
PROBE_ROWS = 1_000


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def is_missing(df: DataFrame, col: str) -> Column:
    """NULL, or NaN for floating columns."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NULL the only missing marker; done once when data is landed."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 as BIGINT, strictly increasing in `col`.

    Zone-less timestamps are taken apart by calendar field, so no session
    time zone (and no daylight-saving jump) can change their order. A whole
    number (a grid step) stands for itself.
    """
    kind = df.schema[col].dataType
    c = F.col(col)
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    day = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    if isinstance(kind, T.DateType):
        return day
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return day + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + second
    raise TypeError(f"{col} must be a date, a timestamp or a whole number, not {kind.simpleString()}")


def join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps the left key columns."""
    if not cols:
        raise ValueError("join_on needs at least one column")
    marked = right.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
    joined = left.join(marked, same, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"__r_{c}" for c in cols])


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast `df` if it is proven small in rows and bytes, else leave the join to Spark.

    A first read of at most `PROBE_ROWS` + 1 rows tells how wide a row is; if
    there are more, a second one reads only as many as fit `max_bytes`. A table
    that passes is kept as read, so its statistics are not computed again.
    """
    rows = df.limit(min(max_rows, PROBE_ROWS) + 1).toArrow()
    if rows.num_rows > PROBE_ROWS:
        max_rows = min(max_rows, max_bytes * rows.num_rows // max(rows.nbytes, 1))
        rows = df.limit(max_rows + 1).toArrow() if max_rows > PROBE_ROWS else rows
    if rows.num_rows > max_rows or rows.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-series statistics to every row of the series.

    Without keys `stats` is a single row and its values come in as scalar
    subqueries. With keys it is a left join whose small side is broadcast after
    a size check, so a series with a third of all rows is never moved.
    """
    if keys:
        return join_on(df, small_side(stats), list(keys), "left")
    return df.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def quoted(name: str) -> str:
    """A column name safe to pass to `F.col`, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))
