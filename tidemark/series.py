"""What a series is, and how a long one is spread over many tasks.

A panel is a DataFrame with `keys` (may be empty) and an order column `ts`,
one row per key and timestamp. Most operators need the rows of a series in
order. A window over `keys` puts a whole series into one task, which is fine
for short series and fatal for one with billions of rows. `Series.measure`
counts first. When the longest series is too long, it picks a time slice so
that one slice of one series fits in a task; operators then work per slice and
carry the little that crosses a border (a row offset, a running sum, the last
value seen).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.columns import epoch_micros

# Rows of one series that a single task may hold in order.
SLICE_ROWS = 1_000_000


@dataclass(frozen=True)
class Series:
    """Keys, order column and, for long series, the slice width.

    `slice_micros=None` states that every series fits in one task. That holds
    by construction for calendar-day data; otherwise use `Series.measure`.
    """

    keys: tuple[str, ...]
    ts: str
    slice_micros: int | None = None
    slice_rows: int = SLICE_ROWS

    @classmethod
    def of(cls, keys: Sequence[str] = (), ts: str = "ts") -> Series:
        return cls(tuple(keys), ts)

    @classmethod
    def measure(cls, df: DataFrame, keys: Sequence[str] = (), ts: str = "ts",
                rows: int = SLICE_ROWS) -> Series:
        """Count the series of `df` and choose slices if one is longer than `rows`."""
        keys = tuple(keys)
        at = epoch_micros(df, ts)
        per_series = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at) + 1).alias("span"))
        top = per_series.agg(
            F.max("n").alias("n"),
            F.min(F.when(F.col("n") > rows, F.col("span") / F.col("n"))).alias("micros_per_row"),
        ).first()
        if top.n is None or top.n <= rows:
            return cls(keys, ts, None, rows)
        width = max(1, int(top.micros_per_row * rows))
        while width > 1:
            # Bursts: shrink until the fullest slice is near the target.
            peak = (df.groupBy(*keys, F.floor(at / F.lit(width)).alias("slice")).count()
                    .agg(F.max("count")).first()[0])
            if peak <= 2 * rows:
                break
            width = max(1, min(width // 2, width * rows // peak))
        return cls(keys, ts, width, rows)

    @property
    def sliced(self) -> bool:
        return self.slice_micros is not None

    def within(self, *extra: str) -> Series:
        """The same series cut further by other columns, such as `split`."""
        return replace(self, keys=self.keys + tuple(c for c in extra if c not in self.keys))

    def slice_of(self, df: DataFrame) -> Column:
        return F.floor(epoch_micros(df, self.ts) / F.lit(self.slice_micros))

    def window(self) -> WindowSpec:
        """Whole-series window; only for series that fit in one task."""
        if self.sliced:
            raise ValueError("this series is too long for one window; use the sliced operators")
        return Window.partitionBy(*self.keys).orderBy(self.ts)


def require_unique(df: DataFrame, s: Series) -> DataFrame:
    """Raise if a series has two rows for one timestamp; a missing one is none."""
    repeated = df.filter(F.col(s.ts).isNotNull()).groupBy(*s.keys, s.ts).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate timestamp in series: {repeated[0].asDict()}")
    return df
