"""Market-style CSV files: one timestamped value per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the strict timestamp layout of the files.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv_series(spark: SparkSession, path: str | Sequence[str], ts_col: str = "Date", value_col: str = "Open",
                    name: str | None = None, fmt: str = TIMESTAMP_FORMAT, offset_fmt: str | None = None) -> DataFrame:
    """`date` and one double column. Timestamps that do not match `fmt` exactly
    become NULL. `offset_fmt` optionally accepts a second layout with a zone
    offset; those values are moved to UTC first."""
    raw = spark.read.csv(path, header=True).select(F.col(ts_col).alias("t"), F.col(value_col).alias("v"))
    date = F.to_date(F.try_to_timestamp("t", F.lit(fmt)))
    if offset_fmt:
        utc = F.convert_timezone(None, F.lit("UTC"), F.try_to_timestamp("t", F.lit(offset_fmt)))
        date = F.coalesce(date, F.to_date(utc))
    return raw.select(date.alias("date"), F.expr("try_cast(v AS double)").alias(name or value_col))
