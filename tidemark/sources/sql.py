"""SQL text over registered tables, with a result cache shared by all callers."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

_cache: dict[tuple[int, str], DataFrame] = {}
_lock = threading.Lock()


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Name a result so that later statements can read it. Cached results go,
    as they may have read what the name stood for before."""
    df.createOrReplaceTempView(name)
    clear_cache()
    return df


def query_key(sql: str, parse_dates: Iterable[str] = ()) -> str:
    return hashlib.sha256("\n".join([sql, *sorted(parse_dates)]).encode()).hexdigest()


def run_query(spark: SparkSession, sql: str, parse_dates: Iterable[str] = (), use_cache: bool = True) -> DataFrame:
    """Run SQL; turn text columns in `parse_dates` into timestamps, bad values
    into NULL. With the cache, the same text is computed once and persisted."""
    parse_dates = list(parse_dates)
    key = (id(spark), query_key(sql, parse_dates))
    with _lock:
        if use_cache and key in _cache:
            return _cache[key]
        df = spark.sql(sql)
        df = df.withColumns({c: F.try_to_timestamp(c) for c in parse_dates}) if parse_dates else df
        if use_cache:
            _cache[key] = df.persist()
        return df


def clear_cache() -> None:
    with _lock:
        for df in _cache.values():
            df.unpersist()
        _cache.clear()
