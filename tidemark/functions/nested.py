"""Sums, leaves and flattening of nested columns, driven by the schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def flatten_map(df: DataFrame, col: str, levels: Sequence[str], value: str = "values") -> DataFrame:
    """One column per nesting level of a map of maps, and one for the leaf."""
    rest = [c for c in df.columns if c != col]
    for level in levels:
        df = df.select(*rest, F.explode(col).alias(level, col))
        rest.append(level)
    return df.withColumnRenamed(col, value)


def _add(a: Column, b: Column) -> Column:
    return F.struct((a["total"] + b["total"]).alias("total"), (a["n"] + b["n"]).alias("n"))


def _pair(total: Column, n: Column) -> Column:
    return F.struct(total.cast("double").alias("total"), n.cast("long").alias("n"))


def _walk(c: Column, kind: T.DataType, exclude: frozenset[str], ignore_na: bool) -> Column:
    """(total, count) of the numeric leaves below `c`. NULL counts as nothing;
    NaN is skipped or carried according to `ignore_na`."""
    nothing = _pair(F.lit(0.0), F.lit(0))
    if isinstance(kind, T.NumericType):
        missing = c.isNull()
        if ignore_na and isinstance(kind, (T.DoubleType, T.FloatType)):
            missing = missing | F.isnan(c)
        return F.when(missing, nothing).otherwise(_pair(c, F.lit(1)))
    if isinstance(kind, T.ArrayType):
        inside = F.aggregate(c, nothing, lambda t, e: _add(t, _walk(e, kind.elementType, exclude, ignore_na)))
        return F.coalesce(inside, nothing)
    if isinstance(kind, T.MapType):
        kept = F.map_filter(c, lambda k, v: ~k.cast("string").isin(sorted(exclude))) if exclude else c
        return _walk(F.map_values(kept), T.ArrayType(kind.valueType), exclude, ignore_na)
    if isinstance(kind, T.StructType):
        parts = [_walk(c[f.name], f.dataType, exclude, ignore_na) for f in kind.fields if f.name not in exclude]
        return reduce(_add, parts, nothing)
    return nothing


def deep_sum_count(df: DataFrame, col: str, out: str, exclude: Sequence[str] = (), ignore_na: bool = True) -> DataFrame:
    """Add `{out}_sum` and `{out}_count` over all numeric leaves of a column."""
    pair = _walk(F.col(col), df.schema[col].dataType, frozenset(exclude), ignore_na)
    return df.withColumn("__pair", pair).withColumns(
        {f"{out}_sum": F.col("__pair.total"), f"{out}_count": F.col("__pair.n")}).drop("__pair")


def deep_sum(df: DataFrame, col: str, out: str, exclude: Sequence[str] = (), ignore_na: bool = True) -> DataFrame:
    pair = _walk(F.col(col), df.schema[col].dataType, frozenset(exclude), ignore_na)
    return df.withColumn(out, pair["total"])


def _leaves(c: Column, kind: T.DataType, path: Column, exclude: frozenset[str]) -> Column | None:
    """Array of (path, value) below `c`; None if the type holds no numbers."""
    if isinstance(kind, T.NumericType):
        return F.when(c.isNotNull(), F.array(F.struct(path.alias("path"), c.cast("double").alias("value")))).otherwise(
            F.array().cast("array<struct<path:string,value:double>>"))
    if isinstance(kind, T.ArrayType):
        if _leaves(c, kind.elementType, path, exclude) is None:
            return None
        inside = F.transform(c, lambda e, i: _leaves(e, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), exclude))
    elif isinstance(kind, T.MapType):
        if _leaves(c, kind.valueType, path, exclude) is None:
            return None
        kept = F.map_filter(c, lambda k, v: ~k.cast("string").isin(sorted(exclude))) if exclude else c
        inside = F.transform(F.map_entries(kept), lambda e: _leaves(
            e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")), exclude))
    elif isinstance(kind, T.StructType):
        parts = [_leaves(c[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), exclude)
                 for f in kind.fields if f.name not in exclude]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    else:
        return None
    return F.coalesce(F.flatten(inside), F.array().cast("array<struct<path:string,value:double>>"))


def numeric_leaves(df: DataFrame, col: str, keep: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """One row per numeric leaf: kept columns, `path`, `value`."""
    found = _leaves(F.col(col), df.schema[col].dataType, F.lit(col), frozenset(exclude))
    if found is None:
        raise ValueError(f"{col} holds no numbers")
    return df.select(*keep, F.explode(found).alias("leaf")).select(*keep, "leaf.path", "leaf.value")


def flatten_lists(df: DataFrame, col: str) -> DataFrame:
    """Flatten arrays of arrays to one level, however deep the type is."""
    kind, out = df.schema[col].dataType, F.col(col)
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        # A NULL inner list adds nothing; plain `flatten` would void the whole row.
        out, kind = F.flatten(F.filter(out, lambda e: e.isNotNull())), T.ArrayType(kind.elementType.elementType)
    return df.withColumn(col, out)
