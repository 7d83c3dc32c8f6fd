"""Divergences between distributions, and distributions from moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _kl_term(a: Column, p: Column, base: float) -> Column:
    """a·log(a/p); 0·log 0 is 0, and mass where `p` has none is infinite."""
    return (F.when(a > 0, F.when(p > 0, a * (F.log(a) - F.log(p)) / F.log(F.lit(float(base))))
                   .otherwise(F.lit(float("inf")))).otherwise(F.lit(0.0)))


def kl_divergence(df: DataFrame, keys: Sequence[str], a: str, p: str, base: float = 2) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(_kl_term(F.col(a), F.col(p), base)).alias("kl"))


def _js_term(a: Column, p: Column, base: float) -> Column:
    m = (a + p) / 2
    return (_kl_term(a, m, base) + _kl_term(p, m, base)) / 2


def js_divergence(df: DataFrame, keys: Sequence[str], a: str, p: str, base: float = 2) -> DataFrame:
    """Jensen-Shannon divergence (not its square root), in one aggregate."""
    return df.groupBy(*keys).agg(F.sum(_js_term(F.col(a), F.col(p), base)).alias("jsd"))


def js_divergence_rows(df: DataFrame, dist: str, classes: Sequence[str], out: str = "jsd", base: float = 2) -> DataFrame:
    """Per row: divergence of a map `class -> share` from predicted class columns.

    Classes missing from the map, and NULL predictions, count as 0.
    """
    zero = F.lit(0.0)
    terms = [_js_term(F.coalesce(F.try_element_at(F.col(dist), F.lit(c)), zero), F.coalesce(F.col(c), zero), base)
             for c in classes]
    return df.withColumn(out, sum(terms[1:], terms[0]))


def count_moments(df: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """`mean`, `std` and `var` (sample moments) of whole numbers per group.

    They come from whole sums, so equal fractions are equal numbers and the order
    of rows changes nothing; `std` and `var` are NULL for a single row.
    """
    n = F.col(count).cast("decimal(19,0)")
    d = df.filter(n.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("decimal(19,0)").alias("__k"), F.sum(n).alias("__s"), F.sum(n * n).alias("__q"))
    k, s, q = F.col("__k"), F.col("__s"), F.col("__q")
    real = lambda c: c.cast("double")
    return d.withColumn("var", F.when(k > 1, real(k * q - s * s) / real(k * (k - 1)))).select(
        *keys, (real(s) / real(k)).alias("mean"), F.sqrt("var").alias("std"), "var")


def nb_params(df: DataFrame, mean: str = "mean", std: str = "std", var: str | None = None) -> DataFrame:
    """Negative-binomial `nb_p`, `nb_n` from moments; NULL unless variance > mean.

    The square of a rounded deviation can pass a mean that the variance equals:
    give the variance itself as `var` (see `count_moments`) where that matters.
    """
    mu, var = F.col(mean), F.col(var) if var else F.col(std) * F.col(std)
    ok = (var > mu) & (mu > 0)
    return df.withColumns({"nb_p": F.when(ok, mu / var), "nb_n": F.when(ok, mu * mu / (var - mu))})


def _support(df: DataFrame, mean: str, std: str, spread: float) -> DataFrame:
    lo = F.greatest(F.floor(F.col(mean) - spread * F.col(std)), F.lit(0))
    hi = F.greatest(F.ceil(F.col(mean) + spread * F.col(std)), F.lit(0))
    return df.withColumn("support", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))


def _normalised(df: DataFrame, keys: Sequence[str], log_weight: str) -> DataFrame:
    """Shares from log weights; a group is the support of one distribution."""
    all_rows = Window.partitionBy(*keys)
    d = df.withColumn("__w", F.exp(F.col(log_weight) - F.max(log_weight).over(all_rows)))
    return d.withColumn("prob", F.col("__w") / F.sum("__w").over(all_rows)).select(*keys, "support", "prob")


def nb_probabilities(df: DataFrame, keys: Sequence[str], spread: float, mean: str = "mean", std: str = "std",
                     var: str | None = None) -> DataFrame:
    """Negative-binomial shares on the integers within `spread` deviations.

    `keys` identify one distribution. Shares are normalised over the support,
    so only ratios of neighbouring probabilities are needed:
    pmf(k)/pmf(k-1) = (n+k-1)/k · (1-p).
    """
    d = _support(nb_params(df, mean, std, var).filter("nb_p IS NOT NULL"), mean, std, spread)
    w = Window.partitionBy(*keys).orderBy("support")
    k = F.col("support")
    step = F.when(F.lag("support").over(w).isNull(), F.lit(0.0)).otherwise(
        F.log(F.col("nb_n") + k - 1) - F.log(k.cast("double")) + F.log1p(-F.col("nb_p")))
    d = d.withColumn("__step", step)
    d = d.withColumn("__log", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _normalised(d, keys, "__log")


def norm_probabilities(df: DataFrame, keys: Sequence[str], spread: float, mean: str = "mean", std: str = "std") -> DataFrame:
    """Normal densities on the same support, normalised to 1."""
    d = _support(df.filter(F.col(std) > 0), mean, std, spread)
    z = (F.col("support") - F.col(mean)) / F.col(std)
    return _normalised(d.withColumn("__log", -0.5 * z * z), keys, "__log")
