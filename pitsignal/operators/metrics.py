"""Return summaries, leave-one-out closed forms, regression slopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.numeric import EPS, finite
from pitsignal.operators.quantiles import exact_quantiles


def loo_max_mean_impact(n: Column, mean: Column, low: Column, high: Column) -> Column:
    """Largest change of the mean when one value is left out.

    mean - mean_without(x) = (x - mean) / (n - 1), so the extremes decide; with a single value
    the impact is the mean itself.
    """
    widest = F.greatest(high - mean, mean - low)
    return F.when(n > 1, widest / (n - 1)).when(n == 1, F.abs(mean))


def loo_min_mean(n: Column, total: Column, high: Column) -> Column:
    """Smallest mean after leaving one value out: the largest value goes."""
    return F.when(n > 1, (total - high) / (n - 1)).when(n == 1, total)


def _partials(x: Column) -> list[Column]:
    hit = F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)
    return [
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.avg(hit).alias("hit_rate"),
        F.stddev_samp(x).alias("_std"),
        F.sum(x).alias("total"),
        F.min(x).alias("worst"),
        F.max(x).alias("best"),
    ]


def _finish(df: DataFrame, keys: Sequence[str], *, empty_as_zero: bool) -> DataFrame:
    n = F.col("count")
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if empty_as_zero else (lambda c: c)
    error = F.when(n > 1, F.col("_std") / F.sqrt(n)).when(n == 1, 0.0)
    impact = loo_max_mean_impact(n, F.col("mean"), F.col("worst"), F.col("best"))
    return df.select(
        *keys,
        "count",
        fill(F.col("mean")).alias("mean"),
        fill(F.col("median")).alias("median"),
        fill(F.col("hit_rate")).alias("hit_rate"),
        fill(error).alias("standard_error"),
        fill(F.col("total")).alias("total"),
        fill(F.col("worst")).alias("worst"),
        fill(F.col("best")).alias("best"),
        fill(impact).alias("loo_max_mean_impact"),
    )


def summarize(df: DataFrame, keys: Sequence[str], value: str, *, empty_as_zero: bool = True) -> DataFrame:
    """Summary of the finite values of each group, in one hash aggregation.

    The exact median keeps a group's distinct values in one buffer, so this form is for groups
    bounded by the calendar (sessions of a symbol); `summarize_large` has no such bound.
    """
    x = finite(F.col(value))
    grouped = df.groupBy(*keys).agg(*_partials(x), F.percentile(x, 0.5).alias("median"))
    return _finish(grouped, keys, empty_as_zero=empty_as_zero)


def summarize_large(df: DataFrame, keys: Sequence[str], value: str, *, empty_as_zero: bool = True) -> DataFrame:
    """The same summary for groups of any size: partial aggregation plus a distributed median."""
    clean = df.select(*keys, finite(F.col(value)).alias("_x"))
    sums = clean.groupBy(*keys).agg(*_partials(F.col("_x")))
    median = exact_quantiles(clean, keys, "_x", {"median": 0.5})
    return _finish(sums.join(median, list(keys), "left"), keys, empty_as_zero=empty_as_zero)


def ols_slope(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope of y on x over finite pairs; null below two pairs or when x is constant."""
    fx, fy = finite(F.col(x)), finite(F.col(y))
    fx, fy = F.when(fy.isNotNull(), fx), F.when(fx.isNotNull(), fy)
    fitted = df.groupBy(*keys).agg(
        F.regr_slope(fy, fx).alias("_slope"), F.regr_sxx(fy, fx).alias("_sxx"), F.regr_count(fy, fx).alias("pair_count")
    )
    return fitted.select(
        *keys, "pair_count", F.when((F.col("pair_count") >= 2) & (F.col("_sxx") > EPS), F.col("_slope")).alias("slope")
    )
