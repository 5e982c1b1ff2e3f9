"""Bootstrap on hashed draws: a draw depends on seed, resample and position only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.numeric import hash_digest, hash_index
from pitsignal.schemas import require_positive


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Zero-based position and size of each series; a series is bounded by its sessions."""
    keys = list(keys)
    by_key = Window.partitionBy(*keys)
    return df.withColumn("_pos", F.row_number().over(by_key.orderBy(*order)) - 1).withColumn(
        "_size", F.count(F.lit(1)).over(by_key)
    )


def _draw_table(spots: DataFrame, keys: list[str], samples: int, seed: Column | int, block: int) -> DataFrame:
    """For every resample and target position, the source position it takes."""
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    each = spots.select(*keys, "_pos", "_size", seed_col.alias("_seed")).withColumn(
        "_sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))
    )
    start = F.floor(F.col("_pos") / block).cast("bigint")
    offset = F.col("_pos") % block
    # block starts are drawn so that every block fits inside the series
    starts = F.greatest(F.col("_size") - block + 1, F.lit(1))
    first = hash_index(hash_digest(F.col("_seed"), F.col("_sample"), start), starts)
    return each.select(*keys, "_sample", F.least(first + offset, F.col("_size") - 1).alias("_pos"))


def resampled_means(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str], *, samples: int, seed: Column | int, block: int = 1
) -> DataFrame:
    """Mean of every value column in every resample (block 1 is the plain bootstrap).

    Draws are joined to the series by (key, position); the join side is the original series, so
    the optimizer broadcasts it when it is small and shuffles by position otherwise.
    """
    require_positive(samples=samples, block=block)
    keys = list(keys)
    spots = positions(df.select(*keys, *order, *values), keys, order)
    draws = _draw_table(spots, keys, samples, seed, block)
    series = spots.select(*keys, "_pos", *values)
    return (
        draws.join(series, [*keys, "_pos"])
        .groupBy(*keys, "_sample")
        .agg(*[F.avg(v).alias(v) for v in values])
    )


def bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order: Sequence[str],
    *,
    samples: int,
    seed: Column | int,
    block: int = 1,
    level: float = 0.95,
) -> DataFrame:
    """Two-sided interval of the mean with linear quantiles over the resampled means."""
    means = resampled_means(df, keys, [value], order, samples=samples, seed=seed, block=block)
    tail = (1 - level) / 2
    return means.groupBy(*keys).agg(
        F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci")
    ).select(*keys, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))
