"""Corrections for having tried many policies: reality check, overfitting probability, deflated Sharpe."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.numeric import normal_cdf
from pitsignal.operators.resampling import resampled_means

_EULER = 0.5772156649015329


def reality_check(
    improvements: DataFrame, keys: Sequence[str], policies: Sequence[str], order: Sequence[str], *, samples: int, seed: int, block: int
) -> DataFrame:
    """p-value of the best mean improvement against the centred block-bootstrap maximum.

    One row per episode with a column per policy: all policies share a resample's draws.
    """
    keys = list(keys)
    means = improvements.groupBy(*keys).agg(*[F.avg(p).alias(f"_m_{p}") for p in policies])
    best = F.greatest(*[F.col(f"_m_{p}") for p in policies])
    drawn = resampled_means(improvements, keys, policies, order, samples=samples, seed=seed, block=block)
    centred = F.greatest(*[F.col(p) - F.col(f"_m_{p}") for p in policies])
    joined = drawn.join(means.withColumn("best_mean_improvement", best), keys)
    exceed = F.count(F.when(centred >= F.col("best_mean_improvement"), 1))
    return joined.groupBy(*keys, "best_mean_improvement").agg(((exceed + 1) / (F.lit(samples) + 1)).alias("p_value"))


def overfitting_probability(returns: DataFrame, keys: Sequence[str], *, order: Sequence[str], blocks: int = 6) -> DataFrame:
    """Share of train/test splits whose in-sample winner ranks in the lower half out of sample.

    Long input (policy, return). The series is cut into contiguous blocks and reduced to sums per
    (policy, block); the splits are all halves of the blocks, a list fixed by their number.
    """
    keys = list(keys)
    dates = returns.select(*keys, *order).distinct()
    cut = dates.withColumn("_block", F.ntile(blocks).over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    sums = (
        returns.join(cut, [*keys, *order])
        .groupBy(*keys, "policy", "_block")
        .agg(F.sum("return").alias("_s"), F.count("return").alias("_c"))
    )
    halves = [list(c) for c in itertools.combinations(range(blocks), blocks // 2)]
    splits = F.array(*[F.struct(F.lit(i).alias("split"), F.array(*[F.lit(b) for b in half]).alias("train")) for i, half in enumerate(halves)])
    long = sums.withColumn("_sp", F.explode(splits))
    inside = F.array_contains("_sp.train", F.col("_block"))
    mean = lambda cond: F.sum(F.when(cond, F.col("_s"))) / F.sum(F.when(cond, F.col("_c")))
    scored = long.groupBy(*keys, F.col("_sp.split").alias("split"), "policy").agg(mean(inside).alias("_is"), mean(~inside).alias("_oos"))
    per_split = Window.partitionBy(*keys, "split")
    ranked = scored.withColumn("_rank", F.rank().over(per_split.orderBy("_oos"))).withColumn("_n", F.count(F.lit(1)).over(per_split))
    winner = ranked.withColumn("_first", F.row_number().over(per_split.orderBy(F.desc("_is"), "policy"))).where(F.col("_first") == 1)
    share = F.col("_rank") / (F.col("_n") + 1)
    logits = winner.select(*keys, "split", F.log(share / (1 - share)).alias("_logit"))
    return logits.groupBy(*keys).agg(
        F.avg(F.when(F.col("_logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"),
        F.count(F.lit(1)).alias("splits"),
        F.percentile("_logit", 0.5).alias("median_logit"),
    )


def expected_max_factor(trials: int) -> float:
    """Expected maximum of `trials` standard normals, up to the spread of the trial Sharpe ratios."""
    if trials < 2:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - _EULER) * inv(1 - 1 / trials) + _EULER * inv(1 - 1 / (trials * math.e))


def deflated_sharpe(returns: DataFrame, keys: Sequence[str], *, trials: int) -> DataFrame:
    """Probability that a policy's Sharpe ratio exceeds the best one expected from `trials` tries."""
    keys = list(keys)
    x = F.col("return")
    moments = returns.groupBy(*keys, "policy").agg(
        F.count(x).alias("count"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.skewness(x).alias("_skew"), F.kurtosis(x).alias("_excess")
    )
    ratios = moments.withColumn("sharpe", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")))
    spread = F.stddev_samp("sharpe").over(Window.partitionBy(*keys))
    sr, bar = F.col("sharpe"), F.col("benchmark")
    shape = 1 - F.col("_skew") * sr + (F.col("_excess") + 2) / 4 * sr * sr
    z = (sr - bar) * F.sqrt(F.col("count") - 1) / F.sqrt(shape)
    return ratios.withColumn("benchmark", spread * expected_max_factor(trials)).select(
        *keys, "policy", "count", "sharpe", "benchmark", normal_cdf(z).alias("deflated_probability")
    )


def loo_period_min(improvements: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Smallest mean improvement after leaving one period out: group total minus period sums."""
    keys = list(keys)
    parts = improvements.groupBy(*keys, period).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    whole = Window.partitionBy(*keys)
    rest = parts.withColumn("_rs", F.sum("_s").over(whole) - F.col("_s")).withColumn("_rc", F.sum("_c").over(whole) - F.col("_c"))
    return rest.groupBy(*keys).agg(
        F.min(F.when(F.col("_rc") > 0, F.col("_rs") / F.col("_rc"))).alias("loo_period_min"), F.count(F.lit(1)).alias("periods")
    )


def half_improvements(improvements: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Mean improvement of the chronological first and second half."""
    half = F.ntile(2).over(Window.partitionBy(*keys).orderBy(*order))
    tagged = improvements.withColumn("_half", half)
    return tagged.groupBy(*keys).agg(
        F.avg(F.when(F.col("_half") == 1, F.col(value))).alias("first_half"), F.avg(F.when(F.col("_half") == 2, F.col(value))).alias("second_half")
    )


def promotion_gates(gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All gates and-ed per candidate, with the names of the failing ones. Input: gate, passed."""
    failed = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("gate"))))
    return gates.groupBy(*keys).agg(F.bool_and("passed").alias("promoted"), failed.alias("failed_gates"))


def released_holdout(holdout: DataFrame, promoted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Holdout rows of promoted candidates only; without a winner nothing is read out."""
    return holdout.join(promoted.where("promoted").select(*keys), list(keys), "left_semi")
