"""Exit-horizon and threshold-boundary studies on a frozen signal."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.numeric import finite
from pitsignal.operators.metrics import loo_min_mean
from pitsignal.operators.resampling import bootstrap_ci
from pitsignal.schemas import require_columns, require_increasing, require_positive

_TOLERANCE = 1e-12


@dataclass(frozen=True)
class HorizonStudy:
    # fixed values: the frozen policy under study
    minutes: tuple[int, ...] = (15, 30, 45, 60, 90, 120)
    baseline: int = 60
    threshold: float = 0.01
    min_training: int = 40
    samples: int = 10_000
    seed: int = 20260901
    min_episodes: int = 5


def complete_cases(frame: DataFrame, columns: Sequence[str], min_training: int) -> DataFrame:
    """Rows with every column finite and a full training history: one sample for all variants."""
    require_columns(frame, ["session_date", "training_count", *columns], "study frame")
    masked = frame.select(*[finite(F.col(c)).alias(c) if c in columns else F.col(c) for c in frame.columns])
    return masked.dropna(subset=["session_date", "training_count", *columns]).where(F.col("training_count") >= min_training)


def horizon_sample(frame: DataFrame, study: HorizonStudy) -> DataFrame:
    """Long form: (symbol, session, minutes) with the signed return and its baseline on the same row."""
    names = [f"forward_{m}m_return" for m in study.minutes]
    rows = complete_cases(frame, ["residual", *names], study.min_training).where(F.abs("residual") >= study.threshold)
    sign = F.signum("residual")
    base = sign * F.col(f"forward_{study.baseline}m_return")
    entries = [F.struct(F.lit(m).alias("minutes"), (sign * F.col(c)).alias("signed")) for m, c in zip(study.minutes, names)]
    return (
        rows.select("symbol", "session_date", base.alias("base_signed"), F.explode(F.array(*entries)).alias("_h"))
        .select("symbol", "session_date", "_h.*", "base_signed")
        .withColumn("improvement", F.col("signed") - F.col("base_signed"))
    )


def _hit(x: Column) -> Column:
    return F.avg(F.when(x > 0, 1.0).otherwise(0.0))


def yearly_not_worse(sample: DataFrame) -> DataFrame:
    """True when no calendar year has a mean below the baseline's mean of that year."""
    yearly = sample.groupBy("symbol", "minutes", F.year("session_date").alias("year")).agg(
        (F.avg("signed") >= F.avg("base_signed") - _TOLERANCE).alias("_ok")
    )
    return yearly.groupBy("symbol", "minutes").agg(F.bool_and("_ok").alias("yearly_not_worse"))


def horizon_study(frame: DataFrame, study: HorizonStudy = HorizonStudy()) -> DataFrame:
    """One row per (symbol, horizon) with paired improvement, interval, flags and eligibility."""
    sample = horizon_sample(frame, study)
    keys = ["symbol", "minutes"]
    signed, base, gain = F.col("signed"), F.col("base_signed"), F.col("improvement")
    stats = sample.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(signed).alias("mean_signed_return"),
        F.percentile(signed, 0.5).alias("median_signed_return"),
        _hit(signed).alias("hit_rate"),
        F.percentile(base, 0.5).alias("_base_median"),
        _hit(base).alias("_base_hit"),
        F.avg(gain).alias("paired_mean_improvement"),
        loo_min_mean(F.count(F.lit(1)), F.sum(gain), F.max(gain)).alias("loo_min_improvement"),
    )
    interval = bootstrap_ci(
        sample, keys, "improvement", ["session_date"], samples=study.samples, seed=F.col("minutes") + F.lit(study.seed)
    )
    table = stats.join(interval, keys).join(yearly_not_worse(sample), keys)
    table = table.withColumn(
        "median_not_worse", F.col("median_signed_return") >= F.col("_base_median") - _TOLERANCE
    ).withColumn("hit_rate_not_worse", F.col("hit_rate") >= F.col("_base_hit") - _TOLERANCE)
    eligible = (
        (F.col("minutes") != study.baseline)
        & (F.col("count") >= study.min_episodes)
        & (F.col("paired_mean_improvement") > 0)
        & (F.col("ci_low") > 0)
        & (F.col("loo_min_improvement") > 0)
        & F.col("median_not_worse")
        & F.col("hit_rate_not_worse")
        & F.col("yearly_not_worse")
    )
    return table.withColumn("eligible", eligible).drop("_base_median", "_base_hit")


def recommended_horizon(table: DataFrame, baseline: int = 60) -> DataFrame:
    """Best eligible horizon by improvement, then nearness to the baseline, then shortness."""
    rank = F.struct(
        F.col("paired_mean_improvement"), (-F.abs(F.col("minutes") - baseline)).alias("near"), (-F.col("minutes")).alias("short")
    )
    best = F.max_by("minutes", F.when(F.col("eligible"), rank))
    picked = F.coalesce(best, F.lit(baseline))
    return table.groupBy("symbol").agg(
        picked.alias("recommended_minutes"), (picked != baseline).alias("promoted"), F.max("count").alias("episode_count")
    )


def study_header(frame: DataFrame, table: DataFrame, study: HorizonStudy = HorizonStudy(), *, policy: str = "frozen") -> DataFrame:
    """What was studied, per symbol: the frozen policy's figures, the sample's span, and the recommendation.

    `table` is the horizon_study of the same frame. A frame without one complete episode raises.
    """
    base = horizon_sample(frame, study).where(F.col("minutes") == study.baseline)
    if not base.limit(1).count():
        raise ValueError("no episode has every horizon, a full history and a signal")
    spans = base.groupBy("symbol").agg(F.min("session_date").alias("sample_start"), F.max("session_date").alias("sample_end"))
    fixed = {
        "policy": F.lit(policy),
        "threshold": F.lit(study.threshold),
        "minimum_training_count": F.lit(study.min_training),
        "baseline_minutes": F.lit(study.baseline),
        "tested_minutes": F.array(*[F.lit(m) for m in study.minutes]),
    }
    return spans.withColumns(fixed).join(recommended_horizon(table, study.baseline), "symbol")


@dataclass(frozen=True)
class BoundaryStudy:
    # fixed values: the frozen gate, its declared neighbours and the descriptive grid
    thresholds: tuple[float, ...] = (0.008, 0.009, 0.010, 0.011, 0.012)
    baseline: float = 0.010
    lower: float = 0.009
    upper: float = 0.011
    min_training: int = 40
    min_signals: int = 20
    horizon: str = "forward_60m_return"

    def __post_init__(self) -> None:
        require_positive(min_signals=self.min_signals, min_training=self.min_training)
        require_increasing(self.thresholds, contains=(self.baseline, self.lower, self.upper))


def boundary_sample(frame: DataFrame, study: BoundaryStudy) -> DataFrame:
    rows = complete_cases(frame, ["residual", study.horizon], study.min_training)
    return rows.select(
        "symbol",
        "session_date",
        F.year("session_date").alias("year"),
        F.abs("residual").alias("magnitude"),
        (F.signum("residual") * F.col(study.horizon)).alias("signed"),
    )


def _masked_summary(keep: Column) -> list[Column]:
    """Null statistics for an empty sample, rounded to twelve digits."""
    x = F.when(keep, F.col("signed"))
    return [
        F.count(x).alias("count"),
        F.round(F.avg(x), 12).alias("mean_signed_return"),
        F.round(F.percentile(x, 0.5), 12).alias("median_signed_return"),
        F.round(F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)), 12).alias("hit_rate"),
    ]


def threshold_sweep(sample: DataFrame, study: BoundaryStudy) -> DataFrame:
    """Per threshold the total (year null) and the calendar years, in one grouping-sets pass."""
    levels = sample.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in study.thresholds])))
    keep, base = F.col("magnitude") >= F.col("threshold"), F.col("magnitude") >= study.baseline
    sets = levels.groupingSets([["symbol", "threshold"], ["symbol", "threshold", "year"]], "symbol", "threshold", "year")
    table = sets.agg(
        *_masked_summary(keep),
        F.count(F.when(keep & base, 1)).alias("baseline_overlap_count"),
        F.count(F.when(base, 1)).alias("_base"),
        F.grouping("year").alias("_total"),
    )
    share = lambda den: F.when(den > 0, F.round(F.col("baseline_overlap_count") / den, 12))
    return table.select(
        "symbol",
        "threshold",
        F.when(F.col("_total") == 0, F.col("year")).alias("year"),
        "count",
        "mean_signed_return",
        "median_signed_return",
        "hit_rate",
        "baseline_overlap_count",
        share(F.col("_base")).alias("baseline_overlap_rate"),
        share(F.col("count")).alias("baseline_share_of_selected"),
    )


def boundary_shells(sample: DataFrame, study: BoundaryStudy) -> DataFrame:
    """Half-open shells below and above the frozen gate."""
    shells = [(study.lower, study.baseline), (study.baseline, study.upper)]
    tagged = sample.withColumn(
        "_shell", F.explode(F.array(*[F.struct(F.lit(a).alias("shell_low"), F.lit(b).alias("shell_high")) for a, b in shells]))
    ).select("*", "_shell.*")
    keep = (F.col("magnitude") >= F.col("shell_low")) & (F.col("magnitude") < F.col("shell_high"))
    return tagged.groupBy("symbol", "shell_low", "shell_high").agg(*_masked_summary(keep))


def boundary_warnings(sweep: DataFrame, study: BoundaryStudy) -> DataFrame:
    """Local robustness per symbol: the ordered warnings, robust exactly when there is none."""
    total = sweep.where(F.col("year").isNull())
    pick = lambda level, name: F.max(F.when(F.col("threshold") == level, F.col(name)))
    sides = {"base": study.baseline, "lower_neighbor": study.lower, "upper_neighbor": study.upper}
    wide = total.groupBy("symbol").agg(
        *[
            pick(level, name).alias(f"{side}_{short}")
            for side, level in sides.items()
            for short, name in (("n", "count"), ("mean", "mean_signed_return"), ("median", "median_signed_return"), ("hit", "hit_rate"))
        ]
    )
    bad = lambda c, test: c.isNull() | test
    base_mean = F.col("base_mean")
    notes = [F.when(bad(base_mean, base_mean <= 0), "baseline_nonpositive_mean")]
    for side in ("lower_neighbor", "upper_neighbor"):
        n, mean, median, hit = (F.col(f"{side}_{s}") for s in ("n", "mean", "median", "hit"))
        notes += [
            F.when(n < study.min_signals, f"{side}_insufficient_signals"),
            F.when(bad(mean, mean <= 0), f"{side}_nonpositive_mean"),
            F.when(bad(median, median <= 0), f"{side}_nonpositive_median"),
            F.when(bad(hit, hit < 0.5), f"{side}_hit_rate_below_50pct"),
            F.when((base_mean > 0) & bad(mean, mean < base_mean * 0.5), f"{side}_mean_below_half_baseline"),
        ]
    listed = F.array_compact(F.array(*notes))
    return wide.select("symbol", listed.alias("warnings"), (F.size(listed) == 0).alias("local_boundary_robust"))
