"""Point-in-time feature of any session, and its scoring against earlier residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.numeric import EPS
from pitsignal.operators.episodes import episode_frame


def live_features(
    raw: DataFrame,
    *,
    lookback: int,
    threshold: float,
    history_days: int = 120,
    min_history: int = 10,
    approved_reason: str = "residual_at_or_above_threshold",
) -> DataFrame:
    """Full-lookback beta, residual, z-score against earlier residuals, and the approval.

    A session may only use rows whose prior close lies within `history_days` before it. The
    z-score history is every earlier row of that window that itself has `lookback` rows before it.
    The collected history is bounded by `history_days` rows.
    """
    frame = episode_frame(raw, [lookback], full_window=True).withColumn("_day", F.unix_date("session_date"))
    back = Window.partitionBy("symbol").orderBy("_day").rangeBetween(-history_days, -1)
    row = F.struct(F.unix_date(F.to_date("prior_ts")).alias("prior_day"), F.col("residual").alias("residual"))
    start = F.col("_day") - history_days
    usable = F.filter(F.col("_back"), lambda e: e["prior_day"] >= start)
    scored = (
        frame.withColumn("_back", F.collect_list(row).over(back))
        .withColumn("_rows", usable)
        .where((F.size("_rows") >= lookback) & F.col("beta").isNotNull() & (F.unix_date(F.to_date("prior_ts")) >= start))
        .withColumn(
            "_history",
            F.filter(
                F.transform(F.slice(F.col("_rows"), lookback + 1, history_days + 1), lambda e: e["residual"]),
                lambda x: x.isNotNull(),
            ),
        )
    )
    n = F.size("_history")
    mean = F.aggregate("_history", F.lit(0.0), lambda acc, x: acc + x) / n
    spread = F.aggregate("_history", F.lit(0.0), lambda acc, x: acc + (x - F.col("_mean")) * (x - F.col("_mean")))
    std = F.sqrt(F.col("_spread") / (n - 1))
    return (
        scored.withColumn("_mean", F.when(n > 0, mean))
        .withColumn("_spread", F.when(n > 1, spread))
        .withColumn("_std", F.when(n > 1, std))
        .select(
            "symbol",
            "session_date",
            "driver_return",
            "prior_close",
            "premarket_price",
            "premarket_return",
            "beta",
            "expected_return",
            "residual",
            "opening_return",
            n.cast("bigint").alias("history_count"),
            F.when((n >= min_history) & (F.col("_std") > EPS), (F.col("residual") - F.col("_mean")) / F.col("_std")).alias("residual_z"),
            (F.abs("residual") >= threshold).alias("approved"),
            F.when(F.abs("residual") >= threshold, approved_reason).otherwise("residual_below_frozen_threshold").alias("reason"),
        )
    )


def signal_evidence(
    features: DataFrame, *, approved_symbols: Sequence[str] | None = None, historical_mean: float | None = None
) -> DataFrame:
    """The evidence of a live signal: approval and reason, z-score, and the mean return of the frozen study.

    `features` is the result of live_features. A symbol outside the allow-list is refused before its
    residual is looked at, and carries neither score nor mean.
    """
    listed = F.lit(True) if approved_symbols is None else F.col("symbol").isin(list(approved_symbols))
    return features.select(
        "symbol",
        "session_date",
        (listed & F.col("approved")).alias("approved"),
        F.when(~listed, "underlying_not_approved").otherwise(F.col("reason")).alias("reason"),
        F.when(listed, F.col("residual_z")).alias("residual_z"),
        F.when(listed, F.lit(historical_mean).cast("double")).alias("historical_mean_signed_return"),
    )
