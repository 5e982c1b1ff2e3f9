"""Episode assembly: one row per (symbol, session) under strict information boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions import clock
from pitsignal.functions.clock import SessionSpec
from pitsignal.functions.numeric import EPS, expected_return, finite, guarded_return
from pitsignal.operators.asof import asof_backward
from pitsignal.schemas import require_columns, require_positive
from pitsignal.session import cut_lineage


def day_facts(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Everything a session needs from one symbol's day, in one aggregation over the bars.

    Boundary prices are opens of the bar stamped exactly at the boundary, null when that bar is
    absent or not unique. The regular close is the close of the last regular-hours bar.
    """
    require_columns(bars, ("symbol", "ts", "open", "close"), "bars")
    timed = bars.select(
        "symbol",
        clock.local_date(F.col("ts"), spec.tz).alias("session_date"),
        "ts",
        finite(F.col("open")).alias("open"),
        finite(F.col("close")).alias("close"),
        clock.local_micros(F.col("ts"), spec.tz).alias("_us"),
    )
    us = F.col("_us")
    regular = clock.regular_hours(us, spec) & F.col("close").isNotNull()
    premarket = clock.between_minutes(us, clock.minutes(spec.premarket_start), clock.minutes(spec.freeze), include_end=True)
    aggregates: list[Column] = [
        F.max(F.when(regular, F.col("ts"))).alias("regular_close_ts"),
        F.max_by("close", F.when(regular, F.col("ts"))).alias("regular_close"),
        F.count(F.when(premarket, 1)).alias("premarket_bars"),
    ]
    for name, minute in spec.boundaries().items():
        here = f"_us = {minute * 60_000_000}L"
        aggregates += [
            F.expr(f"count(CASE WHEN {here} THEN 1 END) AS _n_{name}"),
            F.expr(f"max(CASE WHEN {here} THEN open END) AS _p_{name}"),
        ]
    facts = timed.groupBy("symbol", "session_date").agg(*aggregates)
    prices = [f"CASE WHEN _n_{name} = 1 THEN _p_{name} END AS {name}_price" for name in spec.boundaries()]
    return facts.selectExpr("symbol", "session_date", "regular_close_ts", "regular_close", "premarket_bars", *prices)


def with_prior_close(facts: DataFrame) -> DataFrame:
    """Attach the last regular close of an earlier local date, over any gap.

    The window runs over one row per (symbol, date), so its size is bounded by the calendar.
    """
    earlier = Window.partitionBy("symbol").orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    closing = F.when(F.col("regular_close").isNotNull(), F.struct("regular_close_ts", "regular_close"))
    prior = F.last(closing, ignorenulls=True).over(earlier)
    return (
        facts.withColumn("_prior", prior)
        .withColumn("prior_ts", F.col("_prior.regular_close_ts"))
        .withColumn("prior_close", F.col("_prior.regular_close"))
        .drop("_prior")
    )


def raw_episodes(
    bars: DataFrame,
    sessions: DataFrame,
    *,
    driver: str,
    symbols: Sequence[str],
    spec: SessionSpec,
    premarket_gate: bool = True,
    cut: bool = True,
) -> DataFrame:
    """Join driver and equity facts per session and drop sessions with a missing boundary.

    `sessions` is any frame with `session_date`: business days for research, days that have bars
    for the live feature. Optional boundaries (open, confirm, decision, horizons) stay nullable.

    The facts have one row per (symbol, day) and feed three branches, so they are checkpointed
    (`cut`): the bars of the universe are scanned once and everything after works on the facts.
    The as-of path reads the driver's bars alone, which a symbol-partitioned table prunes to.
    """
    facts = day_facts(bars.where(F.col("symbol").isin([driver, *symbols])), spec)
    if cut:
        facts = cut_lineage(facts)
    equity = with_prior_close(facts.where(F.col("symbol").isin(list(symbols))))
    equity = equity.join(sessions.select("session_date"), "session_date", "left_semi")
    if premarket_gate:
        equity = equity.where(F.col("premarket_bars") > 0)
    equity = equity.where(
        F.col("freeze_price").isNotNull() & (F.col("prior_close") > 0)
    ).withColumn("driver", F.lit(driver))

    driver_bars = bars.where(F.col("symbol") == driver)
    driver_at_freeze = facts.where(F.col("symbol") == driver).select("session_date", F.col("freeze_price").alias("driver_end"))
    path = driver_bars.where(finite(F.col("close")).isNotNull()).select(
        F.col("symbol").alias("driver"), F.col("ts").alias("driver_ts"), F.col("close").alias("driver_start")
    )
    joined = asof_backward(
        equity, path, keys=["driver"], left_ts="prior_ts", right_ts="driver_ts", values=["driver_start"]
    ).join(driver_at_freeze, "session_date")

    price = lambda name: F.col(f"{name}_price")
    forwards = [
        guarded_return(price(f"h{m}"), price("decision")).alias(f"forward_{m}m_return") for m in spec.horizons
    ]
    return joined.where((F.col("driver_start") > 0) & F.col("driver_end").isNotNull()).select(
        "symbol",
        "session_date",
        "prior_ts",
        "prior_close",
        price("freeze").alias("premarket_price"),
        "driver_start",
        "driver_end",
        guarded_return(F.col("driver_end"), F.col("driver_start")).alias("driver_return"),
        guarded_return(price("freeze"), F.col("prior_close")).alias("premarket_return"),
        guarded_return(price("confirm"), price("open")).alias("opening_return"),
        *forwards,
    )


def _beta_over(window: Window) -> Column:
    """OLS slope over the frame; null below two finite pairs or with a degenerate driver."""
    x, y = finite(F.col("driver_return")), finite(F.col("premarket_return"))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    slope = F.regr_slope(y, x).over(window)
    spread = F.regr_sxx(y, x).over(window)
    pairs = F.regr_count(y, x).over(window)
    return F.when((pairs >= 2) & (spread > EPS), slope)


def episode_frame(raw: DataFrame, lookbacks: Sequence[int], *, full_window: bool = False) -> DataFrame:
    """Long frame (symbol, lookback, session_date): strictly-prior beta, expectation, residual.

    All lookbacks share one sort per symbol. With `full_window` a beta needs all N prior rows
    (the live contract); otherwise partial windows from two rows on are used (the research one).
    """
    for lookback in lookbacks:
        require_positive(beta_lookback=lookback)
    order = Window.partitionBy("symbol").orderBy("session_date")
    fits = []
    for lookback in lookbacks:
        prior = order.rowsBetween(-lookback, -1)
        rows = F.count(F.lit(1)).over(prior)
        beta = _beta_over(prior)
        fits.append(
            F.struct(
                F.lit(lookback).alias("lookback"),
                (F.when(rows >= lookback, beta) if full_window else beta).alias("beta"),
                rows.alias("training_count"),
                F.min("session_date").over(prior).alias("training_start"),
                F.max("session_date").over(prior).alias("training_end"),
            )
        )
    widened = raw.select("*", F.array(*fits).alias("_fits"))
    expectation = expected_return(F.col("_fit.beta"), F.col("driver_return"))
    return widened.select("*", F.explode("_fits").alias("_fit")).select(
        *raw.columns,
        "_fit.*",
        expectation.alias("expected_return"),
        (F.col("premarket_return") - expectation).alias("residual"),
    )


def forward_columns(spec: SessionSpec) -> list[str]:
    return [f"forward_{m}m_return" for m in spec.horizons]
