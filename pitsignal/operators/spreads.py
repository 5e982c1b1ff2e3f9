"""Option chain screening and the choice of the best defined-risk two-leg spread."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.contracts import age_in_limit, days_to_expiry, structure_for
from pitsignal.functions.numeric import relative_spread
from pitsignal.schemas import CHAIN, MONEY, require_columns


@dataclass(frozen=True)
class SpreadPolicy:
    # fixed values: frozen screening limits
    approved: tuple[str, ...] | None = None
    min_dte: int = 7
    max_dte: int = 21
    max_quote_age_seconds: int = 60
    max_relative_spread: Decimal = Decimal("0.25")
    long_delta_min: Decimal = Decimal("0.45")
    long_delta_max: Decimal = Decimal("0.65")
    min_short_abs_delta: Decimal = Decimal("0.10")
    min_net_delta: Decimal = Decimal("0.30")
    require_delta: bool = True

    def __post_init__(self) -> None:
        if self.max_dte < self.min_dte:
            raise ValueError("max_dte must be >= min_dte")
        if self.long_delta_max < self.long_delta_min:
            raise ValueError("long_delta_max must be >= long_delta_min")

    def is_approved(self, underlying: Column) -> Column:
        return F.lit(True) if self.approved is None else underlying.isin(list(self.approved))


def rejection_reason(policy: SpreadPolicy, now: Column, *, need_delta: bool) -> Column:
    """The first failing test of a contract, null when it is eligible."""
    dte = days_to_expiry(F.col("expiration"), now)
    spread = relative_spread(F.col("bid"), F.col("ask"))
    reason = (
        F.when(~policy.is_approved(F.col("underlying")), "underlying_not_approved")
        .when(~dte.between(policy.min_dte, policy.max_dte), "expiration_outside_window")
        .when(~age_in_limit(F.col("quote_ts"), now, policy.max_quote_age_seconds), "quote_age_outside_limit")
        .when(spread.isNull() | (spread > F.lit(policy.max_relative_spread)), "quote_invalid_or_wide")
    )
    return reason.when(F.col("delta").isNull(), "missing_delta") if need_delta else reason


def eligible_contracts(chain: DataFrame, policy: SpreadPolicy, now: Column, *, need_delta: bool = True) -> DataFrame:
    require_columns(chain, [f for f in CHAIN.fieldNames() if f != "chain_id"], "option chain")
    return chain.where(rejection_reason(policy, now, need_delta=need_delta).isNull())


def long_delta_ok(policy: SpreadPolicy, delta: Column) -> Column:
    return F.abs(delta).between(F.lit(policy.long_delta_min), F.lit(policy.long_delta_max))


def short_delta_ok(policy: SpreadPolicy, delta: Column) -> Column:
    return F.abs(delta) >= F.lit(policy.min_short_abs_delta)


def leg_points(eligible: DataFrame, keys: Sequence[str], policy: SpreadPolicy) -> tuple[DataFrame, DataFrame]:
    """The contracts that can be a leg of a best spread: one per strike and price tick.

    Debit and width depend on strike and quote only. Of the long legs with one strike and ask, a
    larger |delta| gives a larger net delta and so a better spread; of the short legs with one
    strike and bid, a smaller one does. The rest cannot win (equal deltas: the smaller symbol
    wins), so each side aggregates map-side to the listing grid before anything is paired, and a
    chain with any number of contracts has a bounded number of points.
    """
    grid = [*keys, "expiration", "option_type"]
    legs = eligible.where(F.col("delta").isNotNull()).withColumn("_mag", F.abs("delta"))
    leg = F.struct("symbol", F.col("_mag").alias("mag"), "delta", "quote_ts")
    longs = (
        legs.where(long_delta_ok(policy, F.col("delta")))
        .groupBy(*grid, F.col("strike").alias("long_strike"), F.col("ask").alias("long_ask"))
        .agg(F.min_by(leg, F.struct((-F.col("_mag")).alias("m"), F.col("symbol"))).alias("long"))
    )
    # net delta >= floor with |long delta| <= its maximum bounds the short side as well
    ceiling = policy.long_delta_max - policy.min_net_delta
    shorts = (
        legs.where(short_delta_ok(policy, F.col("delta")) & (F.col("_mag") <= F.lit(ceiling)))
        .groupBy(*grid, F.col("strike").alias("short_strike"), F.col("bid").alias("short_bid"))
        .agg(F.min_by(leg, F.struct(F.col("_mag").alias("m"), F.col("symbol"))).alias("short"))
    )
    return longs, shorts


def vertical_condition(policy: SpreadPolicy, max_debit: Column | None) -> Column:
    """Pair condition: strike order by type, 0 < debit < width, net delta floor, debit budget."""
    debit = F.col("long_ask") - F.col("short_bid")
    width = F.col("short_strike") - F.col("long_strike")
    ordered = F.when(F.col("option_type") == "call", width).otherwise(-width)
    condition = (ordered > 0) & (debit > 0) & (debit < ordered)
    condition &= (F.col("long.mag") - F.col("short.mag")) >= F.lit(policy.min_net_delta)
    return condition if max_debit is None else condition & (debit <= max_debit)


def _pairs(longs: DataFrame, shorts: DataFrame, keys: Sequence[str], policy: SpreadPolicy, max_debit: Column | None) -> DataFrame:
    joined = longs.join(shorts, [*keys, "expiration", "option_type"]).where(vertical_condition(policy, max_debit))
    debit = F.col("long_ask") - F.col("short_bid")
    net = F.col("long.mag") - F.col("short.mag")
    return joined.withColumn("debit", debit).withColumn("net_delta", net).withColumn("score", net / debit)


def pair_rank() -> Column:
    """Ascending: best delta per debit, then net delta, cheaper, earlier, smaller symbols. Decimal, so ties are exact."""
    return F.struct(
        (-F.col("score")).alias("s"),
        (-F.col("net_delta")).alias("n"),
        F.col("debit").alias("d"),
        F.col("expiration").alias("e"),
        F.col("long.symbol").alias("l"),
        F.col("short.symbol").alias("h"),
    )


PAIR = ("expiration", "long", "short", "long_strike", "short_strike", "debit", "net_delta", "score")


def best_short_per_long(
    eligible: DataFrame, keys: Sequence[str], policy: SpreadPolicy, max_debit: Column | None = None
) -> DataFrame:
    """Leg pairing, one row per long point: the partner that ranks first for it."""
    longs, shorts = leg_points(eligible, keys, policy)
    pairs = _pairs(longs, shorts, keys, policy, max_debit)
    best = pairs.groupBy(*keys, "expiration", "option_type", "long_strike", "long_ask").agg(
        F.min_by(F.struct("long", "short", "short_strike", "debit", "net_delta", "score"), pair_rank()).alias("_b")
    )
    return best.select(*keys, "expiration", "option_type", "long_strike", "long_ask", "_b.*")


def vertical_exists(eligible: DataFrame, keys: Sequence[str], policy: SpreadPolicy) -> DataFrame:
    """The (chain, option type) pairs with at least one vertical."""
    longs, shorts = leg_points(eligible, keys, policy)
    grid = [*keys, "expiration", "option_type"]
    right = shorts.select(*[F.col(g).alias(f"_{g}") for g in grid], "short_strike", "short_bid", "short")
    same = F.lit(True)
    for g in grid:
        same &= F.col(g) == F.col(f"_{g}")
    return longs.join(right, same & vertical_condition(policy, None), "left_semi").select(*keys, "option_type").distinct()


def best_verticals(
    chain: DataFrame,
    keys: Sequence[str],
    policy: SpreadPolicy,
    now: Column,
    max_debit: str | None = None,
) -> DataFrame:
    """Best spread per (chain, option type): calls are the bullish side, puts the bearish one.

    `max_debit` names a chain-level column with the debit budget.
    """
    carried = [*keys, max_debit] if max_debit else list(keys)
    longs, shorts = leg_points(eligible_contracts(chain, policy, now), carried, policy)
    pairs = _pairs(longs, shorts, carried, policy, F.col(max_debit) if max_debit else None)
    best = pairs.groupBy(*keys, "option_type").agg(F.min_by(F.struct(*PAIR), pair_rank()).alias("_b"))
    return spread_row(best.select(*keys, "option_type", "_b.*"), keys)


def max_loss(debit: Column) -> Column:
    """Loss of one contract pair: debit in whole cents, half up, times the multiplier."""
    return (F.round(debit, 2) * 100).cast(MONEY)


def spread_row(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flatten a chosen pair to the candidate's columns."""
    return pairs.select(
        *keys,
        F.when(F.col("option_type") == "call", "bullish").otherwise("bearish").alias("direction"),
        structure_for(F.col("option_type")).alias("structure"),
        "expiration",
        F.col("long.symbol").alias("long_symbol"),
        F.col("short.symbol").alias("short_symbol"),
        "long_strike",
        "short_strike",
        F.col("long.delta").alias("long_delta"),
        F.col("short.delta").alias("short_delta"),
        "net_delta",
        F.round("debit", 2).cast(MONEY).alias("net_debit"),
        F.col("score").alias("delta_per_debit"),
        max_loss(F.col("debit")).alias("max_loss"),
        F.least("long.quote_ts", "short.quote_ts").alias("quote_ts"),
    )


def richest_candidate(candidates: DataFrame, keys: Sequence[str], min_debit: Decimal) -> DataFrame:
    """Across both directions the largest (debit, expiry, long symbol), if it is rich enough."""
    columns = [c for c in candidates.columns if c not in keys]
    rank = F.struct("net_debit", "expiration", "long_symbol")
    best = candidates.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_b")).select(*keys, "_b.*")
    return best.where(F.col("net_debit") >= F.lit(min_debit))


def feasibility(chain: DataFrame, keys: Sequence[str], policy: SpreadPolicy, now: Column) -> DataFrame:
    """Per chain: feasible or the first reason why not, the structures at hand, the eligible count."""
    reason = rejection_reason(policy, now, need_delta=False)
    flagged = chain.withColumn("_ok", reason.isNull()).withColumn("_approved", policy.is_approved(F.col("underlying")))
    counts = flagged.groupBy(*keys).agg(
        F.bool_and("_approved").alias("_approved"),
        F.count(F.when(F.col("_ok"), 1)).alias("_eligible"),
        F.count(F.when(F.col("_ok") & F.col("delta").isNotNull(), 1)).alias("_with_delta"),
    )
    sides = (
        vertical_exists(flagged.where("_ok"), keys, policy)
        .groupBy(*keys)
        .agg(F.bool_or(F.col("option_type") == "call").alias("_call"), F.bool_or(F.col("option_type") == "put").alias("_put"))
    )
    joined = counts.join(sides, list(keys), "left").fillna({"_call": False, "_put": False})
    no_delta = F.lit(policy.require_delta) & (F.col("_with_delta") == 0)
    stop = (
        F.when(~F.col("_approved"), "underlying_not_approved")
        .when(F.col("_eligible") == 0, "no_eligible_contracts")
        .when(no_delta, "missing_required_delta")
        .when(~F.col("_call") & ~F.col("_put"), "no_compatible_vertical")
    )
    structures = F.array_compact(
        F.array(F.when(F.col("_call"), "call_debit_spread"), F.when(F.col("_put"), "put_debit_spread"))
    )
    return joined.select(
        *keys,
        stop.isNull().alias("feasible"),
        stop.alias("reason"),
        F.when(stop.isNull(), structures).otherwise(F.array().cast("array<string>")).alias("available_structures"),
        F.when(F.col("_approved"), F.col("_eligible")).otherwise(0).alias("eligible_contract_count"),
    )
