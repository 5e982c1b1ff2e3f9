"""Debit budget, risk gates, portfolio state and close pricing."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import in_entry_window
from pitsignal.functions.contracts import age_in_limit
from pitsignal.functions.numeric import truncate_cents
from pitsignal.schemas import MONEY


@dataclass(frozen=True)
class RiskPolicy:
    # fixed values: frozen risk envelope
    approved: tuple[str, ...] = ()
    per_position_loss_fraction: Decimal = Decimal("0.01")
    aggregate_loss_fraction: Decimal = Decimal("0.05")
    max_quote_age_seconds: int = 60
    entry_start: str = "09:55"
    entry_end: str = "15:30"
    tz: str = "America/New_York"
    final_entry_cutoff: datetime | None = None

    def __post_init__(self) -> None:
        for name in ("per_position_loss_fraction", "aggregate_loss_fraction"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        cutoff = self.final_entry_cutoff
        if cutoff is not None and cutoff.tzinfo is None:
            raise ValueError("final_entry_cutoff must be timezone-aware")


def debit_budget(policy: RiskPolicy) -> Column:
    """Largest net debit of one contract the envelope allows, zero when it is used up."""
    equity = F.col("starting_equity")
    position = equity * F.lit(policy.per_position_loss_fraction)
    remaining = equity * F.lit(policy.aggregate_loss_fraction) - F.col("aggregate_defined_loss")
    available = F.least(position, remaining, F.col("buying_power"))
    return F.when(available > 0, available / 100).otherwise(F.lit(0)).cast("decimal(18,6)")


def risk_reasons(policy: RiskPolicy, now: Column) -> Column:
    """Every failing gate in fixed order; an empty array approves."""
    loss, equity = F.col("max_loss"), F.col("starting_equity")
    after = F.col("aggregate_defined_loss") + loss
    gates = [
        F.when(~F.col("underlying").isin(list(policy.approved)), "underlying_not_approved"),
        F.when(F.array_contains("open_underlyings", F.col("underlying")), "underlying_already_open"),
        F.when(loss > equity * F.lit(policy.per_position_loss_fraction), "per_position_loss_cap"),
        F.when(after > equity * F.lit(policy.aggregate_loss_fraction), "aggregate_loss_cap"),
        F.when(loss > F.col("buying_power"), "insufficient_buying_power"),
        F.when(~age_in_limit(F.col("quote_ts"), now, policy.max_quote_age_seconds), "stale_quote"),
        F.when(~in_entry_window(now, policy.entry_start, policy.entry_end, policy.tz), "outside_entry_window"),
    ]
    if policy.final_entry_cutoff is not None:
        gates.append(F.when(now >= F.lit(policy.final_entry_cutoff), "final_event_cutoff"))
    return F.array_compact(F.array(*gates))


def evaluate_risk(candidates: DataFrame, policy: RiskPolicy, now: str = "now") -> DataFrame:
    """Candidate rows with their portfolio columns -> approval, reasons, loss after the trade."""
    reasons = risk_reasons(policy, F.col(now))
    return candidates.withColumns(
        {
            "reasons": reasons,
            "approved": F.size(reasons) == 0,
            "aggregate_after": F.col("aggregate_defined_loss") + F.col("max_loss"),
        }
    )


def open_underlyings(positions: DataFrame, keys: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Distinct sorted underlyings per account; a contract symbol maps to its known prefix.

    Duplicates go before the set is collected, so a set holds the underlyings and not the positions.
    """
    symbol = F.col("symbol")
    mapped = F.coalesce(*[F.when(symbol.startswith(p), F.lit(p)) for p in prefixes], symbol)
    held = positions.where(symbol.isNotNull() & (symbol != "")).select(*keys, mapped.alias("_u")).distinct()
    return held.groupBy(*keys).agg(F.sort_array(F.collect_set("_u")).alias("open_underlyings"))


def _quote_fault(side: str, now: Column, limit: int) -> Column:
    bid, ask = F.col(f"{side}_bid"), F.col(f"{side}_ask")
    return F.when((bid <= 0) | (ask <= 0) | (ask < bid), f"invalid_close_quote_{side}").when(
        ~age_in_limit(F.col(f"{side}_quote_ts"), now, limit), f"stale_close_quote_{side}"
    )


def close_instructions(
    spreads: DataFrame, chain: DataFrame, *, keys: list[str], approved: tuple[str, ...], now: Column, max_age_seconds: int = 60
) -> DataFrame:
    """Close limit of open spreads, or the first reason why they cannot be priced.

    Spreads carry `long_symbol`, `short_symbol`, `attempt`; the credit is the natural one cut to
    cents, one cent at least, and exactly one cent on the second attempt. The limit is negative.
    """
    legs = ["underlying", "expiration", "option_type", "strike", "bid", "ask", "quote_ts"]
    side = lambda name: chain.select(*keys, F.col("symbol").alias(f"{name}_symbol"), *[F.col(c).alias(f"{name}_{c}") for c in legs], F.lit(True).alias(f"{name}_found"))
    joined = spreads.join(side("long"), [*keys, "long_symbol"], "left").join(side("short"), [*keys, "short_symbol"], "left")
    c = F.col
    gap = c("short_strike") - c("long_strike")
    fault = F.coalesce(
        F.when(c("long_found").isNull() | c("short_found").isNull(), "contracts_not_in_chain"),
        F.when(~c("long_underlying").isin(list(approved)) | ~c("short_underlying").isin(list(approved)), "underlying_not_approved"),
        F.when(c("long_expiration") != c("short_expiration"), "expiration_differs"),
        F.when(c("long_option_type") != c("short_option_type"), "option_type_differs"),
        F.when((c("long_option_type") == "call") & (gap <= 0), "not_the_opening_call_vertical"),
        F.when((c("long_option_type") == "put") & (gap >= 0), "not_the_opening_put_vertical"),
        _quote_fault("long", now, max_age_seconds),
        _quote_fault("short", now, max_age_seconds),
        F.when(~c("attempt").isin(0, 1), "attempt_must_be_0_or_1"),
    )
    cent = F.lit(Decimal("0.01")).cast(MONEY)
    credit = F.when(c("attempt") == 1, cent).otherwise(F.greatest(cent, truncate_cents(c("long_bid") - c("short_ask"))))
    return joined.select(
        *spreads.columns,
        fault.alias("reason"),
        F.when(fault.isNull(), -credit).alias("limit_price"),
        F.when(fault.isNull(), F.least("long_quote_ts", "short_quote_ts")).alias("quote_ts"),
    )
