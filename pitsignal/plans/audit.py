"""Episode audit view and gate-funnel replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.operators.ledger import latest_episodes, latest_per, with_latest_reason


def episode_view(
    episodes: DataFrame, transitions: DataFrame, orders: DataFrame, marks: DataFrame, *, limit: int, abstain_state: str = "ABSTAINED", mark_kinds: Sequence[str] = ()
) -> DataFrame:
    """The newest episodes with their abstain reason, last order and last mark of each kind.

    The top-k comes first; the other tables are reduced to the chosen episodes by a semi join
    before they are aggregated.
    """
    newest = latest_episodes(episodes, limit)
    ids = newest.select("episode_id")
    reasons = with_latest_reason(newest, transitions.join(ids, "episode_id", "left_semi"), abstain_state)
    order = latest_per(orders.join(ids, "episode_id", "left_semi"), ["episode_id"], "order_id").select(
        "episode_id", "order_id", F.col("status").alias("order_status")
    )
    mine = marks.join(ids, "episode_id", "left_semi")
    kinds = mine.groupBy("episode_id").agg(
        *[F.max_by("payload_json", F.when(F.col("value") == k, F.col("mark_id"))).alias(f"mark_{k}") for k in mark_kinds]
    ) if mark_kinds else ids
    return reasons.join(order, "episode_id", "left").join(kinds, "episode_id", "left")


def gate_reason() -> Column:
    """First failing gate of an episode, in decision order; null when the order would be sent.

    Expects has_features, opening_return, residual, threshold, feasible, feasibility_reason,
    evidence_complete, action, decision_reason, direction, max_net_debit, long_symbol, risk_reasons.
    """
    c = F.col
    return F.coalesce(
        F.when(~c("has_features"), "premarket_features_unavailable"),
        F.when(c("opening_return").isNull(), "opening_confirmation_unavailable"),
        F.when(F.abs("residual") < c("threshold"), "residual_below_frozen_threshold"),
        F.when(~F.coalesce(c("feasible"), F.lit(False)), F.coalesce("feasibility_reason", F.lit("option_surface_unavailable"))),
        F.when(~c("evidence_complete"), "tool_context_unavailable"),
        F.when(c("residual") == 0, "zero_residual"),
        F.when(c("action") == "abstain", c("decision_reason")),
        F.when(c("direction").isNull(), "no_direction"),
        F.when(c("max_net_debit") <= 0, "risk_budget_exhausted"),
        F.when(c("long_symbol").isNull(), "no_constructible_vertical"),
        F.when(F.size("risk_reasons") > 0, F.get("risk_reasons", F.lit(0))),
    )


def gate_funnel(inputs: DataFrame) -> DataFrame:
    reason = gate_reason()
    return inputs.withColumn("reason", F.coalesce(reason, F.lit("dry_run_would_submit"))).withColumn(
        "state", F.when(reason.isNull(), "RISK_APPROVED").otherwise("ABSTAINED")
    )


def funnel_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("state", "reason").agg(F.count(F.lit(1)).alias("episode_count"))
