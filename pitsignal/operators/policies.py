"""Policy replays and challengers on the signal series, votes, contract screens, fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.operators.metrics import summarize
from pitsignal.operators.ordering import modal_value, range_scan
from pitsignal.operators.quantiles import exact_quantiles


def replay_outcomes(sessions: DataFrame, episodes: DataFrame, decisions: DataFrame, *, threshold: float, horizon: str) -> DataFrame:
    """Every (symbol, session) of the calendar with its outcome and the returns of both policies.

    `continuation` follows the residual's sign, `adjudicated` follows the recorded action; an
    abstention has a null return.
    """
    usable = episodes.where(F.col("residual").isNotNull() & F.col(horizon).isNotNull()).select(
        "symbol", "session_date", "residual", "opening_return", F.col(horizon).alias("_forward")
    )
    table = sessions.join(usable, ["symbol", "session_date"], "left").join(
        decisions.select("symbol", "session_date", "action"), ["symbol", "session_date"], "left"
    )
    signal = F.abs("residual") >= threshold
    follow = F.signum("residual") * F.col("_forward")
    acted = F.when(F.col("action") == "continuation", follow).when(F.col("action") == "reversion", -follow)
    outcome = (
        F.when(F.col("residual").isNull(), "data_abstain")
        .when(~signal, "threshold_abstain")
        .when(acted.isNull(), "ai_abstain")
        .otherwise("signal")
    )
    return table.select(
        "symbol",
        "session_date",
        "residual",
        "opening_return",
        "action",
        outcome.alias("outcome"),
        F.when(signal, follow).alias("continuation"),
        F.when(signal, acted).alias("adjudicated"),
    )


def outcome_counts(replay: DataFrame, keys: Sequence[str]) -> DataFrame:
    kinds = ("signal", "threshold_abstain", "data_abstain", "ai_abstain")
    return replay.groupBy(*keys).agg(*[F.count(F.when(F.col("outcome") == k, 1)).alias(k) for k in kinds])


def policy_records(replay: DataFrame, keys: Sequence[str], policies: Sequence[str]) -> DataFrame:
    """Wins, losses, hit rate, mean, median and sum of each policy column per group."""
    entries = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("_x")) for p in policies])
    long = replay.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")
    table = summarize(long, [*keys, "policy"], "_x")
    wins = F.round(F.col("hit_rate") * F.col("count")).cast("bigint")
    return table.select(
        *keys, "policy", "count", wins.alias("wins"), (F.col("count") - wins).alias("losses"), "hit_rate", "mean", "median", "total"
    )


def by_period(replay: DataFrame, periods: Sequence[str] = ("month",)) -> DataFrame:
    """One copy of each row per calendar period, for splits by month (or another unit)."""
    entries = F.array(*[F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(p, F.col("session_date"))).alias("period_start")) for p in periods])
    return replay.withColumn("_p", F.explode(entries)).select(*replay.columns, "_p.*")


def replay_stability(decisions: DataFrame, context: str) -> DataFrame:
    """Contexts whose repeats all agree, and contexts with a flipped action."""
    per_context = decisions.groupBy(context).agg(F.count_distinct("action").alias("_k"), F.count(F.lit(1)).alias("_n"))
    return per_context.agg(
        F.count(F.lit(1)).alias("contexts"),
        F.count(F.when(F.col("_k") == 1, 1)).alias("unanimous"),
        F.count(F.when(F.col("_k") > 1, 1)).alias("flipped"),
        F.sum("_n").alias("calls"),
    )


# ---------------------------------------------------------------- challengers
# They run on the signals of a symbol in date order: a series bounded by the calendar.

def _series() -> Window:
    return Window.partitionBy("symbol").orderBy("session_date")


def _follow(choice: Column) -> Column:
    return F.when(choice == "continuation", F.col("continuation")).when(choice == "reversion", -F.col("continuation"))


def _by_sign(score: Column) -> Column:
    return F.when(score > 0, "continuation").when(score < 0, "reversion")


def previous_signal(signals: DataFrame) -> DataFrame:
    """Whichever thesis would have won on the signal before; none on the first."""
    choice = _by_sign(F.lag("continuation").over(_series()))
    return signals.withColumn("previous_choice", choice).withColumn("previous_signal", _follow(F.col("previous_choice")))


def ewma_choice(signals: DataFrame, *, half_life: float = 3.0, min_history: int = 3, width: int = 1024) -> DataFrame:
    """Sign of the exponentially weighted earlier continuation outcomes.

    A signal turns the running score s into decay * s + outcome. These maps are composed as pairs of
    factor and addend over ranges of days, with the count of signals alongside, so a series of any
    length takes linear work and no list of its past.
    """
    decay = 0.5 ** (1.0 / half_life)
    own = F.struct(F.lit(decay).alias("factor"), F.col("continuation").cast("double").alias("addend"), F.lit(1).cast("bigint").alias("rows"))

    def compose(older: Column, newer: Column) -> Column:
        return F.struct(
            (older["factor"] * newer["factor"]).alias("factor"),
            (newer["factor"] * older["addend"] + newer["addend"]).alias("addend"),
            (older["rows"] + newer["rows"]).alias("rows"),
        )

    dated = signals.withColumn("_day", F.unix_date("session_date"))
    return (
        range_scan(dated, ["symbol"], "_day", own, compose, "_past", width=width)
        .withColumn("ewma_score", F.when(F.col("_past.rows") >= min_history, F.col("_past.addend")))
        .withColumn("ewma_choice", _by_sign(F.col("ewma_score")))
        .withColumn("ewma", _follow(F.col("ewma_choice")))
        .drop("_past", "_day")
    )


def ridge_choice(signals: DataFrame, *, window: int = 10, penalty: float = 1.0) -> DataFrame:
    """Ridge of the unsigned forward return on residual and opening return over earlier signals.

    Two features and no intercept: window sums of cross products and the closed 2x2 solution.
    """
    a, b = F.col("residual"), F.col("opening_return")
    y = F.signum(a) * F.col("continuation")
    prior = _series().rowsBetween(-window, -1)
    full = F.col("_rows") == window
    sums = {"_aa": a * a, "_bb": b * b, "_ab": a * b, "_ay": a * y, "_by": b * y}
    table = signals.withColumns({name: F.sum(expr).over(prior) for name, expr in sums.items()} | {"_rows": F.count(a + b).over(prior)})
    saa, sbb, sab = F.col("_aa") + penalty, F.col("_bb") + penalty, F.col("_ab")
    det = saa * sbb - sab * sab
    wa = (sbb * F.col("_ay") - sab * F.col("_by")) / det
    wb = (saa * F.col("_by") - sab * F.col("_ay")) / det
    predicted = F.when(full, wa * a + wb * b)
    choice = _by_sign(F.signum(a) * predicted)
    return (
        table.withColumn("ridge_prediction", predicted)
        .withColumn("ridge_choice", choice)
        .withColumn("ridge", _follow(F.col("ridge_choice")))
        .drop(*sums, "_rows")
    )


def regime_gate(signals: DataFrame, *, window: int = 5) -> DataFrame:
    """A recorded reversion passes only when the last continuation outcomes were negative on average."""
    prior = _series().rowsBetween(-window, -1)
    recent = F.when(F.count("continuation").over(prior) == window, F.avg("continuation").over(prior))
    gated = F.when((F.col("action") == "reversion") & ~F.coalesce(F.col("recent_mean") < 0, F.lit(False)), "abstain").otherwise(F.col("action"))
    return signals.withColumn("recent_mean", recent).withColumn("regime_action", gated).withColumn("regime_gate", _follow(F.col("regime_action")))


def opening_guard(signals: DataFrame) -> DataFrame:
    """A recorded reversion passes only when the opening move already points its way."""
    supports = F.signum("opening_return") == -F.signum("residual")
    guarded = F.when((F.col("action") == "reversion") & ~F.coalesce(supports, F.lit(False)), "abstain").otherwise(F.col("action"))
    return signals.withColumn("guard_action", guarded).withColumn("opening_guard", _follow(F.col("guard_action")))


def policy_families(decisions: DataFrame) -> DataFrame:
    """Returns of the incumbent, the direct replacement and the consensus filter; abstain is 0.

    Expects continuation, incumbent_action, candidate_action and company_news (the veto).
    """
    take = lambda action: F.coalesce(
        F.when(action == "continuation", F.col("continuation")).when(action == "reversion", -F.col("continuation")), F.lit(0.0)
    )
    candidate = F.when(F.col("company_news"), "abstain").otherwise(F.col("candidate_action"))
    agreed = F.when((candidate == F.col("incumbent_action")) & (candidate != "abstain"), candidate).otherwise("abstain")
    return decisions.withColumns(
        {"incumbent": take(F.col("incumbent_action")), "direct": take(candidate), "consensus": take(agreed)}
    )


def ensemble_votes(votes: DataFrame, *, round_majority: int = 3, stable_rounds: int = 4) -> DataFrame:
    """Two-level vote: models within a round, rounds within an episode; latency is the slowest member.

    Only a majority of non-abstain votes acts, so a count per action suffices and ties cannot occur.
    """
    actions = ("continuation", "reversion")
    rounds = votes.groupBy("episode_id", "round").agg(
        *[F.count(F.when(F.col("action") == a, 1)).alias(f"_{a}") for a in actions], F.max("latency").alias("latency")
    )
    acted = F.coalesce(*[F.when(F.col(f"_{a}") >= round_majority, a) for a in actions], F.lit("abstain"))
    decided = rounds.select("episode_id", "latency", acted.alias("action"))
    counts = decided.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("rounds"),
        *[F.count(F.when(F.col("action") == a, 1)).alias(f"_{a}") for a in (*actions, "abstain")],
        F.max("latency").alias("latency"),
    )
    top = F.greatest(*[F.col(f"_{a}") for a in (*actions, "abstain")])
    winner = F.coalesce(*[F.when((F.col(f"_{a}") == top) & (top >= stable_rounds), a) for a in (*actions, "abstain")])
    return counts.select("episode_id", "rounds", F.coalesce(winner, F.lit("abstain")).alias("action"), winner.isNotNull().alias("stable"), "latency")


def action_stability(decisions: DataFrame, keys: Sequence[str], *, min_votes: int = 4) -> DataFrame:
    """Modal action of the repeats and whether it has enough votes."""
    return modal_value(decisions, keys, F.col("action"), "action").withColumn("stable", F.col("votes") >= min_votes)


def contract_screen(calls: DataFrame, *, p95_limit: float = 12.0, max_limit: float = 20.0) -> DataFrame:
    """Per model: all replies valid, one action per context, latency limits.

    Actions are counted per (model, context) first; the percentile is exact at any group size.
    """
    contexts = calls.groupBy("model", "context_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("valid"), 1)).alias("_ok"), F.count_distinct("action").alias("_k"), F.max("latency").alias("_max")
    )
    models = contexts.groupBy("model").agg(
        F.sum("_n").alias("calls"),
        F.sum("_ok").alias("valid_calls"),
        F.count(F.lit(1)).alias("contexts"),
        F.count(F.when(F.col("_k") == 1, 1)).alias("unanimous_contexts"),
        F.max("_max").alias("latency_max"),
    )
    p95 = exact_quantiles(calls, ["model"], "latency", {"latency_p95": 0.95})
    c = F.col
    passed = (c("valid_calls") == c("calls")) & (c("unanimous_contexts") == c("contexts")) & (c("latency_p95") <= p95_limit) & (c("latency_max") <= max_limit)
    return models.join(p95, "model").withColumn("passed", passed)


# ---------------------------------------------------------------- fills, prints, runs

def print_coverage(legs: DataFrame, prints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of legs with a trade print, mean width and mean net delta per group.

    `legs` has symbol, width, net_delta; prints are reduced to distinct symbols first.
    """
    seen = prints.select("symbol").distinct().withColumn("_seen", F.lit(1))
    return legs.join(seen, "symbol", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("legs"),
        F.avg(F.when(F.col("_seen").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"),
        F.avg("width").alias("mean_width"),
        F.avg("net_delta").alias("mean_net_delta"),
    )


def active_minutes(prints: DataFrame, *, start: Column, end: Column) -> DataFrame:
    """Minutes of [start, end] in which a leg has a bar; equal minutes collapse before the count."""
    minute = F.date_trunc("minute", F.col("ts"))
    inside = prints.where((F.col("ts") >= start) & (F.col("ts") <= end)).select("leg", minute.alias("_m")).distinct()
    return inside.groupBy("leg").agg(F.count(F.lit(1)).alias("active_minutes"))


def activity_gate(trades: DataFrame, activity: DataFrame, minimums: Sequence[int]) -> DataFrame:
    """Hit rate and sum of the trades that survive each minimum of active minutes on both legs."""
    side = lambda leg: activity.select(F.col("leg").alias(leg), F.col("active_minutes").alias(f"_{leg}"))
    joined = trades.join(side("long_leg"), "long_leg", "left").join(side("short_leg"), "short_leg", "left")
    both = F.least(F.coalesce("_long_leg", F.lit(0)), F.coalesce("_short_leg", F.lit(0)))
    levels = joined.withColumn("minimum", F.explode(F.array(*[F.lit(m) for m in minimums])))
    kept = F.when(both >= F.col("minimum"), F.col("pnl"))
    return levels.groupBy("minimum").agg(
        F.count(kept).alias("kept"),
        F.sum(kept).alias("pnl"),
        F.avg(F.when(kept > 0, 1.0).when(kept.isNotNull(), 0.0)).alias("hit_rate"),
    )


def realized_pnl(fills: DataFrame, keys: Sequence[str], *, multiplier: int = 100) -> DataFrame:
    """Profit of an opened and closed spread and the improvement against the submitted limits.

    Expects phase (open, close), leg (long, short), fill_price, limit_price (the spread's limit).
    """
    long = F.when(F.col("leg") == "long", F.col("fill_price")).otherwise(-F.col("fill_price"))
    phase = lambda p: F.sum(F.when(F.col("phase") == p, long))
    limit = lambda p: F.max(F.when(F.col("phase") == p, F.col("limit_price")))
    table = fills.groupBy(*keys).agg(
        phase("open").alias("debit"), phase("close").alias("credit"), limit("open").alias("_ol"), limit("close").alias("_cl")
    )
    return table.select(
        *keys,
        "debit",
        "credit",
        ((F.col("credit") - F.col("debit")) * multiplier).alias("pnl"),
        ((F.col("_ol") - F.col("debit") + F.col("credit") - F.col("_cl")) * multiplier).alias("price_improvement"),
    )


def frozen_config(results: DataFrame, *, year: int, thesis: str = "continuation") -> DataFrame:
    """Most selected configuration among the folds of one thesis that end in a year."""
    folds = results.where((F.col("thesis") == thesis) & (F.year("test_end") == year))
    config = F.struct("lookback", "normalization", "threshold", "horizon")
    return modal_value(folds, ["symbol"], config, "_config").select("symbol", "_config.*", "votes", "total")


def replication_diff(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Episodes whose action or stability differs between two runs, missing ones included."""
    side = lambda df, s: df.select(key, F.col("action").alias(f"{s}_action"), F.col("stable").alias(f"{s}_stable"))
    both = side(first, "first").join(side(second, "second"), key, "full_outer")
    same = F.col("first_action").eqNullSafe(F.col("second_action")) & F.col("first_stable").eqNullSafe(F.col("second_stable"))
    return both.where(~same)


def usage_by_run(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_units").alias("input_units"), F.sum("output_units").alias("output_units"), F.sum("cost").alias("cost")
    )
