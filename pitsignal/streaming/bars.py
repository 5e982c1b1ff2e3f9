"""Bars from ticks, idempotent ingest, cut-off routing and quote freshness on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import local_date, wall_to_utc
from pitsignal.streaming.run import watermarked

FEED_DELAY = "15 minutes"  # fixed value: delay of the recorded feed


def bars_from_ticks(ticks: DataFrame, *, grain: str = "1 minute", delay: str = FEED_DELAY) -> DataFrame:
    """Tumbling OHLCV per symbol, emitted once the watermark passes the bar's end.

    Expects symbol, ts, tick_id (order among equal instants), price, size.
    """
    at = F.struct("ts", "tick_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", grain), "symbol")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def ingest_once(rows: DataFrame, keys: Sequence[str], *, delay: str) -> DataFrame:
    """First arrival per natural key; the key's state is dropped after the watermark delay."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def cutoff_route(ts: Column, arrived: Column, *, cutoff: str, tz: str, delay_seconds: int) -> Column:
    """Where an event may go: into the feature, after the cut-off, or too late for it.

    An event counts for the feature only when it happened by the session's cut-off and arrived
    within the feed delay after it; a late one is routed out by its own event time.
    """
    limit = wall_to_utc(local_date(ts, tz), cutoff, tz)
    in_time = F.unix_micros(arrived) <= F.unix_micros(limit) + delay_seconds * 1_000_000
    return F.when(ts > limit, "after_cutoff").when(in_time, "feature").otherwise("late")


def route_events(events: DataFrame, *, cutoff: str, tz: str, delay_seconds: int = 900) -> DataFrame:
    """Stateless routing column; late rows become explicit abstain rows downstream."""
    return events.withColumn("route", cutoff_route(F.col("ts"), F.col("arrived"), cutoff=cutoff, tz=tz, delay_seconds=delay_seconds))


def abstain_rows(routed: DataFrame, *, tz: str, delay: str = FEED_DELAY) -> DataFrame:
    """One abstain row per (symbol, session) that had a late event.

    On a stream a session's row is emitted once the watermark of all events, late or not, passes its
    end; the state is one row per symbol and open session. The watermark follows the wall clock of `tz`.
    """
    wall = watermarked(routed.withColumn("_wall", F.from_utc_timestamp("ts", tz)), "_wall", delay)
    counted = wall.groupBy(F.window("_wall", "1 day"), "symbol").agg(F.count_if(F.col("route") == "late").alias("late_events"))
    day = F.floor(F.unix_micros("window.start") / 86_400_000_000).cast("int")
    return counted.where("late_events > 0").select(
        "symbol", F.date_from_unix_date(day).alias("session_date"), "late_events", F.lit("late_start").alias("reason")
    )


def fresh_quotes(decisions: DataFrame, quotes: DataFrame, *, key: str, max_age_seconds: int = 60, delay: str = FEED_DELAY) -> DataFrame:
    """Every decision with the quotes at most `max_age_seconds` old; both sides keep bounded state.

    Expects decision_id, decided_at, `key` on the left and quote_id, quoted_at, `key` on the right. A
    decision without a fresh quote has one row with null quote columns, once the watermark has passed it.
    """
    left = watermarked(decisions, "decided_at", delay)
    right = watermarked(quotes.withColumnRenamed(key, "_quote_key"), "quoted_at", delay)
    age = F.expr(f"interval {int(max_age_seconds)} seconds")
    inside = (F.col("quoted_at") <= F.col("decided_at")) & (F.col("quoted_at") >= F.col("decided_at") - age)
    return left.join(right, (F.col(key) == F.col("_quote_key")) & inside, "left_outer").drop("_quote_key")


def freshest(pairs: DataFrame) -> DataFrame:
    """The newest quote of every decision, from the joined sink; without one the decision is refused."""
    newest = pairs.groupBy("decision_id").agg(F.max_by("quote_id", F.struct("quoted_at", "quote_id")).alias("quote_id"), F.max("quoted_at").alias("quoted_at"))
    return newest.withColumn("refused", F.col("quote_id").isNull())
