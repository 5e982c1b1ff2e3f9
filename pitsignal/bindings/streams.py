"""Streaming operators on the events table, drained with availableNow into a Parquet sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.bindings.base import LIVE_LOOKBACK, load, query, r
from pitsignal.bindings.episodes import CTE_LIVE, live_raw
from pitsignal.functions.clock import local_date
from pitsignal.operators.ledger import replay_steps
from pitsignal.streaming import bars as sb
from pitsignal.streaming import episodes as se
from pitsignal.session import scratch_path
from pitsignal.streaming.live import rolling_betas
from pitsignal.streaming.run import file_stream, run_available, with_end


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    return file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


_WM = "(select max(ts) - interval 15 minutes from events)"


@query("K01_bars_from_ticks", f"""with b as (select event_type as symbol, date_trunc('hour', ts) as t, min_by(value, event_id) as open, max(value) as high, min(value) as low, max_by(value, event_id) as close, count(*)::double as volume
 from events group by 1, 2) select symbol, strftime(t, '%Y-%m-%d %H:%M:%S') as ts, open, high, low, close, volume from b where t + interval 1 hour <= {_WM}""")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = events_stream(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"), F.lit(1.0).alias("size")
    )
    return run_available(sb.bars_from_ticks(ticks, grain="1 hour"), "k01")


@query("K02_idempotent_ingest", "select distinct event_type as symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour from events")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"), "ts")
    return run_available(sb.ingest_once(rows, ["symbol", "hour"], delay="2 hours").select("symbol", "hour"), "k02")


_ROUTED = """rt as (select event_type as symbol, ts::date as d, ts, case when ts > ts::date + interval '9 hours 40 minutes' then 'after_cutoff'
 when ts + to_minutes((event_id % 40)::int) <= ts::date + interval '9 hours 55 minutes' then 'feature' else 'late' end as route from events)"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = events_stream(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("symbol"), "ts", F.timestamp_add("MINUTE", (F.col("event_id") % 40).cast("int"), F.col("ts")).alias("arrived")
    )
    return sb.route_events(stamped, cutoff="09:40", tz="UTC")


@query("K03_cutoff_routing", f"with {_ROUTED} select symbol, d::varchar as session_date, route, count(*) as event_count from rt group by 1, 2, 3")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = run_available(routed(spark, sf_dir), "k03", partition_by=("route",))
    return table.groupBy("symbol", local_date(F.col("ts"), "UTC").alias("session_date"), "route").agg(F.count(F.lit(1)).alias("event_count"))


@query("K03_late_abstain", f"""with {_ROUTED} select symbol, d::varchar as session_date, count(*) as late_events, 'late_start' as reason from rt
 where route = 'late' group by 1, 2""")
def k03_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, finish = with_end(routed(spark, sf_dir), "ts")
    return run_available(sb.abstain_rows(stream, tz="UTC"), "k03-late", ends=[finish])


# stand-in for the legal-transition table over the event types
STEPS = {"view": ("click", "purchase"), "click": ("purchase", "view", "signup"), "purchase": ("view", "signup"), "signup": ("view", "error"), "error": ()}
_PAIRS = "(" + ", ".join(f"'{a}>{b}'" for a, t in STEPS.items() for b in t) + ")"


_MACHINE_SQL = f"""with recursive q as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as i from events),
 m as (select user_id, i, event_id, 'view' as s0, event_type as req, case when event_type = 'view' then 'repeat' when 'view>' || event_type in {_PAIRS} then 'applied' else 'illegal' end as o from q where i = 1
 union all select q.user_id, q.i, q.event_id, case when m.o = 'applied' then m.req else m.s0 end, q.event_type,
  case when q.event_type = (case when m.o = 'applied' then m.req else m.s0 end) then 'repeat' when (case when m.o = 'applied' then m.req else m.s0 end) || '>' || q.event_type in {_PAIRS} then 'applied' else 'illegal' end
  from m join q on q.user_id = m.user_id and q.i = m.i + 1)
 select user_id as episode_id, event_id as transition_id, s0 as from_state, req as to_state, o as outcome from m"""


@query("K04_episode_machine", _MACHINE_SQL)
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events_stream(spark, sf_dir).select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("transition_id"), F.col("event_type").alias("requested"), "ts")
    stream, finish = with_end(requests, "ts")
    # the table holds 30 days: a finished episode leaves once none of its requests can come any more
    machine = se.episode_steps(stream, allowed=STEPS, initial="view", retain_seconds=31 * 86_400)
    return run_available(machine, "k04", ends=[finish], keyed=True)


@query("W09_replayed_steps", _MACHINE_SQL)
def w09_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("transition_id"), F.col("event_type").alias("requested"))
    return replay_steps(rows, allowed=STEPS, initial="view")


@query("K05_order_timeouts", f"""with o as (select event_id // 2 as order_id, ts as t0, case (event_id // 2) % 3 when 0 then 180 when 1 then 120 else 30 end as lim from events where event_id % 2 = 0),
 f as (select event_id // 2 as order_id, ts as t1 from events where event_id % 2 = 1 and event_type in ('view', 'click', 'purchase')), j as (select o.*, epoch_us(t0) // 1000 + lim*1000 as dl, epoch_us(t1) // 1000 as b from o left join f using (order_id))
 select order_id, case when b <= dl then 'filled' else 'timed_out' end as outcome, case when b <= dl then b else dl end as at_ms from j""")
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    order = F.floor(e / 2)
    sent = e % 2 == 0
    phase = F.when(order % 3 == 0, "open").when(order % 3 == 1, "close").otherwise("cancel")
    rows = events_stream(spark, sf_dir).where(sent | F.col("event_type").isin("view", "click", "purchase"))
    orders = rows.select(order.alias("order_id"), F.when(sent, "submitted").otherwise("filled").alias("kind"), phase.alias("phase"), "ts")
    stream, finish = with_end(orders, "ts")
    return run_available(se.order_timeouts(stream), "k05", ends=[finish], keyed=True)


@query("K06_quote_freshness", """with d as (select event_id, user_id, ts from events where event_type = 'purchase'), q as (select event_id, user_id, ts from events where event_type <> 'purchase')
 select d.event_id as decision_id, max_by(q.event_id, row(q.ts, q.event_id)) as quote_id, strftime(max(q.ts), '%Y-%m-%d %H:%M:%S') as quoted_at, max(q.event_id) is null as refused
 from d left join q on q.user_id = d.user_id and q.ts <= d.ts and q.ts >= d.ts - interval 14400 seconds group by 1""")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.col("event_type") == "purchase"
    decisions = events_stream(spark, sf_dir).where(bought).select(F.col("event_id").alias("decision_id"), F.col("ts").alias("decided_at"), "user_id")
    quotes = events_stream(spark, sf_dir).where(~bought).select(F.col("event_id").alias("quote_id"), F.col("ts").alias("quoted_at"), "user_id")
    (decisions, no_more_decisions), (quotes, no_more_quotes) = with_end(decisions, "decided_at"), with_end(quotes, "quoted_at")
    pairs = run_available(sb.fresh_quotes(decisions, quotes, key="user_id", max_age_seconds=14400), "k06", ends=[no_more_decisions, no_more_quotes])
    return sb.freshest(pairs)


@query("K07_live_beta", f"""with {CTE_LIVE} select symbol, d::varchar as session_date, tc as training_count, {r('beta')} as beta, {r('expected')} as expected_return, {r('residual')} as residual
 from lep where tc = {LIVE_LOOKBACK}""")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sessions")
    sessions = live_raw(spark, sf_dir).select("symbol", "session_date", "driver_return", "premarket_return")
    sessions.write.parquet(path)
    stream, finish = with_end(file_stream(spark, path, sessions.schema).withColumn("end_ts", F.col("session_date").cast("timestamp")), "end_ts")
    # the marker's own day lies at the end of time as well
    betas = run_available(rolling_betas(stream, lookback=LIVE_LOOKBACK), "k07", ends=[finish], keyed=True)
    return betas.where(F.col("training_count") == LIVE_LOOKBACK)
