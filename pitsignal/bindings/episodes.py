"""Bars, sessions and episodes on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.bindings.base import (
    BARS_SQL, CTE_BARS, CTE_EPISODES, CTE_FACTS, CTE_RAW, CTE_SESSIONS, DRIVER, GRID_1H, GRID_4H, HORIZONS, LIVE_LOOKBACK,
    LOOKBACKS, PRIMARY, SECOND, UNIVERSE, bars, cte_episodes, cte_raw, event_span, for_spark, load, query, r,
)
from pitsignal.functions import clock
from pitsignal.functions.clock import SessionSpec
from pitsignal.functions.numeric import expected_return, guarded_return, residual
from pitsignal.operators.asof import asof_backward
from pitsignal.operators.calendar import business_days, session_table
from pitsignal.operators.episodes import day_facts, episode_frame, forward_columns, raw_episodes, with_prior_close
from pitsignal.operators.live import live_features, signal_evidence
from pitsignal.session import scratch_path
from pitsignal.sources.bars import (
    cache_manifest, collapse_duplicates, conflicting_bars, flatten_bar_payload, history_window, normalize_bars, read_bar_cache, write_bar_cache,
)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business_days(event_span(spark, sf_dir))


def raw(spark: SparkSession, sf_dir: str, spec: SessionSpec = GRID_1H, hours: int = 1) -> DataFrame:
    return raw_episodes(
        bars(spark, sf_dir, hours), sessions(spark, sf_dir), driver=DRIVER, symbols=UNIVERSE, spec=spec
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_frame(raw(spark, sf_dir), LOOKBACKS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual per symbol and session on the coarse grid of the smallest tables."""
    frame = episode_frame(raw(spark, sf_dir, GRID_4H, 4), LOOKBACKS)
    return frame.select("symbol", "lookback", "session_date", "driver_return", "premarket_return", "beta", "residual")


_F = ", ".join(f"{r(f'f{m}')} as forward_{m}m_return" for m in HORIZONS)


@query("C01_episode_frame", f"""with {CTE_EPISODES}
select symbol, lookback, cast(d as varchar) as session_date, {r('prior_close')} as prior_close,
 {r('premarket_price')} as premarket_price, {r('x')} as driver_return, {r('y')} as premarket_return,
 {r('opening')} as opening_return, {_F}, {r('beta')} as beta, {r('expected')} as expected_return,
 {r('residual')} as residual, tc as training_count, cast(t0 as varchar) as training_start, cast(t1 as varchar) as training_end
from ep""")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).drop("prior_ts", "driver_start", "driver_end")


# ---------------------------------------------------------------- scans

def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("value").cast("string")
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
        *[text.alias(c) for c in ("open", "high", "low", "close")],
        F.lit("1").alias("volume"),
    )


@query("S01_bar_scan", """select event_type as symbol, epoch_us(ts) as ts_us, value as open, value as high, value as low,
 value as close, 1.0::double as volume from events""")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_bars(_records(spark, sf_dir)).withColumn("ts", F.unix_micros("ts")).withColumnRenamed("ts", "ts_us")


def _hourly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.floor(F.col("value") / 100).cast("double")
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        *[level.alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"),
    )


_HOURLY = """with rec as (select event_type as symbol, date_trunc('hour', ts) as ts, floor(value/100) as v from events),
g as (select symbol, ts, count(*) as n, count(distinct v) as k, min(v) as v from rec group by 1, 2)"""


@query("S02_conflicting_bars", _HOURLY + """ select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, n as row_count, k as version_count
 from g where k > 1""")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicting_bars(_hourly_records(spark, sf_dir))


@query("S03_duplicate_collapse", _HOURLY + """ select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, v as open, v as high,
 v as low, v as close, 1.0::double as volume from g where k = 1""")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_duplicates(_hourly_records(spark, sf_dir), strict=False)


def _bar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider pages of 50 events each: a JSON map symbol -> array of short-key bars."""
    bar = F.struct(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("t"),
        *[F.col("value").alias(c) for c in "ohlc"],
        F.lit(1.0).alias("v"),
    )
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.floor(F.col("event_id") / 50).alias("page"), "event_type")
        .agg(F.collect_list(bar).alias("list"))
        .groupBy("page")
        .agg(F.map_from_entries(F.collect_list(F.struct("event_type", "list"))).alias("bars"))
        .select("page", F.to_json(F.struct("bars")).alias("payload"))
    )


@query("S04_bar_payload_flatten", """select event_type as symbol, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as ts,
 value as open, value as high, value as low, value as close, 1.0::double as volume from events""")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_bar_payload(_bar_pages(spark, sf_dir))


@query("S05_bar_cache_manifest", f"""with {CTE_BARS} select symbol, 'events' as provider, 'synthetic' as asset_class, 'hourly' as feed,
 '2024-01-01' as requested_start, '2024-01-31' as requested_end, count(*) as row_count,
 strftime(min(bar_date + to_hours(slot)), '%Y-%m-%d %H:%M:%S') as first_ts,
 strftime(max(bar_date + to_hours(slot)), '%Y-%m-%d %H:%M:%S') as last_ts from bars group by symbol""")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bar-cache")
    write_bar_cache(bars(spark, sf_dir), path, asset_class="synthetic")
    return cache_manifest(
        read_bar_cache(spark, path), provider="events", asset_class="synthetic", feed="hourly", start="2024-01-01", end="2024-01-31"
    )


# ---------------------------------------------------------------- sessions and predicates

_WALLS = {"premarket_start": "04:00", "freeze": "09:25", "open": "09:30", "confirm": "09:40", "decision": "09:55",
          "regular_end": "16:00", "h15": "10:10", "h30": "10:25", "h45": "10:40", "h60": "10:55", "h90": "11:25", "h120": "11:55"}


@query("P01_session_boundaries", "select cast(d as varchar) as session_date, " + ", ".join(
    f"strftime(timezone('UTC', timezone('America/New_York', d + interval '{w.split(':')[0]} hours {w.split(':')[1]} minutes')), '%Y-%m-%d %H:%M:%S') as {n}_ts"
    for n, w in _WALLS.items()) + " from (select distinct cast(o_orderdate as date) as d from orders)")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session_date")).distinct()
    return session_table(days, SessionSpec())


@query("P02_business_days", f"with {CTE_SESSIONS} select cast(d as varchar) as session_date from sessions")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir)


_NY = "timezone('America/New_York', timezone('UTC', ts))"


@query("P03_regular_hours", f"""select event_type as symbol, cast(cast({_NY} as date) as varchar) as local_day, count(*) as bar_count from events
 where cast({_NY} as time) >= time '09:30:00' and cast({_NY} as time) < time '16:00:00' group by 1, 2""")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, ts = SessionSpec(), F.col("ts").cast("timestamp")
    inside = load(spark, sf_dir, "events").where(clock.regular_hours(clock.local_micros(ts, spec.tz), spec))
    return inside.groupBy(F.col("event_type").alias("symbol"), clock.local_date(ts, spec.tz).alias("local_day")).agg(F.count(F.lit(1)).alias("bar_count"))


@query("P04_premarket_gate", f"""select event_type as symbol, cast(cast({_NY} as date) as varchar) as local_day,
 count(*) filter (where cast({_NY} as time) between time '04:00:00' and time '09:25:00') > 0 as has_premarket from events group by 1, 2""")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = load(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("open"), F.col("value").alias("close")
    )
    facts = day_facts(stamped, SessionSpec())
    return facts.select("symbol", F.col("session_date").alias("local_day"), (F.col("premarket_bars") > 0).alias("has_premarket"))


@query("P05_information_cutoff", f"""select event_type as symbol, count(*) as row_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts
 from events where ts >= timezone('UTC', timezone('America/New_York', timestamp '2024-01-05 00:00:00'))
 and ts <= timezone('UTC', timezone('America/New_York', timestamp '2024-01-25 09:40:00')) group by 1""")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    known = history_window(stamped, "2024-01-25", days=20, cutoff="09:40", tz="America/New_York")
    return known.groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("row_count"), F.max("ts").alias("last_ts"))


@query("P06_guarded_return", f"""with {CTE_BARS} select symbol, cast(bar_date as varchar) as bar_date, slot::bigint as slot,
 case when open > 20 then {r('close/open - 1')} end as bar_return from bars""")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = for_spark(spark, sf_dir, BARS_SQL)
    base = F.when(F.col("open") > 20, F.col("open")).otherwise(0.0)
    return slots.select("symbol", "bar_date", "slot", guarded_return(F.col("close"), base).alias("bar_return"))


@query("P07_residual", f"with {CTE_EPISODES} select symbol, lookback, cast(d as varchar) as session_date, {r('expected')} as expected_return, {r('residual')} as residual from ep")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = episodes(spark, sf_dir)
    beta, x, y = F.col("beta"), F.col("driver_return"), F.col("premarket_return")
    return frame.select("symbol", "lookback", "session_date", expected_return(beta, x).alias("expected_return"), residual(y, beta, x).alias("residual"))


# ---------------------------------------------------------------- as-of and boundary joins

@query("J01_asof_backward", f"""select l.event_id, r.event_id as driver_event_id, r.value as driver_value
 from (select * from events where event_type = '{PRIMARY}') l asof left join (select * from events where event_type = '{DRIVER}') r on l.ts >= r.ts""")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    left = events.where(F.col("event_type") == PRIMARY).select("event_id", F.lit(DRIVER).alias("driver"), "ts")
    right = events.where(F.col("event_type") == DRIVER).select(
        F.col("event_type").alias("driver"), F.col("ts").alias("driver_ts"), F.col("event_id").alias("driver_event_id"), F.col("value").alias("driver_value")
    )
    found = asof_backward(left, right, keys=["driver"], left_ts="ts", right_ts="driver_ts", values=["driver_event_id", "driver_value"])
    return found.drop("driver", "ts")


@query("J02_prior_regular_close", f"""with {CTE_FACTS}, prior as (select f.symbol, f.d, max(g.d) as pd from facts f join facts g
  on g.symbol = f.symbol and g.d < f.d and g.rslot is not null group by 1, 2)
select f.symbol, cast(f.d as varchar) as session_date, strftime(g.d + to_hours(g.rslot), '%Y-%m-%d %H:%M:%S') as prior_ts, g.rclose as prior_close
from facts f left join prior p on p.symbol = f.symbol and p.d = f.d left join facts g on g.symbol = f.symbol and g.d = p.pd""")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_prior_close(day_facts(bars(spark, sf_dir), GRID_1H)).select("symbol", "session_date", "prior_ts", "prior_close")


_PRICES = ("freeze", "open", "confirm", "decision", *[f"h{m}" for m in HORIZONS])


@query("J03_exact_boundary_prices", f"with {CTE_FACTS} select symbol, cast(d as varchar) as session_date, " + ", ".join(f"p_{p} as {p}_price" for p in _PRICES) + " from facts")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_facts(bars(spark, sf_dir), GRID_1H).select("symbol", "session_date", *[f"{p}_price" for p in _PRICES])


@query("J04_episode_assembly", f"""with {CTE_RAW} select symbol, cast(d as varchar) as session_date, prior_close, premarket_price, ds as driver_start,
 de as driver_end, {r('x')} as driver_return, {r('y')} as premarket_return from raw""")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select(
        "symbol", "session_date", "prior_close", "premarket_price", "driver_start", "driver_end", "driver_return", "premarket_return"
    )


# ---------------------------------------------------------------- windows over sessions

@query("W01_strictly_prior_beta", f"with {CTE_EPISODES} select symbol, lookback, cast(d as varchar) as session_date, {r('beta')} as beta from ep")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).select("symbol", "lookback", "session_date", "beta")


@query("W02_training_bounds", f"""with {CTE_EPISODES} select symbol, lookback, cast(d as varchar) as session_date, tc as training_count,
 cast(t0 as varchar) as training_start, cast(t1 as varchar) as training_end from ep""")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).select("symbol", "lookback", "session_date", "training_count", "training_start", "training_end")


@query("W03_full_lookback_beta", f"""with {CTE_EPISODES} select symbol, lookback, cast(d as varchar) as session_date,
 case when tc = lookback then {r('beta')} end as beta from ep""")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_frame(raw(spark, sf_dir), LOOKBACKS, full_window=True).select("symbol", "lookback", "session_date", "beta")


@query("W06_opening_confirmation", f"with {CTE_RAW} select symbol, cast(d as varchar) as session_date, {r('opening')} as opening_return from raw")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("symbol", "session_date", "opening_return")


@query("W07_forward_returns", f"with {CTE_RAW} select symbol, cast(d as varchar) as session_date, {_F} from raw")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("symbol", "session_date", *forward_columns(GRID_1H))


# ---------------------------------------------------------------- live feature

LIVE_DAYS, LIVE_THRESHOLD = 25, 0.5
CTE_LIVE = f"""{CTE_FACTS}, bar_days as (select distinct d from facts), {cte_raw(gate=False, sessions='bar_days')},
{cte_episodes((LIVE_LOOKBACK,), 'lep')},
seen as (select a.symbol, a.d, b.d as bd, case when b.tc = {LIVE_LOOKBACK} then b.residual end as residual,
  row_number() over (partition by a.symbol, a.d order by b.d) as rn from lep a join lep b on b.symbol = a.symbol
  and b.d < a.d and b.d >= a.d - {LIVE_DAYS} and b.pd >= a.d - {LIVE_DAYS}),
hist as (select symbol, d, count(*) as rows_seen, count(residual) filter (where rn > {LIVE_LOOKBACK}) as n,
  avg(residual) filter (where rn > {LIVE_LOOKBACK}) as m, stddev_samp(residual) filter (where rn > {LIVE_LOOKBACK}) as s from seen group by 1, 2),
live as (select l.*, h.n, case when h.n >= 10 and h.s > 2.220446049250313e-16 then (l.residual - h.m)/h.s end as z,
  abs(l.residual) >= {LIVE_THRESHOLD} as approved from lep l join hist h on h.symbol = l.symbol and h.d = l.d
  where h.rows_seen >= {LIVE_LOOKBACK} and l.tc = {LIVE_LOOKBACK} and l.beta is not null and l.pd >= l.d - {LIVE_DAYS})"""


def live_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No premarket gate, and the sessions are the days that have bars."""
    days = load(spark, sf_dir, "events").select(F.to_date("ts").alias("session_date")).distinct()
    return raw_episodes(bars(spark, sf_dir), days, driver=DRIVER, symbols=UNIVERSE, spec=GRID_1H, premarket_gate=False)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_features(live_raw(spark, sf_dir), lookback=LIVE_LOOKBACK, threshold=LIVE_THRESHOLD, history_days=LIVE_DAYS)


@query("C07_live_feature", f"""with {CTE_LIVE} select symbol, cast(d as varchar) as session_date, {r('x')} as driver_return, prior_close, premarket_price,
 {r('y')} as premarket_return, {r('beta')} as beta, {r('expected')} as expected_return, {r('residual')} as residual, {r('opening')} as opening_return,
 n as history_count, {r('z')} as residual_z, approved,
 case when approved then 'residual_at_or_above_threshold' else 'residual_below_frozen_threshold' end as reason from live""")
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir)


@query("W04_residual_history_zscore", f"with {CTE_LIVE} select symbol, cast(d as varchar) as session_date, n as history_count, {r('z')} as residual_z from live")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).select("symbol", "session_date", "history_count", "residual_z")


# the control series is outside the allow-list; the mean stands for the figure of a frozen study
ALLOWED, STUDY_MEAN = (PRIMARY, SECOND), 0.004239


@query("P27_signal_approval", f"""with {CTE_LIVE} select symbol, cast(d as varchar) as session_date, approved and symbol in {ALLOWED} as approved,
 case when symbol not in {ALLOWED} then 'underlying_not_approved' when approved then 'residual_at_or_above_threshold' else 'residual_below_frozen_threshold' end as reason,
 case when symbol in {ALLOWED} then {r('z')} end as residual_z, case when symbol in {ALLOWED} then {STUDY_MEAN}::double end as historical_mean_signed_return from live""")
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_evidence(live(spark, sf_dir), approved_symbols=ALLOWED, historical_mean=STUDY_MEAN)
