"""Registry of test-table queries, each with a SQL oracle, and the shared view texts."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.functions.clock import SessionSpec
from pitsignal.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 9


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result is flattened to strings, numbers and booleans."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(build(use_utc(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def flat(df: DataFrame) -> DataFrame:
    """Dates and instants as text, decimals as double, doubles to 9 digits, text arrays joined."""
    out: list[Column] = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DecimalType):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(kind, T.MapType):
            entries = F.array_sort(F.map_entries(c))
            c = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- shared view texts
# One text per view, read by Spark and by the oracle alike: they say how a test table stands in
# for an input table. The operators themselves are not shared.

SLOT_HOURS = 1

BARS_SQL = """
select event_type as symbol, cast(ts as date) as bar_date, cast(floor(hour(ts)/{h}) as int) as slot,
 min_by(value, event_id) as open, max(value) as high, min(value) as low, max_by(value, event_id) as close, count(*) as volume
from {events} group by event_type, cast(ts as date), cast(floor(hour(ts)/{h}) as int)
"""

CHAIN_SQL = """
select concat(p_brand, '/', cast(cast(floor(p_partkey/2000) as bigint) as varchar(20))) as chain_id,
 concat(cast(p_partkey as varchar(20)), '') as symbol, p_brand as underlying,
 date '2026-08-31' + cast(5 + p_size % 20 as int) as expiration,
 case when floor(p_partkey/41) % 2 = 0 then 'call' else 'put' end as option_type,
 cast(100 + k*2.5 as decimal(18,4)) as strike,
 cast(case when floor(p_partkey/41) % 2 = 0 then a else -a end as decimal(9,6)) as delta,
 cast(2 + 40*a - 0.05*(1 + p_partkey % 7) as decimal(18,4)) as bid,
 cast(2 + 40*a + 0.05*(1 + p_partkey % 7) as decimal(18,4)) as ask,
 cast(p_partkey % 90 as int) as quote_age_s
from (select p_partkey, p_brand, p_size, (p_partkey*7) % 41 as k,
  case when floor(p_partkey/41) % 2 = 0 then 0.95 - 0.0225*((p_partkey*7) % 41)
       else 0.05 + 0.0225*((p_partkey*7) % 41) end as a from {part}) p
"""

DECISIONS_SQL = """
select event_id, user_id as scenario,
 case event_type when 'click' then 'continuation' when 'view' then 'continuation' when 'purchase' then 'reversion'
  when 'signup' then 'abstain' else 'abstain' end as action,
 case when event_id % 4 = 0 then 'crypto_cross_market' when event_id % 4 = 1 then 'company_specific'
  when event_id % 4 = 2 then 'macro' else 'unclear' end as driver,
 event_id % 4 = 1 as idiosyncratic_news_detected, least(value/500, 1.0) as confidence,
 case when event_type='error' then 'fail_closed:malformed_json' else concat('r', cast(event_id % 3 as varchar(5))) end as reason
from {events}
"""

TRANSITIONS_SQL = """
select user_id as episode_id, event_id as transition_id, event_type as to_state,
 lag(event_type) over (partition by user_id order by event_id) as from_state, ts as created_at from {events}
"""

ORDERS_SQL = """
select o_orderkey as order_id, o_custkey as episode_id, case when o_orderkey % 5 = 0 then 'close' else 'open' end as phase,
 o_orderstatus as status, o_orderdate as created_at from {orders}
"""

BROKER_SQL = """
select l_orderkey as order_id, max(l_linestatus) as line_status, max(l_returnflag) as return_flag
from {lineitem} where l_orderkey % 11 <> 0 group by l_orderkey
"""


def for_oracle(view: str) -> str:
    names = ("events", "part", "orders", "lineitem")
    return view.format(h=SLOT_HOURS, **{n: n for n in names})


def for_spark(spark: SparkSession, sf_dir: str, view: str, hours: int = SLOT_HOURS) -> DataFrame:
    text = view.replace("{h}", str(hours))
    names = [n for n in ("events", "part", "orders", "lineitem") if "{" + n + "}" in text]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in names})


# ---------------------------------------------------------------- bar and session binding

DRIVER, PRIMARY, SECOND, CONTROL = "view", "purchase", "click", "signup"
UNIVERSE = (PRIMARY, SECOND, CONTROL)
LOOKBACKS = (3, 5, 8)
LIVE_LOOKBACK = 8

GRID_1H = SessionSpec(
    tz="UTC",
    premarket_start="04:00",
    freeze="09:00",
    open="10:00",
    confirm="11:00",
    decision="12:00",
    regular_start="10:00",
    regular_end="20:00",
    horizons={15: "13:00", 30: "14:00", 45: "15:00", 60: "16:00", 90: "17:00", 120: "18:00"},
)
GRID_4H = SessionSpec(
    tz="UTC",
    premarket_start="04:00",
    freeze="08:00",
    open="12:00",
    confirm="12:00",
    decision="16:00",
    regular_start="12:00",
    regular_end="23:00",
    horizons={60: "20:00"},
)


def bars(spark: SparkSession, sf_dir: str, hours: int = SLOT_HOURS) -> DataFrame:
    slots = for_spark(spark, sf_dir, BARS_SQL, hours)
    ts = F.timestamp_add("HOUR", F.col("slot") * F.lit(hours), F.col("bar_date").cast("timestamp"))
    return slots.select(
        "symbol", ts.alias("ts"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume")
    )


def event_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return load(spark, sf_dir, "events").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


# ---------------------------------------------------------------- oracle fragments

def r(expr: str) -> str:
    """Round as the queries do; adding zero turns a negative zero into zero."""
    return f"(round({expr}, {DIGITS}) + 0.0)"


_SLOTS = {"freeze": 9, "open": 10, "confirm": 11, "decision": 12, "h15": 13, "h30": 14, "h45": 15, "h60": 16, "h90": 17, "h120": 18}
HORIZONS = (15, 30, 45, 60, 90, 120)

CTE_BARS = f"bars as ({for_oracle(BARS_SQL)})"
CTE_FACTS = (
    CTE_BARS
    + """, facts as (select symbol, bar_date as d,
 max(case when slot between 10 and 19 then slot end) as rslot,
 max_by(close, slot) filter (where slot between 10 and 19) as rclose,
 count(*) filter (where slot between 4 and 9) as pm, """
    + ", ".join(f"max(case when slot = {s} then open end) as p_{n}" for n, s in _SLOTS.items())
    + " from bars group by 1, 2)"
)
CTE_SESSIONS = """sessions as (select d from (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as d
 from (select min(cast(ts as date)) as a, max(cast(ts as date)) as b from events)) where isodow(d) <= 5)"""


def cte_raw(gate: bool = True, sessions: str = "sessions") -> str:
    premarket = "and f.pm > 0" if gate else ""
    forwards = ", ".join(
        f"case when f.p_decision > 0 then f.p_h{m}/f.p_decision - 1 end as f{m}" for m in HORIZONS
    )
    return f"""prior as (select f.symbol, f.d, max(g.d) as pd from facts f join facts g
  on g.symbol = f.symbol and g.d < f.d and g.rslot is not null group by 1, 2),
raw0 as (select f.*, g.rclose as prior_close, g.rslot as prior_slot, p.pd,
  (select max_by(b.close, b.bar_date + to_hours(b.slot)) from bars b where b.symbol = '{DRIVER}'
    and (b.bar_date < p.pd or (b.bar_date = p.pd and b.slot <= g.rslot))) as ds, v.p_freeze as de
  from facts f join prior p on p.symbol = f.symbol and p.d = f.d
  join facts g on g.symbol = f.symbol and g.d = p.pd
  join facts v on v.symbol = '{DRIVER}' and v.d = f.d
  where f.symbol in {UNIVERSE} and f.d in (select d from {sessions})),
raw as (select f.symbol, f.d, f.pd, f.prior_slot, f.prior_close, f.p_freeze as premarket_price, f.ds, f.de,
  f.de/f.ds - 1 as x, f.p_freeze/f.prior_close - 1 as y,
  case when f.p_open > 0 then f.p_confirm/f.p_open - 1 end as opening, {forwards}
  from raw0 f where f.p_freeze is not null and f.de is not null and f.ds > 0 and f.prior_close > 0 {premarket})"""


CTE_RAW = f"{CTE_FACTS}, {CTE_SESSIONS}, {cte_raw()}"


def cte_episodes(lookbacks: tuple[int, ...] = LOOKBACKS, name: str = "ep", source: str = "raw") -> str:
    parts = []
    for n in lookbacks:
        w = f"(partition by symbol order by d rows between {n} preceding and 1 preceding)"
        parts.append(
            f"select *, {n} as lookback, case when regr_sxx(y, x) over {w} > 2.220446049250313e-16 "
            f"and count(*) over {w} >= 2 then regr_slope(y, x) over {w} end as beta, "
            f"count(*) over {w} as tc, min(d) over {w} as t0, max(d) over {w} as t1 from {source}"
        )
    return f"{name} as (select *, beta * x as expected, y - beta * x as residual from ({' union all '.join(parts)}))"


CTE_EPISODES = f"{CTE_RAW}, {cte_episodes()}"
