"""Option chains, spreads, risk and stress on the test tables."""

from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.bindings.base import CHAIN_SQL, for_oracle, for_spark, load, query, r
from pitsignal.functions import numeric
from pitsignal.functions.clock import in_entry_window
from pitsignal.functions.contracts import age_seconds, contract_terms, days_to_expiry, direction, has_offset, option_type_for, structure_for
from pitsignal.operators import risk, spreads
from pitsignal.operators.spreads import SpreadPolicy
from pitsignal.plans import stress
from pitsignal.sources import chains

NOW_TEXT = "2026-08-31 14:00:00"


def now() -> Column:
    """The instant every chain query is evaluated at."""
    return F.lit(NOW_TEXT).cast("timestamp")


APPROVED = tuple(f"Brand#{i}" for i in range(1, 21))
POLICY = SpreadPolicy(approved=APPROVED)
_APPROVED_SQL = "(" + ", ".join(f"'{b}'" for b in APPROVED) + ")"


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = for_spark(spark, sf_dir, CHAIN_SQL)
    return table.withColumn("quote_ts", F.timestamp_add("SECOND", -F.col("quote_age_s"), now())).drop("quote_age_s")


def thin_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with missing greeks: two brands wholly, and every eleventh contract."""
    bare = F.col("underlying").isin("Brand#3", "Brand#4") | (F.col("symbol").cast("bigint") % 11 == 0)
    return chain(spark, sf_dir).withColumn("delta", F.when(~bare, F.col("delta")))


CTE_CHAIN = f"chain as (select *, timestamp '{NOW_TEXT}' - to_seconds(quote_age_s) as quote_ts from ({for_oracle(CHAIN_SQL)}))"
CTE_THIN = f"""{CTE_CHAIN}, thin as (select * replace (case when underlying not in ('Brand#3', 'Brand#4') and symbol::bigint % 11 <> 0 then delta end as delta) from chain)"""


def cte_eligible(source: str = "chain", delta: bool = True) -> str:
    return f"""elig as (select * from {source} where underlying in {_APPROVED_SQL} and expiration - date '2026-08-31' between 7 and 21
 and quote_age_s between 0 and 60 and bid > 0 and ask >= bid and (ask - bid)*2 <= 0.25*(ask + bid) {'and delta is not null' if delta else ''})"""


CTE_PAIRS = """pairs as (select l.chain_id, l.expiration, l.option_type, l.symbol as ls, s.symbol as ss, l.strike as lk, s.strike as sk, l.delta as ld, s.delta as sd, l.ask as la,
  l.ask - s.bid as debit, abs(l.delta) - abs(s.delta) as net, least(l.quote_ts, s.quote_ts) as qt,
  ((abs(l.delta) - abs(s.delta))*1000000)::bigint::hugeint*10000000000000000000000 // ((l.ask - s.bid)*10000)::bigint::hugeint as score
  from elig l join elig s on s.chain_id = l.chain_id and s.expiration = l.expiration and s.option_type = l.option_type
  and abs(l.delta) between 0.45 and 0.65 and abs(s.delta) >= 0.10
  and (case when l.option_type = 'call' then s.strike - l.strike else l.strike - s.strike end) > 0
  and l.ask - s.bid > 0 and l.ask - s.bid < abs(s.strike - l.strike) and abs(l.delta) - abs(s.delta) >= 0.30)"""
_ORDER = "score desc, net desc, debit, expiration, ls, ss"
CTE_BEST = f"""{CTE_CHAIN}, {cte_eligible()}, {CTE_PAIRS}, best as (select * from (select *, row_number() over (partition by chain_id, option_type order by {_ORDER}) as rn from pairs) where rn = 1)"""
_CAND = f"""chain_id, case option_type when 'call' then 'bullish' else 'bearish' end as direction, option_type || '_debit_spread' as structure, expiration::varchar as expiration,
 ls as long_symbol, ss as short_symbol, lk::double as long_strike, sk::double as short_strike, ld::double as long_delta, sd::double as short_delta, net::double as net_delta,
 round(debit, 2)::double as net_debit, {r('net::double/debit::double')} as delta_per_debit, (round(debit, 2)*100)::double as max_loss, strftime(qt, '%Y-%m-%d %H:%M:%S') as quote_ts"""


# ---------------------------------------------------------------- ingest

_OCC = "concat('P', p_partkey, 'Z', strftime(expiration, '%y%m%d'), case option_type when 'call' then 'C' else 'P' end, lpad((strike*1000)::bigint::varchar, 8, '0'))"


def _occ_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    tail = F.concat(
        F.date_format("expiration", "yyMMdd"), F.when(c("option_type") == "call", "C").otherwise("P"), F.lpad((c("strike") * 1000).cast("bigint").cast("string"), 8, "0")
    )
    table = chain(spark, sf_dir)
    return table.withColumn("part", c("symbol").cast("bigint")).withColumn("symbol", F.concat(F.lit("P"), "symbol", F.lit("Z"), tail))


def _snapshot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 50 contracts as JSON; some without quote, without ask or without greeks."""
    c = F.col
    quote = F.when(
        c("part") % 10 != 0,
        F.struct(
            F.concat(F.date_format("quote_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("t"),
            c("bid").alias("bp"),
            F.when(c("part") % 17 != 0, c("ask")).alias("ap"),
        ),
    )
    greeks = F.when(c("part") % 7 != 0, F.struct(c("delta").alias("delta")))
    snap = F.struct(quote.alias("latestQuote"), greeks.alias("greeks"))
    return (
        _occ_chain(spark, sf_dir)
        .groupBy(F.floor(c("part") / 50).alias("page"))
        .agg(F.map_from_entries(F.collect_list(F.struct("symbol", snap))).alias("snapshots"))
        .select("page", F.to_json(F.struct("snapshots")).alias("payload"))
    )


_CHAIN_PART = f"{CTE_CHAIN}, cp as (select *, symbol::bigint as p_partkey from chain), occ as (select *, {_OCC} as occ from cp)"


@query("S06_option_snapshot_flatten", f"""with {_CHAIN_PART} select p_partkey // 50 as page, occ as symbol, expiration::varchar as expiration, option_type, strike::double as strike,
 bid::double as bid, ask::double as ask, case when p_partkey % 7 <> 0 then delta::double end as delta, strftime(quote_ts, '%Y-%m-%d %H:%M:%S') as quote_ts
 from occ where p_partkey % 10 <> 0 and p_partkey % 17 <> 0""")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.flatten_snapshots(_snapshot_pages(spark, sf_dir), keep=["page"])


@query("S07_page_merge", """select p_brand as chain_id, p_partkey % 500 as contract, max(p_partkey // 500) as page, max_by(p_retailprice, p_partkey // 500) as price
 from part group by 1, 2""")
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("chain_id"), (F.col("p_partkey") % 500).alias("contract"), F.floor(F.col("p_partkey") / 500).alias("page"), F.col("p_retailprice").alias("price")
    )
    return chains.latest_page(rows, keys=["chain_id", "contract"], page="page")


@query("S08_expiration_window", f"with {CTE_CHAIN} select chain_id, symbol, expiration::varchar as expiration from chain where expiration between date '2026-09-07' and date '2026-09-21'")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = now().cast("date")
    return chains.expiring_between(chain(spark, sf_dir), F.date_add(day, 7), F.date_add(day, 21)).select("chain_id", "symbol", "expiration")


@query("F01_contract_symbol_parse", f"with {_CHAIN_PART} select occ as symbol, expiration::varchar as expiration, option_type, strike::double as strike from occ")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    expiration, kind, strike = contract_terms(F.col("symbol"))
    return _occ_chain(spark, sf_dir).select("symbol", expiration.alias("expiration"), kind.alias("option_type"), strike.alias("strike"))


@query("F02_offset_timestamp", """select event_id, event_id % 3 <> 0 as has_offset, case when event_id % 3 <> 0 then strftime(date_trunc('second', ts)
 - case when event_id % 3 = 2 then interval 4 hours else interval 0 hours end, '%Y-%m-%d %H:%M:%S') end as parsed from events""")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Z").otherwise("+04:00"),
    )
    stamped = load(spark, sf_dir, "events").select("event_id", text.alias("text"))
    ok = has_offset(F.col("text"))
    return stamped.select("event_id", ok.alias("has_offset"), F.when(ok, F.to_timestamp("text")).alias("parsed"))


@query("T07_chain_canonical_order", f"""with {CTE_CHAIN} select chain_id, symbol, row_number() over (partition by chain_id order by expiration, option_type, strike, symbol) - 1 as position from chain""")
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.with_position(chain(spark, sf_dir), "chain_id").select("chain_id", "symbol", "position")


# ---------------------------------------------------------------- predicates

@query("P15_relative_spread", f"""with {CTE_CHAIN} select symbol, case when b > 0 and ask >= b then {r('((ask - b)*2)::double/(ask + b)::double')} end as relative_spread
 from (select *, case when symbol::bigint % 5 = 0 then 0 when symbol::bigint % 5 = 1 then bid + 1 else bid end as b from chain)""")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("symbol").cast("bigint") % 5
    bid = F.when(part == 0, F.lit(Decimal("0"))).when(part == 1, F.col("bid") + 1).otherwise(F.col("bid"))
    return chain(spark, sf_dir).select("symbol", numeric.relative_spread(bid, F.col("ask")).alias("relative_spread"))


@query("P16_expiry_and_quote_age", f"with {CTE_CHAIN} select symbol, expiration - date '2026-08-31' as dte, quote_age_s::double as age_seconds, quote_age_s <= 60 as fresh from chain")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = age_seconds(F.col("quote_ts"), now())
    return chain(spark, sf_dir).select(
        "symbol", days_to_expiry(F.col("expiration"), now()).alias("dte"), age.alias("age_seconds"), age.between(0, 60).alias("fresh")
    )


_REASON = f"""case when underlying not in {_APPROVED_SQL} then 'underlying_not_approved' when expiration - date '2026-08-31' not between 7 and 21 then 'expiration_outside_window'
 when quote_age_s > 60 then 'quote_age_outside_limit' when (ask - bid)*2 > 0.25*(ask + bid) then 'quote_invalid_or_wide' when delta is null then 'missing_delta' end"""


@query("P17_quote_eligibility", f"with {CTE_THIN} select symbol, {_REASON} as reason from thin")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thin_chain(spark, sf_dir).select("symbol", spreads.rejection_reason(POLICY, now(), need_delta=True).alias("reason"))


@query("P18_delta_window", f"with {CTE_CHAIN} select symbol, abs(delta) between 0.45 and 0.65 as long_ok, abs(delta) >= 0.10 as short_ok from chain")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("delta")
    return chain(spark, sf_dir).select("symbol", spreads.long_delta_ok(POLICY, d).alias("long_ok"), spreads.short_delta_ok(POLICY, d).alias("short_ok"))


@query("P19_direction_map", """with d as (select event_id, case event_type when 'view' then 'continuation' when 'click' then 'reversion' else 'abstain' end as action, sign(value - 50)::int as s from events),
 e as (select *, case action when 'continuation' then s when 'reversion' then -s end as eff from d)
 select event_id, case eff when 1 then 'bullish' when -1 then 'bearish' end as direction, case eff when 1 then 'call' when -1 then 'put' end as option_type,
 case eff when 1 then 'call_debit_spread' when -1 then 'put_debit_spread' end as structure from e""")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "view", "continuation").when(kind == "click", "reversion").otherwise("abstain")
    side = direction(action, F.signum(F.col("value") - 50).cast("int"))
    return load(spark, sf_dir, "events").select(
        "event_id", side.alias("direction"), option_type_for(side).alias("option_type"), structure_for(option_type_for(side)).alias("structure")
    )


@query("P22_max_loss", f"with {CTE_CHAIN} select symbol, round(ask + 0.005, 2)::double as net_debit, (round(ask + 0.005, 2)*100)::double as max_loss from chain")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit = F.col("ask") + F.lit(Decimal("0.005"))
    return chain(spark, sf_dir).select("symbol", numeric.cents_half_up(debit).alias("net_debit"), spreads.max_loss(debit).alias("max_loss"))


@query("P28_allow_list", f"with {CTE_CHAIN} select chain_id, symbol from chain where underlying in {_APPROVED_SQL}")
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).where(POLICY.is_approved(F.col("underlying"))).select("chain_id", "symbol")


@query("F03_decimal_rounding", """select p_partkey, round((p_retailprice*1.005)::decimal(18,4), 2)::double as half_up, trunc((p_retailprice*1.005)::decimal(18,4)*100)::double/100 as truncated,
 greatest(0.01, round(p_retailprice/100000 - 0.004, 2)) as floored, round(p_retailprice/7777777, 6) as quantum from part""")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    wide = (price * 1.005).cast("decimal(18,4)")
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        numeric.cents_half_up(wide).alias("half_up"),
        numeric.truncate_cents(wide).alias("truncated"),
        numeric.quote_quantum(price / 100000 - 0.004).alias("floored"),
        F.round(price / 7777777, 6).alias("quantum"),
    )


@query("F10_entry_window", """select event_id, cast(timezone('America/New_York', timezone('UTC', ts)) as time) between time '09:55:00' and time '15:30:00' as in_window from events""")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", in_entry_window(F.col("ts").cast("timestamp"), "09:55", "15:30", "America/New_York").alias("in_window"))


# ---------------------------------------------------------------- pairing and selection

@query("J05_vertical_leg_pairing", f"""with {CTE_CHAIN}, {cte_eligible()}, {CTE_PAIRS}, b as (select *, row_number() over (partition by chain_id, expiration, option_type, lk, la order by {_ORDER}) as rn from pairs)
 select chain_id, expiration::varchar as expiration, option_type, lk::double as long_strike, la::double as long_ask, ls as long_symbol, ss as short_symbol, sk::double as short_strike,
 debit::double as debit, net::double as net_delta from b where rn = 1""")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = spreads.eligible_contracts(chain(spark, sf_dir), POLICY, now())
    best = spreads.best_short_per_long(legs, ["chain_id"], POLICY)
    return best.select(
        "chain_id", "expiration", "option_type", "long_strike", "long_ask", F.col("long.symbol").alias("long_symbol"), F.col("short.symbol").alias("short_symbol"),
        "short_strike", "debit", "net_delta",
    )


@query("J06_vertical_exists", f"with {CTE_CHAIN}, {cte_eligible()}, {CTE_PAIRS} select distinct chain_id, option_type from pairs")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreads.vertical_exists(spreads.eligible_contracts(chain(spark, sf_dir), POLICY, now()), ["chain_id"], POLICY)


CTE_FEAS = f"""{CTE_THIN}, {cte_eligible('thin', delta=False)}, {CTE_PAIRS}, fc as (select chain_id, bool_and(underlying in {_APPROVED_SQL}) as ok from thin group by 1),
ec as (select chain_id, count(*) as n, count(delta) as nd from elig group by 1), sides as (select chain_id, bool_or(option_type = 'call') as c, bool_or(option_type = 'put') as p from pairs group by 1),
feas as (select fc.chain_id, case when not ok then 'underlying_not_approved' when coalesce(n, 0) = 0 then 'no_eligible_contracts' when nd = 0 then 'missing_required_delta'
  when not coalesce(c, false) and not coalesce(p, false) then 'no_compatible_vertical' end as reason, coalesce(c, false) as c, coalesce(p, false) as p, case when ok then coalesce(n, 0) else 0 end as n
  from fc left join ec using (chain_id) left join sides using (chain_id))"""


@query("J07_option_feasibility", f"""with {CTE_FEAS} select chain_id, reason is null as feasible, reason,
 case when reason is null then concat_ws(',', case when c then 'call_debit_spread' end, case when p then 'put_debit_spread' end) else '' end as available_structures, n as eligible_contract_count from feas""")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreads.feasibility(thin_chain(spark, sf_dir), ["chain_id"], POLICY, now())


@query("T01_best_vertical", f"with {CTE_BEST} select {_CAND} from best")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreads.best_verticals(chain(spark, sf_dir), ["chain_id"], POLICY, now())


@query("T02_richest_candidate", f"""with {CTE_BEST}, cand as (select {_CAND} from best) select * exclude (rn) from (select *, row_number() over (partition by chain_id order by net_debit desc, expiration desc, long_symbol desc) as rn from cand)
 where rn = 1 and net_debit >= 5""")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreads.richest_candidate(spreads.best_verticals(chain(spark, sf_dir), ["chain_id"], POLICY, now()), ["chain_id"], Decimal("5"))


# ---------------------------------------------------------------- risk and close

RISK = risk.RiskPolicy(approved=tuple(f"U{i}" for i in range(1, 25)), final_entry_cutoff=datetime(2000, 1, 1, tzinfo=timezone.utc))


def risk_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and portfolios from the orders table."""
    key = F.col("o_orderkey")
    at = F.timestamp_add("MINUTE", (key % 1440).cast("int"), F.col("o_orderdate").cast("timestamp"))
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("U"), (F.col("o_custkey") % 30).cast("string")).alias("underlying"),
        (F.floor(F.col("o_totalprice") / 2) / 100).cast("decimal(18,2)").alias("max_loss"),
        F.lit(Decimal("100000")).cast("decimal(18,2)").alias("starting_equity"),
        (F.lit(3000) - (key % 40) * 80).cast("decimal(18,2)").alias("buying_power"),
        ((key % 60) * 90).cast("decimal(18,2)").alias("aggregate_defined_loss"),
        F.when(key % 3 == 0, F.array(F.lit("U1"), F.lit("U2"), F.lit("U7"))).otherwise(F.array().cast("array<string>")).alias("open_underlyings"),
        F.timestamp_add("SECOND", (F.lit(5) - key % 90).cast("int"), at).alias("quote_ts"),
        at.alias("now"),
    )


_RISK_IN = """ri as (select o_orderkey as order_id, concat('U', o_custkey % 30) as underlying, (floor(o_totalprice/2)/100)::decimal(18,2) as ml, 3000 - (o_orderkey % 40)*80 as bp,
 (o_orderkey % 60)*90 as agg, o_orderkey % 3 = 0 as held, o_orderdate + to_minutes((o_orderkey % 1440)::int) as now, o_orderkey % 90 - 5 as age from orders)"""
_NYT = "cast(timezone('America/New_York', timezone('UTC', now)) as time)"
_RISK_REASONS = f"""concat_ws(',', case when underlying in ('U0', 'U25', 'U26', 'U27', 'U28', 'U29') then 'underlying_not_approved' end, case when held and underlying in ('U1', 'U2', 'U7') then 'underlying_already_open' end,
 case when ml > 1000 then 'per_position_loss_cap' end, case when agg + ml > 5000 then 'aggregate_loss_cap' end, case when ml > bp then 'insufficient_buying_power' end,
 case when age < 0 or age > 60 then 'stale_quote' end, case when {_NYT} < time '09:55:00' or {_NYT} > time '15:30:00' then 'outside_entry_window' end,
 case when now >= timestamp '2000-01-01' then 'final_event_cutoff' end)"""


@query("P20_debit_budget", f"with {_RISK_IN} select order_id, greatest(least(1000, 5000 - agg, bp), 0)/100.0 as max_net_debit from ri")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_inputs(spark, sf_dir).select("order_id", risk.debit_budget(RISK).alias("max_net_debit"))


@query("P21_risk_gates", f"with {_RISK_IN}, x as (select *, {_RISK_REASONS} as reasons from ri) select order_id, reasons = '' as approved, reasons, (agg + ml)::double as aggregate_after from x")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.evaluate_risk(risk_inputs(spark, sf_dir), RISK).select("order_id", "approved", "reasons", "aggregate_after")


def open_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("symbol").cast("bigint")
    return chain(spark, sf_dir).select(
        key.alias("spread_id"), F.lit("book").alias("book"), F.col("symbol").alias("long_symbol"), (key + 84).cast("string").alias("short_symbol"), (key % 2).cast("int").alias("attempt")
    )


_CLOSE = f"""{CTE_CHAIN}, sp as (select symbol::bigint as spread_id, symbol as lsym, (symbol::bigint + 84)::varchar as ssym, symbol::bigint % 2 as attempt from chain),
cl as (select sp.*, l.underlying as lu, s.underlying as su, s.strike - l.strike as gap, l.bid - s.ask as credit, least(l.quote_ts, s.quote_ts) as qt,
 case when s.symbol is null then 'contracts_not_in_chain' when l.underlying not in {_APPROVED_SQL} or s.underlying not in {_APPROVED_SQL} then 'underlying_not_approved'
 when l.expiration <> s.expiration then 'expiration_differs' when l.option_type <> s.option_type then 'option_type_differs'
 when l.option_type = 'call' and s.strike <= l.strike then 'not_the_opening_call_vertical' when l.option_type = 'put' and s.strike >= l.strike then 'not_the_opening_put_vertical'
 when l.quote_age_s > 60 then 'stale_close_quote_long' when s.quote_age_s > 60 then 'stale_close_quote_short' end as reason
 from sp join chain l on l.symbol = lsym left join chain s on s.symbol = ssym)"""


def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = chain(spark, sf_dir).withColumn("book", F.lit("book"))
    return risk.close_instructions(open_spreads(spark, sf_dir), book, keys=["book"], approved=APPROVED, now=now())


@query("P23_close_pricing", f"""with {_CLOSE} select spread_id, attempt, -(case when attempt = 1 then 0.01 else greatest(0.01, trunc(credit*100)/100.0) end)::double as limit_price,
 strftime(qt, '%Y-%m-%d %H:%M:%S') as quote_ts from cl where reason is null""")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closing(spark, sf_dir).where("reason is null").select("spread_id", "attempt", "limit_price", "quote_ts")


@query("P24_close_validation", f"with {_CLOSE} select spread_id, reason from cl")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closing(spark, sf_dir).select("spread_id", "reason")


@query("A24_portfolio_state", """select l_suppkey as account, array_to_string(list_sort(list_distinct(list(case when s like 'U1%' then 'U1' else s end))), ',') as open_underlyings
 from (select l_suppkey, concat('U', l_partkey % 20) as s from lineitem) group by 1""")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("account"), F.concat(F.lit("U"), (F.col("l_partkey") % 20).cast("string")).alias("symbol"))
    return risk.open_underlyings(positions, ["account"], prefixes=("U1",))


# ---------------------------------------------------------------- stress

TRIALS, SEED = 2000, 20260901
BUDGET = Decimal("19.00")


def stress_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).withColumn("max_net_debit", F.lit(BUDGET).cast("decimal(18,4)"))


def stressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stress.packed_trials(
        stress_chain(spark, sf_dir), key="chain_id", policy=POLICY, now=now(), max_debit="max_net_debit", trials=TRIALS, seed=SEED
    )


def stress_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stress_chain(spark, sf_dir)
    return spreads.best_verticals(table, ["chain_id"], POLICY, now(), "max_net_debit").withColumn("max_net_debit", F.lit(BUDGET).cast("decimal(18,4)"))


def _u(i: int, w: str) -> str:
    return f"(-{w} + 2*{w}*(('0x' || substr(dg, {1 + 8 * i}, 8))::bigint/4294967296.0::double))"


CTE_PERTURB = f"""{CTE_CHAIN}, bands as (select * from (values ('micro', 0.0025::double, 0.10::double, 0.005::double), ('small', 0.0050, 0.20, 0.010), ('moderate', 0.0100, 0.40, 0.020)) v(band, mf, sf, da)),
pr0 as (select c.* exclude (bid, ask, delta), c.bid as bid0, c.ask as ask0, c.delta as delta0, b.*, t.trial, md5(concat_ws('|', '{SEED}', band, trial, symbol)) as dg from chain c, bands b, range(1, {TRIALS + 1}) t(trial)),
pr1 as (select *, (bid0::double + ask0::double)/2*(1 + {_u(0, 'mf')}) as mid, greatest(0, greatest(0, (ask0::double - bid0::double)/2)*(1 + {_u(1, 'sf')})) as half,
  least(0.999999, greatest(0.000001, abs(delta0)::double + {_u(2, 'da')})) as mag from pr0),
pr2 as (select *, greatest(0.01, round(greatest(0.01, mid - half), 2)) as nb from pr1),
pert as (select chain_id as chain0, chain_id || '~' || band || '~' || trial as chain_id, symbol, underlying, expiration, option_type, strike, quote_age_s, quote_ts, band, trial, nb::decimal(18,4) as bid,
  greatest(nb, greatest(0.01, round(greatest(nb, mid + half), 2)))::decimal(18,4) as ask, ((case when delta0 >= 0 then 1 else -1 end)*round(mag, 6))::decimal(9,6) as delta from pr2)"""


@query("F11_quote_perturbation", f"""with {CTE_PERTURB} select chain0 as chain_id, symbol, band, count(*) as trials, min(bid)::double as low_bid, max(bid)::double as high_bid, min(ask)::double as low_ask, max(ask)::double as high_ask,
 min(delta)::double as low_delta, max(delta)::double as high_delta from pert group by all""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stress.quote_extremes(chain(spark, sf_dir), key="chain_id", trials=TRIALS, seed=SEED)
    return found.select("chain_id", "symbol", "band", "trials", *[f"{n}_{c}" for c in ("bid", "ask", "delta") for n in ("low", "high")])


CTE_STRESS = f"""{CTE_PERTURB}, {cte_eligible('pert')}, {CTE_PAIRS}, tr as (select split_part(chain_id, '~', 1) as chain_id, split_part(chain_id, '~', 2) as band, split_part(chain_id, '~', 3)::bigint as trial, * exclude (chain_id)
  from (select *, row_number() over (partition by chain_id, option_type order by {_ORDER}) as rn from pairs where debit <= {BUDGET}) where rn = 1),
belig as (select * from chain where underlying in {_APPROVED_SQL} and expiration - date '2026-08-31' between 7 and 21 and quote_age_s between 0 and 60 and bid > 0 and ask >= bid and (ask - bid)*2 <= 0.25*(ask + bid)),
{CTE_PAIRS.replace('pairs as', 'bpairs as').replace('elig ', 'belig ')}, base as (select * from (select *, row_number() over (partition by chain_id, option_type order by {_ORDER}) as rn from bpairs where debit <= {BUDGET}) where rn = 1)"""
_DIR = "case option_type when 'call' then 'bullish' else 'bearish' end"


@query("J14_stress_vs_baseline", f"""with {CTE_STRESS} select t.chain_id, t.band, t.trial, {_DIR.replace('option_type', 't.option_type')} as direction, t.ls as long_symbol, t.ss as short_symbol, t.ls = b.ls as same_long,
 t.ss = b.ss as same_short, t.expiration = b.expiration as same_expiration from tr t join base b on b.chain_id = t.chain_id and b.option_type = t.option_type""")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stress_base(spark, sf_dir).select("chain_id", "direction", F.col("long_symbol").alias("bl"), F.col("short_symbol").alias("bs"), F.col("expiration").alias("be"))
    return stressed(spark, sf_dir).join(base, ["chain_id", "direction"]).select(
        "chain_id", "band", F.explode("trials").alias("trial"), "direction", "long_symbol", "short_symbol",
        (F.col("long_symbol") == F.col("bl")).alias("same_long"), (F.col("short_symbol") == F.col("bs")).alias("same_short"), (F.col("expiration") == F.col("be")).alias("same_expiration"),
    )


def _q3(expr: str, label: str) -> str:
    return ", ".join(f"{r(f'quantile_cont({expr}, {p})')} as {label}_{n}" for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95")))


_SUM = f"""with {CTE_STRESS}, cmp as (select b.chain_id, b.option_type, bd.band, b.ls as bl, b.ss as bs, b.expiration as be, t.ls, t.ss, t.expiration as te, t.debit, t.net, round(t.debit, 2) as nd
  from base b join bands bd on true left join tr t on t.chain_id = b.chain_id and t.option_type = b.option_type and t.band = bd.band)
 select chain_id, {_DIR} as direction, band, """
_SUM_A22 = f"""count(ls) as candidate_count, {TRIALS} - count(ls) as abstention_count, {r(f'count(ls)/{TRIALS}')} as candidate_rate,
 coalesce({r('count(*) filter (where ls = bl and ss = bs)/nullif(count(ls), 0)')}, 0) as same_pair_rate, coalesce({r('count(*) filter (where ls = bl)/nullif(count(ls), 0)')}, 0) as same_long_rate,
 coalesce({r('count(*) filter (where ss = bs)/nullif(count(ls), 0)')}, 0) as same_short_rate, coalesce({r('count(*) filter (where te = be)/nullif(count(ls), 0)')}, 0) as same_expiration_rate,
 count(*) filter (where nd > {BUDGET} or nd*100 > {BUDGET}*100 or net < 0.30 or nd <= 0) as risk_invariant_violations"""
_SUM_A23 = ", ".join((_q3("net::double", "net_delta"), _q3("(nd*100)::double", "max_loss"), _q3("nd::double", "net_debit"), _q3("net::double/debit::double", "delta_per_debit")))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stress.stress_summary(stressed(spark, sf_dir), stress_base(spark, sf_dir), key="chain_id", policy=POLICY, trials=TRIALS)


@query("A22_stress_rates", f"{_SUM} {_SUM_A22} from cmp group by chain_id, option_type, band")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = summary(spark, sf_dir)
    return table.select(*[c for c in table.columns if not c.endswith(("_p05", "_p50", "_p95"))])


@query("A23_stress_quantiles", f"{_SUM} {_SUM_A23} from cmp group by chain_id, option_type, band")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = summary(spark, sf_dir)
    return table.select("chain_id", "direction", "band", *[c for c in table.columns if c.endswith(("_p05", "_p50", "_p95"))])


@query("T03_top_leg_pairs", f"""with {CTE_STRESS}, pc as (select chain_id, {_DIR} as direction, band, ls || '|' || ss as pair, count(*) as count from tr group by all)
 select * from (select *, {r('count/sum(count) over w')} as rate, row_number() over (partition by chain_id, direction, band order by count desc, pair) as position from pc window w as (partition by chain_id, direction, band))
 where position <= 5""")
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stress.top_pairs(stressed(spark, sf_dir), key="chain_id")


@query("C05_quote_surface_stress", f"{_SUM} {_SUM_A22}, {_SUM_A23} from cmp group by chain_id, option_type, band")
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir)


_REPORT = f"""with {CTE_STRESS}, cmp as (select b.chain_id, b.option_type, bd.band, b.ls as bl, b.ss as bs, b.expiration as be, t.ls, t.ss, t.expiration as te, t.debit, t.net, round(t.debit, 2) as nd
  from base b join bands bd on true left join tr t on t.chain_id = b.chain_id and t.option_type = b.option_type and t.band = bd.band),
 sm as (select chain_id, option_type, band, {_SUM_A22}, {_SUM_A23} from cmp group by chain_id, option_type, band),
 pc as (select chain_id, option_type, band, ls || '|' || ss as pair, count(*) as count from tr group by all),
 tp as (select chain_id, option_type, band, string_agg(pair || ':' || count, ',' order by place) as top_pairs from (select *, row_number() over (partition by chain_id, option_type, band order by count desc, pair) as place from pc) where place <= 5 group by all),
 side as (select chain_id, option_type, n from (select chain_id, count(*) as n from chain group by 1), (values ('call'), ('put')) v(option_type))
 select s.chain_id, {_DIR.replace('option_type', 's.option_type')} as direction, s.n as contract_count, {TRIALS} as trials_per_band, {BUDGET}::double as max_net_debit, b.ls is not null as baseline_constructible,
  b.ls as base_long_symbol, b.ss as base_short_symbol, b.expiration::varchar as base_expiration, b.net::double as base_net_delta, round(b.debit, 2)::double as base_net_debit,
  {r('b.net::double/b.debit::double')} as base_delta_per_debit, (round(b.debit, 2)*100)::double as base_max_loss, bd.band, bd.mf as midpoint_fraction, bd.sf as spread_fraction, bd.da as delta_absolute,
  sm.* exclude (chain_id, option_type, band), tp.top_pairs
 from side s left join base b on b.chain_id = s.chain_id and b.option_type = s.option_type left join bands bd on b.ls is not null
 left join sm on sm.chain_id = s.chain_id and sm.option_type = s.option_type and sm.band = bd.band
 left join tp on tp.chain_id = s.chain_id and tp.option_type = s.option_type and tp.band = bd.band"""


@query("C05_stress_report", _REPORT)
def c05_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stress.stress_report(
        stress_chain(spark, sf_dir), stressed(spark, sf_dir), stress_base(spark, sf_dir), key="chain_id", policy=POLICY, trials=TRIALS, max_debit="max_net_debit"
    )
    listed = F.array_join(F.transform("top_pairs", lambda e: F.concat(e["pair"], F.lit(":"), e["count"].cast("string"))), ",")
    text = {"base_expiration": F.col("base_expiration").cast("string"), "top_pairs": listed}
    money = ("max_net_debit", "base_net_delta", "base_net_debit", "base_max_loss")
    return report.withColumns({**text, **{c: F.col(c).cast("double") for c in money}})
