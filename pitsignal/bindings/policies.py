"""Policy replays, challengers, votes and selection corrections on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.bindings.base import CTE_EPISODES, DECISIONS_SQL, UNIVERSE, for_oracle, for_spark, load, query, r
from pitsignal.bindings.episodes import episodes, sessions
from pitsignal.bindings.options import CTE_BEST, POLICY, chain, now
from pitsignal.bindings.research import CTE_WF, wf
from pitsignal.operators import policies as pol
from pitsignal.operators import selection as sel
from pitsignal.operators.resampling import bootstrap_ci
from pitsignal.operators.spreads import best_verticals
from pitsignal.session import cut_lineage

THRESHOLD = 0.05
RIDGE_WINDOW, GATE_WINDOW = 6, 3


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in UNIVERSE])))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("session_date") % 4
    action = F.when(day == 0, "abstain").when(day == 1, "reversion").otherwise("continuation")
    calendar = _calendar(spark, sf_dir)
    return pol.replay_outcomes(
        calendar, episodes(spark, sf_dir).where("lookback = 3"), calendar.withColumn("action", action), threshold=THRESHOLD, horizon="forward_60m_return"
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, sf_dir).where("continuation is not null")


CTE_REPLAY = f"""{CTE_EPISODES}, cal as (select symbol, d, case day(d) % 4 when 0 then 'abstain' when 1 then 'reversion' else 'continuation' end as action from sessions, (select unnest({list(UNIVERSE)}) as symbol)),
us as (select * from ep where lookback = 3 and residual is not null and f60 is not null),
rp0 as (select c.symbol, c.d, c.action, u.residual, u.opening, case when abs(u.residual) >= {THRESHOLD} then sign(u.residual)*u.f60 end as cont from cal c left join us u on u.symbol = c.symbol and u.d = c.d),
rp as (select *, case action when 'continuation' then cont when 'reversion' then -cont end as adj,
  case when residual is null then 'data_abstain' when abs(residual) < {THRESHOLD} then 'threshold_abstain' when action = 'abstain' then 'ai_abstain' else 'signal' end as outcome from rp0),
sig as (select *, row_number() over (partition by symbol order by d) as i from rp where cont is not null)"""


def _record(x: str) -> str:
    return f"""count({x}) as count, count(*) filter (where {x} > 0) as wins, count({x}) - count(*) filter (where {x} > 0) as losses,
 coalesce({r(f'avg(case when {x} > 0 then 1.0 when {x} is not null then 0.0 end)')}, 0) as hit_rate, coalesce({r(f'avg({x})')}, 0) as mean, coalesce({r(f'median({x})')}, 0) as median, coalesce({r(f'sum({x})')}, 0) as total"""


_OUT = """count(*) filter (where outcome = 'signal') as signal, count(*) filter (where outcome = 'threshold_abstain') as threshold_abstain,
 count(*) filter (where outcome = 'data_abstain') as data_abstain, count(*) filter (where outcome = 'ai_abstain') as ai_abstain"""


@query("D01_daily_replay", f"""with {CTE_REPLAY}, o as (select symbol, {_OUT} from rp group by 1), p as (select symbol, 'continuation' as policy, {_record('cont')} from rp group by 1
 union all select symbol, 'adjudicated', {_record('adj')} from rp group by 1) select * from o join p using (symbol)""")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = replay(spark, sf_dir)
    return pol.outcome_counts(table, ["symbol"]).join(pol.policy_records(table, ["symbol"], ["continuation", "adjudicated"]), "symbol")


@query("D02_monthly_split", f"""with {CTE_REPLAY}, q as (select symbol, p.period, date_trunc(p.period, d)::date::varchar as period_start, cont, adj from rp, (values ('month'), ('week')) p(period))
 select symbol, period, period_start, 'continuation' as policy, {_record('cont')} from q group by 1, 2, 3 union all select symbol, period, period_start, 'adjudicated', {_record('adj')} from q group by 1, 2, 3""")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pol.by_period(replay(spark, sf_dir), ("month", "week"))
    return pol.policy_records(table, ["symbol", "period", "period_start"], ["continuation", "adjudicated"])


_DEC = f"dec as ({for_oracle(DECISIONS_SQL)})"


@query("D03_replay_stability", f"""with {_DEC}, c as (select event_id // 3 as context, count(distinct action) as k, count(*) as n from dec group by 1)
 select count(*) as contexts, count(*) filter (where k = 1) as unanimous, count(*) filter (where k > 1) as flipped, sum(n)::bigint as calls from c""")
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = for_spark(spark, sf_dir, DECISIONS_SQL).withColumn("context", F.floor(F.col("event_id") / 3))
    return pol.replay_stability(table, "context")


CTE_CHAL = f"""{CTE_REPLAY}, ew as (select a.symbol, a.i, sum(b.cont*pow(0.5::double, 1.0/3)**(a.i - 1 - b.i)) as s from sig a join sig b on b.symbol = a.symbol and b.i < a.i group by 1, 2 having count(*) >= 3),
rw as (select *, count(residual + opening) over w as n, sum(residual*residual) over w + 1 as aa, sum(opening*opening) over w + 1 as bb, sum(residual*opening) over w as ab,
  sum(residual*sign(residual)*cont) over w as ay, sum(opening*sign(residual)*cont) over w as yb from sig window w as (partition by symbol order by d rows between {RIDGE_WINDOW} preceding and 1 preceding)),
rd as (select symbol, i, case when n = {RIDGE_WINDOW} then ((bb*ay - ab*yb)*residual + (aa*yb - ab*ay)*opening)/(aa*bb - ab*ab) end as pred from rw),
gt as (select symbol, i, case when count(cont) over w = {GATE_WINDOW} then avg(cont) over w end as rm from sig window w as (partition by symbol order by d rows between {GATE_WINDOW} preceding and 1 preceding)),
ch0 as (select s.*, lag(s.cont) over (partition by s.symbol order by s.d) as pc, ew.s as es, rd.pred, gt.rm from sig s left join ew on ew.symbol = s.symbol and ew.i = s.i left join rd on rd.symbol = s.symbol and rd.i = s.i left join gt on gt.symbol = s.symbol and gt.i = s.i),
ch as (select *, case when pc > 0 then cont when pc < 0 then -cont end as prev, case when es > 0 then cont when es < 0 then -cont end as ewma,
  case when sign(residual)*pred > 0 then cont when sign(residual)*pred < 0 then -cont end as ridge,
  case when action = 'reversion' and not coalesce(rm < 0, false) then 'abstain' else action end as gact,
  case when action = 'reversion' and not coalesce(sign(opening) = -sign(residual), false) then 'abstain' else action end as oact from ch0),
cx as (select *, case gact when 'continuation' then cont when 'reversion' then -cont end as gate, case oact when 'continuation' then cont when 'reversion' then -cont end as guard from ch)"""
_KEY = "symbol, d::varchar as session_date"


@query("D04_previous_signal", f"with {CTE_CHAL} select {_KEY}, case when pc > 0 then 'continuation' when pc < 0 then 'reversion' end as choice, {r('prev')} as policy_return from cx")
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pol.previous_signal(signals(spark, sf_dir)).select("symbol", "session_date", F.col("previous_choice").alias("choice"), F.col("previous_signal").alias("policy_return"))


@query("D05_ewma_half_life", f"with {CTE_CHAL} select {_KEY}, {r('es')} as score, {r('ewma')} as policy_return from cx")
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pol.ewma_choice(signals(spark, sf_dir)).select("symbol", "session_date", F.col("ewma_score").alias("score"), F.col("ewma").alias("policy_return"))


@query("D06_rolling_ridge", f"with {CTE_CHAL} select {_KEY}, {r('pred')} as prediction, {r('ridge')} as policy_return from cx")
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pol.ridge_choice(signals(spark, sf_dir), window=RIDGE_WINDOW)
    return table.select("symbol", "session_date", F.col("ridge_prediction").alias("prediction"), F.col("ridge").alias("policy_return"))


@query("D07_regime_gate", f"with {CTE_CHAL} select {_KEY}, {r('rm')} as recent_mean, gact as action, {r('gate')} as policy_return from cx")
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pol.regime_gate(signals(spark, sf_dir), window=GATE_WINDOW)
    return table.select("symbol", "session_date", "recent_mean", F.col("regime_action").alias("action"), F.col("regime_gate").alias("policy_return"))


@query("D08_opening_guard", f"with {CTE_CHAL} select {_KEY}, oact as action, {r('guard')} as policy_return from cx")
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pol.opening_guard(signals(spark, sf_dir))
    return table.select("symbol", "session_date", F.col("guard_action").alias("action"), F.col("opening_guard").alias("policy_return"))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("session_date")
    candidate = F.when(day % 5 == 0, "abstain").when(day % 2 == 0, "reversion").otherwise("continuation")
    table = signals(spark, sf_dir).withColumns({"incumbent_action": F.col("action"), "candidate_action": candidate, "company_news": day % 7 == 0})
    return pol.policy_families(table)


CTE_FAM = f"""{CTE_REPLAY}, fm0 as (select *, case when day(d) % 7 = 0 or day(d) % 5 = 0 then 'abstain' when day(d) % 2 = 0 then 'reversion' else 'continuation' end as cand from sig),
fm as (select symbol, d, i, coalesce(adj, 0) as inc, coalesce(case cand when 'continuation' then cont when 'reversion' then -cont end, 0) as direct,
  coalesce(case when cand = action then case cand when 'continuation' then cont when 'reversion' then -cont end end, 0) as cons from fm0)"""


@query("D09_policy_families", f"with {CTE_FAM} select {_KEY}, {r('inc')} as incumbent, {r('direct')} as direct, {r('cons')} as consensus from fm")
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families(spark, sf_dir).select("symbol", "session_date", "incumbent", "direct", "consensus")


# ---------------------------------------------------------------- votes and screens

def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.col("event_type")
    action = F.when((e % 25 < 17) & (F.floor(e / 25) % 3 == 0), "continuation").when(kind.isin("click", "view"), "continuation").when(kind == "purchase", "reversion").otherwise("abstain")
    return load(spark, sf_dir, "events").select(
        F.floor(e / 25).alias("episode_id"), (F.floor(e / 5) % 5).alias("round"), (e % 5).alias("model"), action.alias("action"), (F.col("value") / 25).alias("latency")
    )


_VOTES = """vt as (select event_id // 25 as episode_id, (event_id // 5) % 5 as round, event_id % 5 as model, value/25 as latency,
 case when event_id % 25 < 17 and (event_id // 25) % 3 = 0 then 'continuation' when event_type in ('click', 'view') then 'continuation' when event_type = 'purchase' then 'reversion' else 'abstain' end as action from events)"""


@query("D10_vote_ensemble", f"""with {_VOTES}, rd as (select episode_id, round, case when count(*) filter (where action = 'continuation') >= 3 then 'continuation' when count(*) filter (where action = 'reversion') >= 3 then 'reversion' else 'abstain' end as a,
 max(latency) as l from vt group by 1, 2), cn as (select episode_id, a, count(*) as n from rd group by 1, 2), tp as (select episode_id, max_by(a, n) filter (where n >= 4) as w from cn group by 1),
 tt as (select episode_id, count(*) as rounds, max(l) as l from rd group by 1) select episode_id, rounds, coalesce(w, 'abstain') as action, w is not null as stable, {r('l')} as latency from tt join tp using (episode_id)""")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pol.ensemble_votes(votes(spark, sf_dir))


@query("D11_action_stability", f"""with {_VOTES}, c as (select episode_id, model, action, count(*) as votes from vt group by all), b as (select *, sum(votes) over (partition by episode_id, model)::bigint as total,
 row_number() over (partition by episode_id, model order by votes desc, action) as rn from c) select episode_id, model, action, votes, total, votes >= 4 as stable from b where rn = 1""")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pol.action_stability(votes(spark, sf_dir), ["episode_id", "model"])


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return load(spark, sf_dir, "events").select(
        (e % 7).alias("model"), (F.floor(e / 7) % 3).alias("context_id"), ((e % 7 > 1) | (e % 5 > 0)).alias("valid"),
        F.when(e % 7 < 4, F.lit("continuation")).otherwise(F.col("event_type")).alias("action"), (F.col("value") / (F.lit(10) + e % 7 * 5)).alias("latency"),
    )


@query("D12_contract_screen", f"""with c as (select event_id % 7 as model, (event_id // 7) % 3 as context_id, event_id % 7 > 1 or event_id % 5 > 0 as valid, case when event_id % 7 < 4 then 'continuation' else event_type end as action,
 value/(10 + event_id % 7*5) as latency from events), x as (select model, context_id, count(distinct action) as k from c group by 1, 2), y as (select model, count(*) as contexts, count(*) filter (where k = 1) as uc from x group by 1),
 z as (select model, count(*) as calls, count(*) filter (where valid) as vc, max(latency) as mx, quantile_cont(latency, 0.95) as p95 from c group by 1)
 select model, calls, vc as valid_calls, contexts, uc as unanimous_contexts, {r('mx')} as latency_max, {r('p95')} as latency_p95, vc = calls and uc = contexts and p95 <= 12 and mx <= 20 as passed from z join y using (model)""")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pol.contract_screen(model_calls(spark, sf_dir))


# ---------------------------------------------------------------- resampling and selection

NAMES = ("previous_signal", "ewma", "ridge", "regime_gate", "opening_guard", "adjudicated")
SAMPLES, SEED, BLOCK, TRIAL_COUNT = 20_000, 7, 3, 25


def challengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies on one row per signal; small, and read by several branches, so it is checkpointed."""
    table = pol.opening_guard(pol.regime_gate(pol.ridge_choice(pol.ewma_choice(pol.previous_signal(signals(spark, sf_dir))), window=RIDGE_WINDOW), window=GATE_WINDOW))
    return cut_lineage(table.select("symbol", "session_date", "continuation", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in NAMES]))


def improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = challengers(spark, sf_dir)
    return table.select("symbol", "session_date", *[(F.col(n) - F.col("continuation")).alias(n) for n in NAMES])


def long_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("continuation", *NAMES)
    entries = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("return")) for n in names])
    return challengers(spark, sf_dir).select("symbol", "session_date", F.explode(entries).alias("_e")).select("symbol", "session_date", "_e.*")


_SQLNAMES = {"previous_signal": "prev", "ewma": "ewma", "ridge": "ridge", "regime_gate": "gate", "opening_guard": "guard", "adjudicated": "adj"}
CTE_IMP = f"""{CTE_CHAL}, im as (select symbol, d, i - 1 as pos, count(*) over (partition by symbol) as n, {', '.join(f'coalesce({s}, 0) - cont as {n}' for n, s in _SQLNAMES.items())} from cx),
lr as (select symbol, d, 'continuation' as policy, cont as ret from cx {' '.join(f"union all select symbol, d, '{n}', coalesce({s}, 0) from cx" for n, s in _SQLNAMES.items())})"""
CTE_BLOCK = f"""{CTE_IMP}, dr as (select p.symbol, s.b, least(('0x' || substr(md5(concat_ws('|', {SEED}, s.b, p.pos // {BLOCK})), 1, 8))::bigint % greatest(p.n - {BLOCK} + 1, 1) + p.pos % {BLOCK}, p.n - 1) as pos from im p, range(1, {SAMPLES + 1}) s(b)),
bm as (select symbol, b, {', '.join(f'avg({n}) as {n}' for n in NAMES)} from dr join im using (symbol, pos) group by 1, 2)"""


@query("D13_block_bootstrap_ci", f"with {CTE_BLOCK} select symbol, {r('quantile_cont(ewma, 0.025)')} as ci_low, {r('quantile_cont(ewma, 0.975)')} as ci_high from bm group by 1")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_ci(improvements(spark, sf_dir), ["symbol"], "ewma", ["session_date"], samples=SAMPLES, seed=SEED, block=BLOCK)


@query("D14_leave_one_period_out", f"""with {CTE_IMP}, w as (select symbol, date_trunc('week', d) as wk, ewma as x from im), t as (select symbol, wk, (select avg(b.x) from w b where b.symbol = a.symbol and b.wk <> a.wk) as m from (select distinct symbol, wk from w) a)
 select symbol, {r('min(m)')} as loo_period_min, count(*) as periods from t group by 1""")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = improvements(spark, sf_dir).withColumn("week", F.date_trunc("week", "session_date"))
    return sel.loo_period_min(table, ["symbol"], "week", "ewma")


@query("D15_half_improvements", f"with {CTE_IMP}, h as (select *, ntile(2) over (partition by symbol order by d) as half from im) select symbol, {r('avg(ewma) filter (where half = 1)')} as first_half, {r('avg(ewma) filter (where half = 2)')} as second_half from h group by 1")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.half_improvements(improvements(spark, sf_dir), ["symbol"], ["session_date"], "ewma")


@query("D16_reality_check", f"""with {CTE_BLOCK}, ob as (select symbol, {', '.join(f'avg({n}) as m_{n}' for n in NAMES)} from im group by 1), ob2 as (select *, greatest({', '.join(f'm_{n}' for n in NAMES)}) as best from ob)
 select symbol, {r('best')} as best_mean_improvement, {r(f"(count(*) filter (where greatest({', '.join(f'{n} - m_{n}' for n in NAMES)}) >= best) + 1)/({SAMPLES} + 1)")} as p_value from bm join ob2 using (symbol) group by symbol, best""")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.reality_check(improvements(spark, sf_dir), ["symbol"], NAMES, ["session_date"], samples=SAMPLES, seed=SEED, block=BLOCK)


@query("D17_overfitting_probability", f"""with {CTE_IMP}, bl as (select symbol, d, ntile(6) over (partition by symbol order by d) - 1 as b from (select distinct symbol, d from lr)),
 sp as (select row_number() over () as split, t from (select [a, b, c] as t from range(6) x(a), range(6) y(b), range(6) z(c) where a < b and b < c)),
 sc as (select l.symbol, split, policy, avg(ret) filter (where list_contains(t, b)) as is_m, avg(ret) filter (where not list_contains(t, b)) as oos from lr l join bl using (symbol, d), sp group by 1, 2, 3),
 rk as (select *, rank() over (partition by symbol, split order by round(oos, 12)) as rk, count(*) over (partition by symbol, split) as n, row_number() over (partition by symbol, split order by round(is_m, 12) desc, policy) as fst from sc),
 lg as (select symbol, split, ln((rk/(n + 1))/(1 - rk/(n + 1))) as lo from rk where fst = 1)
 select symbol, {r('avg(case when lo <= 0 then 1.0 else 0.0 end)')} as pbo, count(*) as splits, {r('median(lo)')} as median_logit from lg group by 1""")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.overfitting_probability(long_returns(spark, sf_dir), ["symbol"], order=["session_date"])


_CDF = "(1/(1 + 0.2316419*abs(z)))"
_TAIL = f"exp(-z*z/2)*0.3989422804014327*{_CDF}*(0.319381530 + {_CDF}*(-0.356563782 + {_CDF}*(1.781477937 + {_CDF}*(-1.821255978 + {_CDF}*1.330274429))))"


@query("D18_deflated_sharpe", f"""with {CTE_IMP}, mo as (select symbol, policy, count(*) as n, avg(ret) as m, stddev_samp(ret) as s, var_pop(ret) as v, avg(ret*ret*ret) - 3*avg(ret)*avg(ret*ret) + 2*avg(ret)**3 as m3,
  avg(ret**4) - 4*avg(ret)*avg(ret**3) + 6*avg(ret)**2*avg(ret*ret) - 3*avg(ret)**4 as m4 from lr group by 1, 2),
 sr as (select *, m/s as sr, m3/v**1.5 as sk, m4/(v*v) - 3 as ex from mo), bn as (select *, stddev_samp(sr) over (partition by symbol)*{sel.expected_max_factor(TRIAL_COUNT)!r} as bar from sr),
 zz as (select *, (sr - bar)*sqrt(n - 1)/sqrt(1 - sk*sr + (ex + 2)/4*sr*sr) as z from bn)
 select symbol, policy, n as count, {r('sr')} as sharpe, {r('bar')} as benchmark, {r(f'case when z >= 0 then 1 - {_TAIL} else {_TAIL} end')} as deflated_probability from zz""")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.deflated_sharpe(long_returns(spark, sf_dir), ["symbol"], trials=TRIAL_COUNT)


def gate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates per part brand from the lineitem table: a large input with a few rules per candidate."""
    lines = load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("candidate")).agg(
        F.avg("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.avg("l_tax").alias("t")
    )
    gates = {"mean_discount": F.col("d") > 0.05, "quantity": F.col("q") >= 50, "tax": F.col("t") < 0.0403}
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in gates.items()])
    return lines.select("candidate", F.explode(rows).alias("_g")).select("candidate", "_g.*")


_GATES = """gt as (select l_suppkey % 40 as candidate, avg(l_discount) > 0.05 as a, max(l_quantity) >= 50 as b, avg(l_tax) < 0.0403 as c from lineitem group by 1)"""


@query("D19_promotion_gates", f"with {_GATES} select candidate, a and b and c as promoted, concat_ws(',', case when not a then 'mean_discount' end, case when not b then 'quantity' end, case when not c then 'tax' end) as failed_gates from gt")
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.promotion_gates(gate_table(spark, sf_dir), ["candidate"])


@query("D19_released_holdout", f"with {_GATES} select s_suppkey, s_suppkey % 40 as candidate from supplier where s_suppkey % 40 in (select candidate from gt where a and b and c)")
def d19_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    holdout = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).alias("candidate"))
    return sel.released_holdout(holdout, sel.promotion_gates(gate_table(spark, sf_dir), ["candidate"]), ["candidate"])


# ---------------------------------------------------------------- prints, fills, runs

@query("D20_print_coverage", f"""with {CTE_BEST}, lg as (select option_type, unnest([concat(ls, '/', 1 + ls::bigint % 12), concat(ss, '/', 1 + ss::bigint % 12)]) as symbol, abs(sk - lk) as w, net from best), pr as (select distinct concat(l_partkey, '/', month(l_shipdate)) as symbol from lineitem)
 select case option_type when 'call' then 'bullish' else 'bearish' end as direction, count(*) as legs, {r('avg(case when pr.symbol is not null then 1.0 else 0.0 end)')} as coverage, {r('avg(w::double)')} as mean_width, {r('avg(net::double)')} as mean_net_delta
 from lg left join pr using (symbol) group by 1""")
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_verticals(chain(spark, sf_dir), ["chain_id"], POLICY, now())
    legs = best.select(
        "direction", F.explode(F.array(_in_month("long_symbol"), _in_month("short_symbol"))).alias("symbol"),
        F.abs(F.col("short_strike") - F.col("long_strike")).cast("double").alias("width"), F.col("net_delta").cast("double").alias("net_delta"),
    )
    prints = load(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_partkey", F.month("l_shipdate")).alias("symbol"))
    return pol.print_coverage(legs, prints, ["direction"])


def _in_month(symbol: str):
    """A leg's symbol with the month it was held in; prints count in that month only."""
    return F.concat_ws("/", symbol, 1 + F.col(symbol).cast("long") % 12)


@query("D21_activity_gate", f"""with am as (select user_id as leg, count(distinct date_trunc('minute', ts)) as m from events where ts between timestamp '2024-01-10 09:10:00' and timestamp '2024-01-12 09:40:00' group by 1),
 td as (select o_custkey % 150 as a, (o_custkey*7) % 150 as b, o_totalprice/1000 - 240 as pnl from orders), j as (select pnl, least(coalesce(x.m, 0), coalesce(y.m, 0)) as low, unnest([0, 3, 5, 7]) as minimum from td left join am x on x.leg = a left join am y on y.leg = b)
 select minimum, count(*) filter (where low >= minimum) as kept, round(sum(pnl) filter (where low >= minimum), 4) + 0.0 as pnl, {r('avg(case when pnl > 0 then 1.0 else 0.0 end) filter (where low >= minimum)')} as hit_rate from j group by 1""")
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda t: F.lit(t).cast("timestamp")
    prints = load(spark, sf_dir, "events").select(F.col("user_id").alias("leg"), F.col("ts").cast("timestamp").alias("ts"))
    activity = pol.active_minutes(prints, start=stamp("2024-01-10 09:10:00"), end=stamp("2024-01-12 09:40:00"))
    trades = load(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 150).alias("long_leg"), (F.col("o_custkey") * 7 % 150).alias("short_leg"), (F.col("o_totalprice") / 1000 - 240).alias("pnl")
    )
    return pol.activity_gate(trades, activity, (0, 3, 5, 7)).withColumn("pnl", F.round("pnl", 4))


@query("D22_realized_spread_pnl", f"""with f as (select l_orderkey as spread_id, sum(l_quantity*(case when l_linenumber in (1, 5) then 1 when l_linenumber in (2, 6) then -1 end)) as debit, sum(l_quantity*(case when l_linenumber in (3, 7) then 1 when l_linenumber = 4 then -1 end)) as credit,
 max(case when l_linenumber in (1, 2, 5, 6) then l_extendedprice/1000 end) as ol, max(case when l_linenumber in (3, 4, 7) then l_extendedprice/1000 end) as cl from lineitem group by 1)
 select spread_id, {r('debit')} as debit, {r('credit')} as credit, {r('(credit - debit)*100')} as pnl, {r('(ol - debit + credit - cl)*100')} as price_improvement from f""")
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    fills = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("spread_id"), F.when(n.isin(1, 2, 5, 6), "open").otherwise("close").alias("phase"), F.when(n % 2 == 1, "long").otherwise("short").alias("leg"),
        F.col("l_quantity").alias("fill_price"), (F.col("l_extendedprice") / 1000).alias("limit_price"),
    )
    return pol.realized_pnl(fills, ["spread_id"])


@query("D23_modal_configuration", f"""with {CTE_WF}, c as (select symbol, lookback, norm, thr, hor, count(*) as votes from sel where thesis = 'reversion' group by all), b as (select *, sum(votes) over (partition by symbol)::bigint as total,
 row_number() over (partition by symbol order by votes desc, lookback, norm, thr, hor) as rn from c) select symbol, lookback, norm as normalization, thr as threshold, hor as horizon, votes, total from b where rn = 1""")
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pol.frozen_config(wf(spark, sf_dir).results, year=2024, thesis="reversion")


@query("D24_replication_diff", """with s as (select user_id as episode_id, event_id % 2 as run, event_type as action, count(*) as n from events group by all),
 b as (select episode_id, run, max_by(action, row(n, -ascii(action), -ascii(substr(action, 2)))) as action, max(n) >= 4 as stable from s group by 1, 2)
 select coalesce(f.episode_id, g.episode_id) as episode_id, f.action as first_action, f.stable as first_stable, g.action as second_action, g.stable as second_stable
 from (select * from b where run = 0) f full join (select * from b where run = 1) g on g.episode_id = f.episode_id where f.action is distinct from g.action or f.stable is distinct from g.stable""")
def d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), (F.col("event_id") % 2).alias("run"), F.col("event_type").alias("action"))
    side = lambda n: pol.action_stability(runs.where(F.col("run") == n), ["episode_id"])
    return pol.replication_diff(side(0), side(1), "episode_id")


@query("D25_usage_by_run", f"""select conv_id % 10 as run_id, count(*) as calls, sum(case when role <> 'assistant' then length(text) else 0 end)::bigint as input_units, sum(case when role = 'assistant' then length(text) else 0 end)::bigint as output_units,
 {r('(sum(length(text))*0.000002)::double')} as cost from conversations group by 1""")
def d25(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, answer = F.char_length("text"), F.col("role") == "assistant"
    calls = load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 10).alias("run_id"), F.when(~answer, size).otherwise(0).alias("input_units"), F.when(answer, size).otherwise(0).alias("output_units"), (size * 0.000002).alias("cost")
    )
    return pol.usage_by_run(calls, ["run_id"])
