"""Metrics, walk-forward evaluation and frozen-signal studies on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.bindings.base import (
    BARS_SQL, CONTROL, CTE_BARS, CTE_EPISODES, HORIZONS, LOOKBACKS, PRIMARY, SECOND, for_spark, load, query, r,
)
from pitsignal.bindings.episodes import episodes
from pitsignal.functions.numeric import bps, finite, gated, signed_return, zscore
from pitsignal.operators.metrics import ols_slope, summarize, summarize_large
from pitsignal.operators.resampling import bootstrap_ci
from pitsignal.plans import research as research_plan
from pitsignal.plans import studies, walkforward
from pitsignal.plans.walkforward import CHECKS, WalkForwardConfig
from pitsignal.schemas import missing_columns
from pitsignal.session import cut_lineage, scratch_path

CONFIG = WalkForwardConfig(min_train=6, test_size=3, min_total_signals=4, beta_lookbacks=LOOKBACKS)


# ---------------------------------------------------------------- metrics

def bar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = for_spark(spark, sf_dir, BARS_SQL)
    return slots.select("symbol", "bar_date", "slot", (F.col("close") / F.col("open") - 1).alias("bar_return"))


CTE_RET = f"{CTE_BARS}, ret as (select symbol, bar_date, slot, close/open - 1 as x from bars)"
_SUMMARY = f"""count(x) as count, {r('avg(x)')} as mean, {r('median(x)')} as median, {r('avg(case when x > 0 then 1.0 else 0.0 end)')} as hit_rate,
 {r('stddev_samp(x)/sqrt(count(x))')} as standard_error, {r('sum(x)')} as total, {r('min(x)')} as worst, {r('max(x)')} as best"""


@query("A01_return_summary", f"""with {CTE_RET} select symbol, {_SUMMARY}, {r('greatest(max(x) - avg(x), avg(x) - min(x))/(count(x) - 1)')} as loo_max_mean_impact
 from ret group by symbol""")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_large(bar_returns(spark, sf_dir), ["symbol"], "bar_return")


@query("A02_leave_one_out_impact", f"""with {CTE_EPISODES}, s as (select symbol, residual as x from ep where lookback = 5 and residual is not null),
 t as (select symbol, sum(x) as total, count(*) as n from s group by symbol)
 select symbol, {r('max(abs(t.total/t.n - (t.total - s.x)/(t.n - 1)))')} as loo_max_mean_impact from s join t using (symbol) group by symbol""")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = episodes(spark, sf_dir).where("lookback = 5")
    return summarize(sample, ["symbol"], "residual").select("symbol", "loo_max_mean_impact")


@query("A04_ols_slope", f"""with {CTE_EPISODES} select symbol, count(*) as pair_count, {r('regr_slope(y, x)')} as slope from ep where lookback = 3 group by symbol""")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols_slope(episodes(spark, sf_dir).where("lookback = 3"), ["symbol"], "driver_return", "premarket_return")


@query("F08_finite_mask", """select event_type as symbol, count(case when value >= 30 then 1/(value - 10) end) as finite_count, count(*) as row_count
 from events group by 1""")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    odd = F.when(v < 10, F.lit(float("nan"))).when(v < 20, F.lit(float("inf"))).when(v < 30, F.lit(float("-inf"))).otherwise(1 / (v - 10))
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(
        F.count(finite(odd)).alias("finite_count"), F.count(F.lit(1)).alias("row_count")
    )


@query("F09_sign", f"with {CTE_RET} select symbol, sum(sign(x))::double as sign_sum, count(*) filter (where x = 0) as zero_count from ret group by symbol")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.signum("bar_return")
    return bar_returns(spark, sf_dir).groupBy("symbol").agg(F.sum(sign).alias("sign_sum"), F.count(F.when(sign == 0, 1)).alias("zero_count"))


@query("F12_basis_points", f"with {CTE_RET} select symbol, round(avg(x)*10000, 2) + 0.0 as mean_bps from ret group by symbol")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_returns(spark, sf_dir).groupBy("symbol").agg(bps(F.avg("bar_return")).alias("mean_bps"))


# ---------------------------------------------------------------- scoring predicates

@query("P08_signed_return", f"""with {CTE_EPISODES} select symbol, lookback, cast(d as varchar) as session_date,
 {r('sign(residual)*f60')} as continuation, {r('-sign(residual)*f60')} as reversion from ep""")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, forward = F.col("residual"), F.col("forward_60m_return")
    return episodes(spark, sf_dir).select(
        "symbol", "lookback", "session_date",
        signed_return(score, forward).alias("continuation"), (signed_return(score, forward, "reversion") + 0.0).alias("reversion"),
    )


_SPLIT = "2024-01-16"


@query("P09_train_only_zscore", f"""with {CTE_EPISODES}, s as (select symbol, lookback, avg(residual) as m, stddev_samp(residual) as s from ep
  where d < date '{_SPLIT}' group by 1, 2)
 select symbol, lookback, cast(d as varchar) as session_date, case when s.s > 2.220446049250313e-16 then {r('(residual - s.m)/s.s')} end as score
 from ep join s using (symbol, lookback) where d >= date '{_SPLIT}'""")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = episodes(spark, sf_dir)
    early = F.col("session_date") < F.lit(_SPLIT).cast("date")
    train = frame.where(early).groupBy("symbol", "lookback").agg(F.avg("residual").alias("m"), F.stddev_samp("residual").alias("s"))
    return frame.where(~early).join(train, ["symbol", "lookback"]).select(
        "symbol", "lookback", "session_date", zscore(F.col("residual"), F.col("m"), F.col("s")).alias("score")
    )


@query("P10_threshold_gate", f"""with {CTE_EPISODES} select symbol, lookback, cast(d as varchar) as session_date,
 case when abs(residual) >= 0.01*50 then {r('sign(residual)*f30')} end as signed_return from ep""")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("residual")
    level = F.lit(CONFIG.level("raw", 50.0))
    return episodes(spark, sf_dir).select(
        "symbol", "lookback", "session_date", gated(score, level, F.signum(score) * F.col("forward_30m_return")).alias("signed_return")
    )


@query("P11_full_history_filter", f"with {CTE_EPISODES} select symbol, cast(d as varchar) as session_date, tc as training_count from ep where lookback = 8 and tc >= 8")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).where("lookback = 8 and training_count >= 8").select("symbol", "session_date", "training_count")


_NOTNULL = " and ".join(f"f{m} is not null" for m in HORIZONS)


@query("P12_complete_cases", f"with {CTE_EPISODES} select symbol, lookback, count(*) as complete_rows from ep where residual is not null and {_NOTNULL} group by 1, 2")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = studies.complete_cases(episodes(spark, sf_dir), ["residual", *[f"forward_{m}m_return" for m in HORIZONS]], 0)
    return rows.groupBy("symbol", "lookback").agg(F.count(F.lit(1)).alias("complete_rows"))


@query("P13_schema_guard", "select event_type as symbol, count(*) as row_count, 'forward_60m_return,residual' as missing from events group by 1")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumnRenamed("event_type", "symbol")
    absent = ",".join(missing_columns(events, ["symbol", "ts", "residual", "forward_60m_return"]))
    return events.groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count")).withColumn("missing", F.lit(absent))


# ---------------------------------------------------------------- walk-forward

def wf(spark: SparkSession, sf_dir: str) -> walkforward.WalkForward:
    return walkforward.walk_forward(episodes(spark, sf_dir), CONFIG)


CTE_COMMON = f"""{CTE_EPISODES}, clean as (select symbol, lookback, d, residual, f30, f60 from ep where residual is not null and f30 is not null and f60 is not null),
common as (select symbol, d, row_number() over (partition by symbol order by d) as rk from
  (select symbol, d from clean group by 1, 2 having count(distinct lookback) = {len(LOOKBACKS)}))"""
CTE_FOLDS = f"""{CTE_COMMON}, folds as (select symbol, k as fold_id, {CONFIG.min_train} + {CONFIG.test_size}*k as te from
  (select symbol, count(*) as n from common group by 1), range(0, 100) t(k) where {CONFIG.min_train} + {CONFIG.test_size}*(k + 1) <= n)"""
CTE_WF = f"""{CTE_FOLDS}, fr as (select c.*, m.rk, f.fold_id, f.te from clean c join common m using (symbol, d) join folds f using (symbol)
  where m.rk <= f.te + {CONFIG.test_size}),
st as (select symbol, fold_id, lookback, avg(residual) as m, stddev_samp(residual) as s from fr where rk <= te group by 1, 2, 3),
grid as (select lookback, thesis, norm, case when norm = 'raw' then t/100.0 else t end as thr, hor,
   lookback*1000 + ti*500 + ni*100 + xi*10 + hi as idx from (select unnest([3, 5, 8]) as lookback),
   (select unnest(['continuation', 'reversion']) as thesis, unnest([0, 1]) as ti), (select unnest(['raw', 'zscore']) as norm, unnest([0, 1]) as ni),
   (select unnest([0.5::double, 1.0::double, 1.5::double]) as t, unnest([0, 1, 2]) as xi),
   (select unnest(['forward_30m_return', 'forward_60m_return']) as hor, unnest([0, 1]) as hi)),
sc as (select fr.symbol, fr.fold_id, fr.d, fr.rk, fr.te, g.*, case when norm = 'raw' then residual when st.s > 2.220446049250313e-16 then (residual - st.m)/st.s end as score,
   case when hor = 'forward_30m_return' then f30 else f60 end as fwd from fr join st using (symbol, fold_id, lookback) join grid g using (lookback)),
sg as (select *, case when abs(score) >= thr then sign(score)*fwd*(case when thesis = 'reversion' then -1 else 1 end) end as x from sc),
cand as (select symbol, fold_id, lookback, thesis, norm, thr, hor, idx, count(x) as n, avg(x) as a, median(x) as md from sg where rk <= te
   group by all),
best as (select * from (select *, row_number() over (partition by symbol, fold_id order by round(md, 12) desc, round(a, 12) desc, n desc, idx) as rn
   from cand where n >= 2) where rn = 1),
sel as (select f.symbol, f.fold_id, f.te, coalesce(b.lookback, 3) as lookback, coalesce(thesis, 'reversion') as thesis, coalesce(norm, 'raw') as norm,
   coalesce(thr, 0.005) as thr, coalesce(hor, 'forward_30m_return') as hor from folds f left join best b using (symbol, fold_id)),
oos as (select sg.symbol, sg.fold_id, sg.d, sg.x from sg join sel using (symbol, fold_id, lookback, thesis, norm, thr, hor) where sg.rk > sg.te and sg.x is not null),
fstat as (select symbol, fold_id, count(*) as n, avg(x) as mean, median(x) as med, avg(case when x > 0 then 1.0 else 0.0 end) as hit from oos group by 1, 2),
fres as (select s.*, coalesce(n, 0) as n, coalesce(mean, 0) as mean, coalesce(med, 0) as med, coalesce(hit, 0) as hit from sel s left join fstat using (symbol, fold_id)),
pool as (select y.symbol, count(x) as n, coalesce(avg(x), 0) as mean, coalesce(median(x), 0) as med, coalesce(avg(case when x > 0 then 1.0 when x is not null then 0.0 end), 0) as hit,
   case when count(x) > 1 then greatest(max(x) - avg(x), avg(x) - min(x))/(count(x) - 1) when count(x) = 1 then abs(avg(x)) else 0 end as loo
   from (select distinct symbol from ep) y left join oos using (symbol) group by 1)"""


@query("W05_expanding_folds", f"""with {CTE_FOLDS} select f.symbol, f.fold_id, cast(min(c.d) filter (where rk <= te) as varchar) as train_start,
 cast(max(c.d) filter (where rk <= te) as varchar) as train_end, cast(min(c.d) filter (where rk > te) as varchar) as test_start,
 cast(max(c.d) filter (where rk > te) as varchar) as test_end from folds f join common c on c.symbol = f.symbol and c.rk <= f.te + {CONFIG.test_size} group by 1, 2""")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wf(spark, sf_dir).folds.drop("train_end_rank", "test_end_rank")


@query("J08_fold_membership", f"""with {CTE_FOLDS} select f.symbol, f.fold_id, c.lookback, count(*) filter (where rk <= te) as train_rows, count(*) filter (where rk > te) as test_rows
 from folds f join common m on m.symbol = f.symbol and m.rk <= f.te + {CONFIG.test_size} join clean c on c.symbol = m.symbol and c.d = m.d group by 1, 2, 3""")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = walkforward.clean_frames(episodes(spark, sf_dir), CONFIG)
    common = walkforward.common_sessions(clean)
    folds = walkforward.expanding_folds(common, min_train=CONFIG.min_train, test_size=CONFIG.test_size)
    rows = walkforward.fold_rows(clean, common, folds)
    return rows.groupBy("symbol", "fold_id", "lookback").agg(
        F.count(F.when(F.col("is_train"), 1)).alias("train_rows"), F.count(F.when(~F.col("is_train"), 1)).alias("test_rows")
    )


@query("J09_common_sessions", f"with {CTE_COMMON} select symbol, cast(d as varchar) as session_date, rk as session_rank from common")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.common_sessions(walkforward.clean_frames(episodes(spark, sf_dir), CONFIG))


@query("J10_candidate_grid", f"""with {CTE_WF} select symbol, fold_id, lookback, thesis, norm as normalization, thr as threshold, hor as horizon, n as train_count,
 {r('a')} as train_mean, {r('md')} as train_median from cand""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wf(spark, sf_dir).candidates.drop("grid_order")


_SELECTED = "lookback, thesis, norm as normalization, thr as threshold, hor as horizon"


@query("A06_config_selection", f"with {CTE_WF} select symbol, fold_id, {_SELECTED} from sel")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wf(spark, sf_dir).selected


@query("U01_out_of_sample_returns", f"with {CTE_WF} select symbol, fold_id, cast(d as varchar) as session_date, {r('x')} as signed_return from oos")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wf(spark, sf_dir).signals


_FRES = f"{_SELECTED}, n as signal_count, {r('mean')} as mean, {r('med')} as median, {r('hit')} as hit_rate"


@query("A05_fold_summary", f"with {CTE_WF} select symbol, fold_id, {_FRES} from fres")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wf(spark, sf_dir).results.drop("train_start", "train_end", "test_start", "test_end")


@query("A07_pooled_out_of_sample", f"""with {CTE_WF} select symbol, n as count, {r('mean')} as mean, {r('med')} as median, {r('hit')} as hit_rate,
 {r('loo')} as loo_max_mean_impact from pool""")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = cut_lineage(episodes(spark, sf_dir))
    signals = walkforward.walk_forward(frames, CONFIG, cut=False).signals
    return walkforward.pooled_summary(frames, signals).select("symbol", "count", "mean", "median", "hit_rate", "loo_max_mean_impact")


def cte_checks(floor: str = str(CONFIG.min_total_signals)) -> str:
    return f"""{CTE_WF}, pf as (select symbol, count(*) filter (where mean > 0) as pos, count(*) as fold_count from fres group by 1),
ck as (select p.symbol, p.n, p.mean, p.loo, c.mean as cm, coalesce(fold_count, 0) as fold_count, coalesce(pos, 0) >= 2 as c1, p.n >= {floor} as c2, p.mean > 0 as c3, p.mean > 0.01 as c4,
  p.n > 1 and p.loo <= greatest(abs(p.mean), 0.001) as c5, (p.mean <= 0 or c.mean < p.mean*0.75) as c6
  from pool p left join pf using (symbol) join (select mean from pool where symbol = '{CONTROL}') c on true where p.symbol <> '{CONTROL}'),
vd as (select *, case when not c6 then 'KILL' when c1 and c2 and c3 and c4 and c5 then 'GO' when c1 and c3 then 'MUTATE' else 'KILL' end as verdict from ck)"""


_CHECK_COLS = ", ".join(f"c{i + 1} as {name}" for i, name in enumerate(CHECKS))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.evaluate(episodes(spark, sf_dir), CONFIG, control=CONTROL)[1]


@query("A10_promotion_checks", f"""with {cte_checks()} select symbol, n as total_signals, {r('mean')} as mean_test_return, {r('cm')} as control_mean,
 {r('loo')} as loo_max_mean_impact, fold_count, {_CHECK_COLS} from ck""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).drop("checks", "verdict")


@query("J11_control_comparison", f"with {cte_checks()} select symbol, {r('mean')} as mean_test_return, {r('cm')} as control_mean, c6 as control_not_equally_strong from ck")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("symbol", "mean_test_return", "control_mean", "control_not_equally_strong")


@query("A11_symbol_verdict", f"with {cte_checks()} select symbol, verdict from vd")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("symbol", "verdict")


_MAP = "concat_ws(',', " + ", ".join(f"concat('{name}=', c{CHECKS.index(name) + 1}::varchar)" for name in sorted(CHECKS)) + ")"


@query("C02_walk_forward_verdict", f"""with {cte_checks()} select symbol, n as total_signals, {r('mean')} as mean_test_return, {r('cm')} as control_mean, fold_count,
 {_MAP} as checks, verdict, '{CONFIG.config_hash()}' as config_hash from vd""")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = judged(spark, sf_dir).withColumn("config_hash", F.lit(CONFIG.config_hash()))
    return table.select("symbol", "total_signals", "mean_test_return", "control_mean", "fold_count", "checks", "verdict", "config_hash")


# ---------------------------------------------------------------- research run

_FLOOR = "greatest(8, round_even(0.10*(select min(v) from cover), 0)::int)"
CTE_COVER = ", cover as (select symbol, lookback, count(residual) as v from ep group by 1, 2)"
CTE_RUN = cte_checks(_FLOOR).replace(", pf as", CTE_COVER + ", pf as", 1)


def run(spark: SparkSession, sf_dir: str) -> research_plan.ResearchRun:
    return research_plan.research(episodes(spark, sf_dir), CONFIG, required=(PRIMARY, SECOND), control=CONTROL)


@query("A08_coverage", f"with {CTE_EPISODES} {CTE_COVER} select symbol, lookback, v as valid_sessions from cover")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research_plan.coverage(episodes(spark, sf_dir))


@query("A09_signal_floor", f"""with {CTE_EPISODES} {CTE_COVER} select min(v) as valid_capacity, 9 as required_sessions, min(v) >= 9 as enough_history, {_FLOOR} as min_total_signals,
 concat('max(8, round(10% of ', min(v), ' valid sessions))') as rationale from cover""")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research_plan.capacity(research_plan.coverage(episodes(spark, sf_dir)), CONFIG)


@query("S10_insufficient_history", f"""with {CTE_EPISODES} {CTE_COVER} select 'MUTATE' as verdict, 'insufficient_history' as reason, 80 as required_sessions, min(v) as valid_capacity
 from cover having min(v) < 80""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = WalkForwardConfig()
    return research_plan.insufficient_history(research_plan.capacity(research_plan.coverage(episodes(spark, sf_dir)), default))


ABSENT = "absent"


@query("S10_missing_symbol", f"""with {CTE_EPISODES} {CTE_COVER}, want as (select s as symbol, n as lookback from (values ('{PRIMARY}'), ('{ABSENT}')) a(s), (values {', '.join(f'({n})' for n in LOOKBACKS)}) b(n)),
 full_cover as (select w.symbol, w.lookback, coalesce(c.v, 0) as v from want w left join cover c using (symbol, lookback))
 select symbol, lookback, v as valid_sessions, (select min(v) from full_cover) as valid_capacity, 'MUTATE' as verdict, 'insufficient_history' as reason from full_cover""")
def s10_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required symbol without any episode has coverage zero and stops the run."""
    cover = research_plan.coverage(episodes(spark, sf_dir), [PRIMARY, ABSENT], LOOKBACKS)
    stop = research_plan.insufficient_history(research_plan.capacity(cover, CONFIG))
    return cover.select("symbol", "lookback", "valid_sessions", *[stop.select(c).scalar().alias(c) for c in ("valid_capacity", "verdict", "reason")])


@query("A12_overall_verdict", f"""with {cte_checks()} select case when bool_and(verdict = 'GO') then 'GO' when bool_and(verdict = 'KILL') then 'KILL' else 'MUTATE' end as overall_verdict from vd""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.overall_verdict(judged(spark, sf_dir), (PRIMARY, SECOND))


_HASH_A, _HASH_B = CONFIG.canonical_json("\0").split("\0")
_HASH = f"substr(sha256(concat('{_HASH_A}', {_FLOOR}, '{_HASH_B}')), 1, 16)"


@query("C09_research_run", f"""with {CTE_RUN} select symbol, n as total_signals, {r('mean')} as mean_test_return, {r('cm')} as control_mean, {_FLOOR} as min_total_signals, verdict,
 {_HASH} as config_hash, (select case when bool_and(verdict = 'GO') then 'GO' when bool_and(verdict = 'KILL') then 'KILL' else 'MUTATE' end from vd) as overall_verdict from vd""")
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = run(spark, sf_dir)
    return done.verdicts.select(
        "symbol", "total_signals", "mean_test_return", "control_mean", "min_total_signals", "verdict", "config_hash",
        done.overall.scalar().alias("overall_verdict"),
    )


@query("A26_research_digest", f"""with {CTE_RUN} select symbol, case when symbol = '{PRIMARY}' then 'live_candidate' else 'negative_evidence_only' end as role, verdict, n as total_signals,
 round(mean*10000, 2) + 0.0 as mean_test_return_bps, {_HASH} as config_hash from vd""")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research_plan.research_digest(run(spark, sf_dir).verdicts, primary=PRIMARY)


_CK_LINES = " union all ".join(f"select symbol, {10 + i} as line_no, concat('[', case when c{i + 1} then 'x' else ' ' end, '] {name}') as line from vd" for i, name in enumerate(CHECKS))


@query("S09_research_report", f"""with {CTE_RUN}, dates as (select f.symbol, f.fold_id, min(c.d) as t0, max(c.d) as t1 from folds f join common c
  on c.symbol = f.symbol and c.rk > f.te and c.rk <= f.te + {CONFIG.test_size} group by 1, 2)
 select symbol, 0 as line_no, concat('verdict: ', verdict) as line from vd union all select symbol, 1, concat('test signals: ', n) from vd
 union all select symbol, 2, printf('mean signed test return: %.6f', mean) from vd union all {_CK_LINES}
 union all select symbol, fold_id + 100, printf('%s to %s: n=%d, mean=%.6f, median=%.6f, hit=%.2f%%, %s/%s/%s/%s', t0::varchar, t1::varchar, n, mean::double, med::double, (hit*100)::double, thesis, norm, thr::varchar, hor)
 from fres join dates using (symbol, fold_id) where symbol <> '{CONTROL}'""")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = run(spark, sf_dir)
    return research_plan.report_lines(done.verdicts, done.evaluation.results)


# ---------------------------------------------------------------- studies

HORIZON = studies.HorizonStudy(min_training=8, samples=10_000)
CTE_H = f"""{CTE_EPISODES}, hs as (select symbol, d, residual, m as minutes, sign(residual)*f as signed, sign(residual)*f60 as base from (
  select *, unnest([{', '.join(map(str, HORIZONS))}]) as m, unnest([{', '.join(f'f{m}' for m in HORIZONS)}]) as f from ep
  where lookback = 8 and tc >= 8 and residual is not null and abs(residual) >= 0.01 and {_NOTNULL})),
hp as (select *, row_number() over (partition by symbol, minutes order by d) - 1 as pos, count(*) over (partition by symbol, minutes) as n from hs),
draw as (select p.symbol, p.minutes, s.b, least(('0x' || substr(md5(concat_ws('|', p.minutes + {HORIZON.seed}, s.b, p.pos)), 1, 8))::bigint % p.n, p.n - 1) as pos
  from hp p, range(1, {HORIZON.samples + 1}) s(b)),
bm as (select d.symbol, d.minutes, d.b, avg(p.signed - p.base) as m from draw d join hp p using (symbol, minutes, pos) group by 1, 2, 3),
ci as (select symbol, minutes, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from bm group by 1, 2),
yr as (select symbol, minutes, bool_and(ok) as yearly from (select symbol, minutes, year(d) as y, avg(signed) >= avg(base) - 1e-12 as ok from hs group by 1, 2, 3) group by 1, 2),
hst as (select symbol, minutes, count(*) as n, avg(signed) as mean, median(signed) as med, avg(case when signed > 0 then 1.0 else 0.0 end) as hit, avg(signed - base) as gain,
  case when count(*) > 1 then (sum(signed - base) - max(signed - base))/(count(*) - 1) else sum(signed - base) end as loo,
  median(signed) >= median(base) - 1e-12 as med_ok, avg(case when signed > 0 then 1.0 else 0.0 end) >= avg(case when base > 0 then 1.0 else 0.0 end) - 1e-12 as hit_ok from hs group by 1, 2),
ht as (select *, minutes <> 60 and n >= 5 and gain > 0 and lo > 0 and loo > 0 and med_ok and hit_ok and yearly as eligible from hst join ci using (symbol, minutes) join yr using (symbol, minutes))"""


def study_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).where("lookback = 8")


@query("J12_paired_horizon", f"with {CTE_H} select symbol, cast(d as varchar) as session_date, minutes, {r('signed')} as signed, {r('base')} as base_signed, {r('signed - base')} as improvement from hs")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.horizon_sample(study_frame(spark, sf_dir), HORIZON)


@query("A03_loo_paired_improvement", f"with {CTE_H} select symbol, minutes, {r('loo')} as loo_min_improvement from hst")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.horizon_study(study_frame(spark, sf_dir), HORIZON).select("symbol", "minutes", "loo_min_improvement")


@query("A13_paired_bootstrap_ci", f"with {CTE_H} select symbol, minutes, {r('lo')} as ci_low, {r('hi')} as ci_high from ci")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = studies.horizon_sample(study_frame(spark, sf_dir), HORIZON)
    return bootstrap_ci(
        sample, ["symbol", "minutes"], "improvement", ["session_date"], samples=HORIZON.samples, seed=F.col("minutes") + F.lit(HORIZON.seed)
    )


_HT = f"""symbol, minutes, n as count, {r('mean')} as mean_signed_return, {r('med')} as median_signed_return, {r('hit')} as hit_rate, {r('gain')} as paired_mean_improvement,
 {r('loo')} as loo_min_improvement, {r('lo')} as ci_low, {r('hi')} as ci_high, yearly as yearly_not_worse, med_ok as median_not_worse, hit_ok as hit_rate_not_worse, eligible"""


@query("A14_horizon_study", f"with {CTE_H} select {_HT} from ht")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.horizon_study(study_frame(spark, sf_dir), HORIZON)


@query("A15_yearly_not_worse", f"with {CTE_H} select symbol, minutes, yearly as yearly_not_worse from yr")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.yearly_not_worse(studies.horizon_sample(study_frame(spark, sf_dir), HORIZON))


_REC = """select symbol, coalesce(max_by(minutes, row(gain, -abs(minutes - 60), -minutes)) filter (where eligible), 60) as recommended_minutes,
 coalesce(max_by(minutes, row(gain, -abs(minutes - 60), -minutes)) filter (where eligible), 60) <> 60 as promoted, max(n) as episode_count from ht group by 1"""


@query("A16_recommended_horizon", f"with {CTE_H} {_REC}")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.recommended_horizon(studies.horizon_study(study_frame(spark, sf_dir), HORIZON))


@query("C03_exit_horizon_study", f"with {CTE_H}, rec as ({_REC}) select {_HT}, recommended_minutes, promoted, episode_count from ht join rec using (symbol)")
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = studies.horizon_study(study_frame(spark, sf_dir), HORIZON)
    return table.join(studies.recommended_horizon(table), "symbol")


@query("C03_study_header", f"""with {CTE_H}, rec as ({_REC}), span as (select symbol, min(d)::date::varchar as sample_start, max(d)::date::varchar as sample_end from hs where minutes = {HORIZON.baseline} group by 1)
 select symbol, 'frozen' as policy, {HORIZON.threshold}::double as threshold, {HORIZON.min_training} as minimum_training_count, {HORIZON.baseline} as baseline_minutes,
  '{",".join(map(str, HORIZON.minutes))}' as tested_minutes, sample_start, sample_end, recommended_minutes, promoted, episode_count from span join rec using (symbol)""")
def c03_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = study_frame(spark, sf_dir)
    header = studies.study_header(frame, studies.horizon_study(frame, HORIZON), HORIZON)
    return header.withColumn("tested_minutes", F.array_join(F.col("tested_minutes").cast("array<string>"), ","))


BOUNDARY = studies.BoundaryStudy(thresholds=(0.2, 0.4, 0.5, 0.6, 0.8, 9.0), baseline=0.5, lower=0.4, upper=0.6, min_training=8, min_signals=5)
_THRESHOLDS = ", ".join(f"{t}::double" for t in BOUNDARY.thresholds)


def _masked(cond: str) -> str:
    r12 = lambda e: f"(round(round({e}, 12), 9) + 0.0)"
    x = f"(case when {cond} then signed end)"
    return (
        f"count({x}) as count, {r12(f'avg({x})')} as mean_signed_return, {r12(f'median({x})')} as median_signed_return, "
        f"{r12(f'avg(case when {x} > 0 then 1.0 when {x} is not null then 0.0 end)')} as hit_rate"
    )


CTE_B = f"""{CTE_EPISODES}, bs as (select symbol, d, abs(residual) as mag, sign(residual)*f60 as signed from ep where lookback = 8 and tc >= 8 and residual is not null and f60 is not null),
bt as (select *, unnest([{_THRESHOLDS}]) as threshold from bs),
sw as (select symbol, threshold, null::bigint as year, {_masked('mag >= threshold')}, count(*) filter (where mag >= threshold and mag >= 0.5) as overlap, count(*) filter (where mag >= 0.5) as base_n from bt group by 1, 2
 union all select symbol, threshold, year(d), {_masked('mag >= threshold')}, count(*) filter (where mag >= threshold and mag >= 0.5), count(*) filter (where mag >= 0.5) from bt group by 1, 2, 3)"""
_SW = """symbol, threshold, year, count, mean_signed_return, median_signed_return, hit_rate, overlap as baseline_overlap_count,
 case when base_n > 0 then round(round(overlap/base_n, 12), 9) end as baseline_overlap_rate, case when count > 0 then round(round(overlap/count, 12), 9) end as baseline_share_of_selected"""


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.boundary_sample(study_frame(spark, sf_dir), BOUNDARY)


@query("A17_threshold_sweep", f"with {CTE_B} select {_SW} from sw where year is null")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.threshold_sweep(boundary(spark, sf_dir), BOUNDARY).where("year is null")


@query("A18_yearly_threshold_split", f"with {CTE_B} select {_SW} from sw where year is not null")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.threshold_sweep(boundary(spark, sf_dir), BOUNDARY).where("year is not null")


@query("J13_baseline_overlap", f"""with {CTE_B} select symbol, threshold, overlap as baseline_overlap_count, case when base_n > 0 then round(round(overlap/base_n, 12), 9) end as baseline_overlap_rate,
 case when count > 0 then round(round(overlap/count, 12), 9) end as baseline_share_of_selected from sw where year is null""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = studies.threshold_sweep(boundary(spark, sf_dir), BOUNDARY).where("year is null")
    return sweep.select("symbol", "threshold", "baseline_overlap_count", "baseline_overlap_rate", "baseline_share_of_selected")


@query("P14_boundary_shells", f"""with {CTE_B}, sh as (select * from bs, (values (0.4::double, 0.5::double), (0.5, 0.6)) v(shell_low, shell_high))
 select symbol, shell_low, shell_high, {_masked('mag >= shell_low and mag < shell_high')} from sh group by 1, 2, 3""")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.boundary_shells(boundary(spark, sf_dir), BOUNDARY)


def _notes(side: str) -> str:
    return f"""case when {side}_n < 5 then '{side}_insufficient_signals' end, case when {side}_mean is null or {side}_mean <= 0 then '{side}_nonpositive_mean' end,
 case when {side}_median is null or {side}_median <= 0 then '{side}_nonpositive_median' end, case when {side}_hit is null or {side}_hit < 0.5 then '{side}_hit_rate_below_50pct' end,
 case when base_mean > 0 and ({side}_mean is null or {side}_mean < base_mean*0.5) then '{side}_mean_below_half_baseline' end"""


CTE_BW = CTE_B + ", bw as (select symbol, " + ", ".join(
    f"max(case when threshold = {t} then {c} end) as {s}_{n}"
    for s, t in (("base", 0.5), ("lower_neighbor", 0.4), ("upper_neighbor", 0.6))
    for n, c in (("n", "count"), ("mean", "mean_signed_return"), ("median", "median_signed_return"), ("hit", "hit_rate"))
) + f""" from sw where year is null group by symbol), bwt as (select symbol, concat_ws(',', case when base_mean is null or base_mean <= 0 then 'baseline_nonpositive_mean' end,
 {_notes('lower_neighbor')}, {_notes('upper_neighbor')}) as warnings from bw)"""


@query("A19_boundary_warnings", f"with {CTE_BW} select symbol, warnings, warnings = '' as local_boundary_robust from bwt")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.boundary_warnings(studies.threshold_sweep(boundary(spark, sf_dir), BOUNDARY), BOUNDARY)


@query("C04_threshold_boundary_study", f"with {CTE_BW} select {_SW}, warnings, warnings = '' as local_boundary_robust from sw join bwt using (symbol)")
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = studies.threshold_sweep(boundary(spark, sf_dir), BOUNDARY)
    return sweep.join(studies.boundary_warnings(sweep, BOUNDARY), "symbol")


@query("A27_yearly_regime_split", f"""with {CTE_WF} select symbol, year(d)::bigint as year, {_SUMMARY},
 {r('case when count(x) > 1 then greatest(max(x) - avg(x), avg(x) - min(x))/(count(x) - 1) else abs(avg(x)) end')} as loo_max_mean_impact from oos group by 1, 2""")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = wf(spark, sf_dir).signals.withColumn("year", F.year("session_date"))
    return summarize(signals, ["symbol", "year"], "signed_return")


@query("S09_report_sink", f"with {cte_checks(_FLOOR).replace(', pf as', CTE_COVER + ', pf as', 1)} select symbol, verdict, n as total_signals from vd")
def s09_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    research_plan.write_report(run(spark, sf_dir), path)
    return spark.read.schema("symbol string, verdict string, total_signals bigint").json(f"{path}/verdicts")


_COVERED = f"cross join (values ('{PRIMARY}'), ('{SECOND}'), ('{CONTROL}')) w(symbol) cross join (values {', '.join(f'({n})' for n in LOOKBACKS)}) n(lookback)"


@query("S09_overall_report", f"""with {CTE_RUN}, o as (select case when bool_and(verdict = 'GO') then 'GO' when bool_and(verdict = 'KILL') then 'KILL' else 'MUTATE' end as verdict from vd)
 select o.verdict, 9::bigint as required_sessions, (select min(v) from cover) as valid_capacity, {_FLOOR}::bigint as min_total_signals, w.symbol, n.lookback::bigint as lookback,
 coalesce(c.v, 0) as valid_sessions, 'recorded' as feed from o {_COVERED} left join cover c on c.symbol = w.symbol and c.lookback = n.lookback""")
def s09_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    research_plan.write_report(run(spark, sf_dir), path, feed="recorded")
    back = spark.read.schema(
        "verdict string, required_sessions long, valid_capacity long, min_total_signals long, coverage array<struct<symbol: string, lookback: long, valid_sessions: long>>, feed string"
    ).json(f"{path}/overall")
    return back.select("verdict", "required_sessions", "valid_capacity", "min_total_signals", F.inline("coverage"), "feed")
