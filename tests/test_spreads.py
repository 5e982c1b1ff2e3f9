import itertools
import random
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal as D
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.functions import numeric
from pitsignal.functions.draws import trial_draws, whole_steps
from pitsignal.operators import risk, spreads
from pitsignal.plans import stress
from pitsignal.schemas import CHAIN

NOW = datetime(2026, 8, 31, 14, 0)
POLICY = spreads.SpreadPolicy(approved=("ABC",))


def contract(symbol, strike, bid, ask, delta, kind="call", expiry=date(2026, 9, 18), age=10, underlying="ABC", chain="c"):
    d = None if delta is None else D(str(delta))
    return (chain, underlying, symbol, expiry, D(str(strike)), kind, D(str(bid)), D(str(ask)), d, NOW - timedelta(seconds=age))


def table(spark, rows):
    return spark.createDataFrame(rows, CHAIN)


def at():
    return F.lit(NOW)


def best(spark, rows, budget=None, policy=POLICY):
    df = table(spark, rows)
    if budget is not None:
        df = df.withColumn("budget", F.lit(D(str(budget))).cast("decimal(18,4)"))
    return {r.direction: r for r in spreads.best_verticals(df, ["chain_id"], policy, at(), "budget" if budget is not None else None).collect()}


def test_the_best_vertical_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for chain, kind, week in itertools.product("xy", ("call", "put"), (11, 18)):
        for i in range(60):
            k = 100 + 5 * int(rng.integers(0, 10))
            mag = round(float(rng.choice([0.12, 0.2, 0.3, 0.34, 0.46, 0.5, 0.6, 0.64])), 6)
            mid = round(float(rng.integers(200, 260)) / 20, 2)
            sign = 1 if kind == "call" else -1
            rows.append(contract(f"{kind[0]}{week}{i:02d}", k, f"{mid - 0.1:.2f}", f"{mid + 0.1:.2f}", sign * mag, kind, date(2026, 9, week), chain=chain))
    got = {(r.chain_id, r.direction): r for r in spreads.best_verticals(table(spark, rows), ["chain_id"], POLICY, at()).collect()}
    for chain, kind in itertools.product("xy", ("call", "put")):
        candidates = []
        mine = [r for r in rows if r[0] == chain and r[5] == kind]
        for lo, sh in itertools.product(mine, mine):
            width = (sh[4] - lo[4]) * (1 if kind == "call" else -1)
            debit, net = lo[7] - sh[6], abs(lo[8]) - abs(sh[8])
            if lo[3] == sh[3] and D("0.45") <= abs(lo[8]) <= D("0.65") and abs(sh[8]) >= D("0.10") and width > 0 and 0 < debit < width and net >= D("0.30"):
                candidates.append((-Fraction(net) / Fraction(debit), -net, debit, lo[3], lo[2], sh[2]))
        first = min(candidates)
        row = got[(chain, "bullish" if kind == "call" else "bearish")]
        assert (row.expiration, row.long_symbol, row.short_symbol) == first[3:]
        assert row.net_debit == first[2].quantize(D("0.01"))


def test_debit_loss_and_ages(spark):
    rows = [contract("L", 100, "4.90", "5.005", 0.55, age=40), contract("S", 105, "2.00", "2.20", 0.20, age=5)]
    row = best(spark, rows)["bullish"]
    assert (row.net_debit, row.max_loss, row.structure) == (D("3.01"), D("301.00"), "call_debit_spread")
    assert row.quote_ts == NOW - timedelta(seconds=40)


def test_the_short_leg_floor_and_the_budget(spark):
    rows = [contract("L", 100, 5, 5.1, 0.55), contract("S", 110, 2, 2.1, 0.15), contract("LOT", 120, 1.9, 2, 0.02)]
    assert best(spark, rows)["bullish"].short_symbol == "S"
    assert best(spark, rows, budget=3.1)["bullish"].short_symbol == "S" and best(spark, rows, budget=3.05) == {}


def test_equal_scores_fall_to_the_smaller_symbols(spark):
    rows = [contract(s, 100, 5, 5.1, 0.55) for s in ("B", "A")] + [contract(s, 110, 2, 2.1, 0.15) for s in ("Z", "Y")]
    row = best(spark, rows)["bullish"]
    assert (row.long_symbol, row.short_symbol) == ("A", "Y")


def test_feasibility_reasons_in_order(spark):
    good = [contract("L", 100, 5, 5.1, 0.55), contract("S", 110, 2, 2.1, 0.15)]
    with_chain = lambda rows, c, **kw: [(c, kw.get("underlying", r[1]), *r[2:]) for r in rows]
    rows = (
        with_chain(good, "ok")
        + with_chain(good, "other", underlying="XYZ")
        + [contract("E", 100, 5, 5.1, 0.55, expiry=date(2026, 9, 1), chain="dte"), contract("E2", 100, 5, 5.1, 0.55, age=-1, chain="dte")]
        + [contract("N", 100, 5, 5.1, None, chain="nodelta")]
        + [contract("L", 100, 5, 5.1, 0.55, chain="alone"), contract("W", 110, 1, 3, 0.15, chain="alone")]
    )
    got = {r.chain_id: r for r in spreads.feasibility(table(spark, rows), ["chain_id"], POLICY, at()).collect()}
    assert got["ok"].feasible and got["ok"].available_structures == ["call_debit_spread"] and got["ok"].eligible_contract_count == 2
    assert [got[c].reason for c in ("other", "dte", "nodelta", "alone")] == [
        "underlying_not_approved", "no_eligible_contracts", "missing_required_delta", "no_compatible_vertical",
    ]
    assert got["alone"].eligible_contract_count == 1


def test_stress_is_deterministic_keeps_invariants_and_fails_closed(spark):
    rows = [contract(f"K{k}", k, 20 - (k - 100) * 0.3, 20.2 - (k - 100) * 0.3, 0.62 - (k - 100) * 0.009) for k in range(100, 155, 5)]
    df = table(spark, rows).withColumn("max_net_debit", F.lit(D("15")).cast("decimal(18,4)"))
    run = lambda seed: stress.stress_trials(df, key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit", trials=25, seed=seed)
    first, again, other = run(1).collect(), run(1).collect(), run(2).collect()
    assert sorted(first) == sorted(again) and sorted(first) != sorted(other)
    base = spreads.best_verticals(df, ["chain_id"], POLICY, at(), "max_net_debit").withColumn("max_net_debit", F.lit(D("15")))
    table_ = stress.stress_summary(run(1), base, key="chain_id", policy=POLICY, trials=25).collect()
    assert {r.band for r in table_} == {"micro", "small", "moderate"} and all(r.risk_invariant_violations == 0 for r in table_)
    assert all(r.candidate_count + r.abstention_count == 25 and 0 <= r.same_pair_rate <= r.same_long_rate <= 1 for r in table_)
    tight = df.withColumn("max_net_debit", F.lit(D("0.01")).cast("decimal(18,4)"))
    assert stress.stress_trials(tight, key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit", trials=5).count() == 0
    with pytest.raises(ValueError):
        stress.stress_trials(df, key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit", trials=0)


@pytest.mark.parametrize("seed", [3, 4])
def test_bounds_lose_no_best_spread(spark, seed):
    """Trials over contending pairs equal the best spread over all perturbed contracts, with crowded strikes and wide quotes."""
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        strike = 100 + 5 * rng.randrange(6)
        delta = min(0.95, max(0.02, 0.66 - (strike - 100) * 0.02 + rng.uniform(-0.05, 0.05)))
        bid = max(0.05, 24 - (strike - 100) * 0.5 + rng.uniform(-2, 2))
        rows.append(contract(f"C{i}", strike, round(bid, 2), round(bid * (1 + rng.choice([0.01, 0.1, 0.27])), 2), round(delta, 4)))
    df = table(spark, rows).withColumn("max_net_debit", F.lit(D("9")).cast("decimal(18,4)"))
    pairs = stress.contending_pairs(df, key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit")
    got = stress.stress_trials(df, key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit", trials=37, seed=seed, block=5)
    all_rows = stress.perturbed_quotes(stress.band_trials(df, stress.BANDS, 37), seed=seed).withColumn("band", F.col("band.name"))
    want = spreads.best_verticals(all_rows, ["chain_id", "band", "trial"], POLICY, at(), "max_net_debit")
    columns = sorted(want.columns)
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect()) and got.count() > 30
    assert 0 < pairs.count() < 3 * 90 * 89 / 4


def test_report_has_a_row_for_a_side_without_baseline(spark):
    rows = [contract(f"K{k}", k, 20 - (k - 100) * 0.3, 20.2 - (k - 100) * 0.3, 0.62 - (k - 100) * 0.009) for k in range(100, 155, 5)]
    df = table(spark, rows).withColumn("max_net_debit", F.lit(D("15")).cast("decimal(18,4)"))
    common = dict(key="chain_id", policy=POLICY, trials=10, max_debit="max_net_debit")
    run = stress.stress_trials(df, key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit", trials=10)
    base = spreads.best_verticals(df, ["chain_id"], POLICY, at(), "max_net_debit").withColumn("max_net_debit", F.lit(D("15")))
    got = stress.stress_report(df, run, base, **common).collect()
    none = [r for r in got if not r.baseline_constructible]
    assert [(r.direction, r.contract_count, r.band, r.base_long_symbol, r.top_pairs) for r in none] == [("bearish", len(rows), None, None, None)]
    sides = [r for r in got if r.baseline_constructible]
    assert {r.band for r in sides} == {"micro", "small", "moderate"} and all(r.trials_per_band == 10 for r in sides)
    assert all(sum(p["count"] for p in r.top_pairs) == r.candidate_count for r in sides if len(r.top_pairs) < 5)


RISK = risk.RiskPolicy(approved=("ABC",), final_entry_cutoff=datetime(2026, 9, 4, 14, 0, tzinfo=timezone.utc))
IN = "underlying string, max_loss decimal(18,2), starting_equity decimal(18,2), buying_power decimal(18,2), aggregate_defined_loss decimal(18,2), open_underlyings array<string>, quote_ts timestamp, now timestamp"


def gates(spark, **change):
    row = dict(underlying="ABC", max_loss=D("500"), starting_equity=D("100000"), buying_power=D("50000"), aggregate_defined_loss=D("0"),
               open_underlyings=[], quote_ts=NOW, now=NOW) | change
    df = spark.createDataFrame([tuple(row.values())], IN)
    return risk.evaluate_risk(df, RISK).withColumn("budget", risk.debit_budget(RISK)).collect()[0]


def test_each_risk_gate_and_all_of_them_together(spark):
    assert gates(spark).approved and gates(spark).reasons == []
    late = datetime(2026, 9, 4, 14, 0)
    cases = {
        "underlying_not_approved": dict(underlying="XYZ"),
        "underlying_already_open": dict(open_underlyings=["ABC"]),
        "per_position_loss_cap": dict(max_loss=D("1000.01")),
        "aggregate_loss_cap": dict(aggregate_defined_loss=D("4500.01")),
        "insufficient_buying_power": dict(buying_power=D("499.99")),
        "stale_quote": dict(quote_ts=NOW - timedelta(seconds=61)),
        "outside_entry_window": dict(now=datetime(2026, 8, 31, 13, 54, 59), quote_ts=datetime(2026, 8, 31, 13, 54, 59)),
        "final_event_cutoff": dict(now=late, quote_ts=late),
    }
    for reason, change in cases.items():
        assert gates(spark, **change).reasons == [reason]
    everything = {}
    for change in cases.values():
        everything |= change
    everything |= dict(now=datetime(2026, 9, 5, 1, 0), quote_ts=NOW)
    worst = gates(spark, **(everything | dict(max_loss=D("6000"), open_underlyings=["XYZ"])))
    assert worst.reasons == list(cases)
    assert gates(spark, quote_ts=NOW + timedelta(seconds=1)).reasons == ["stale_quote"]


def test_the_debit_budget_is_the_tightest_cap_and_never_negative(spark):
    assert gates(spark).budget == D("10") and gates(spark, buying_power=D("300")).budget == D("3")
    assert gates(spark, aggregate_defined_loss=D("4900")).budget == D("1") and gates(spark, aggregate_defined_loss=D("6000")).budget == 0


def test_close_limits(spark):
    rows = [contract("L", 100, "5.00", "5.20", 0.5), contract("S", 110, "2.00", "2.119", 0.2), contract("P", 110, 2, 2.1, -0.2, "put"), contract("OLD", 120, 1, 1.1, 0.1, age=61), contract("X", 130, 0, 1.1, 0.1)]
    spread = [("a", "L", "S", 0), ("b", "L", "S", 1), ("c", "L", "NONE", 0), ("d", "S", "L", 0), ("e", "L", "P", 0), ("f", "L", "OLD", 0), ("g", "L", "X", 0), ("h", "OLD", "S", 0)]
    df = spark.createDataFrame([("c", *s) for s in spread], "chain_id string, id string, long_symbol string, short_symbol string, attempt int")
    got = {r.id: r for r in risk.close_instructions(df, table(spark, rows), keys=["chain_id"], approved=("ABC",), now=at()).collect()}
    assert got["a"].limit_price == D("-2.88") and got["b"].limit_price == D("-0.01")
    assert [got[k].reason for k in "cdefgh"] == [
        "contracts_not_in_chain", "not_the_opening_call_vertical", "option_type_differs", "stale_close_quote_short", "invalid_close_quote_short", "not_the_opening_call_vertical",
    ]


def test_draws_over_arrays_are_those_of_the_columns(spark):
    """Names of every length, one beyond a block of the digest, and all numbers of digits."""
    names = ["1", "12345", "é" * 5, "x" * 60]
    got = trial_draws("9|small", names, range(8, 1203, 1))
    rows = spark.createDataFrame([(n, t) for n in names for t in (8, 10, 99, 100, 1000, 1202)], "symbol string, trial int")
    digest = numeric.hash_digest(9, "small", F.col("trial"), F.col("symbol"))
    for r in rows.select("*", *[numeric.hash_uniform(digest, i).alias(f"u{i}") for i in range(3)]).collect():
        assert [r.u0, r.u1, r.u2] == got[:, names.index(r.symbol), r.trial - 8].tolist()
    near = np.array([1.005, 2.675, 0.285, 0.145, 1.0049999999, 12.5])
    assert whole_steps(near, 2).tolist() == [101, 268, 29, 15, 100, 1250]


def test_quote_extremes_are_those_of_all_perturbed_rows(spark):
    rows = [contract("A", 100, "0.02", "0.03", 0.5), contract("B", 105, 9, "11.5", -0.9999, "put"), contract("N", 110, 3, "3.2", None)]
    df = table(spark, rows)
    every = stress.perturbed_quotes(stress.band_trials(df, stress.BANDS, 30), seed=5).withColumn("band", F.col("band.name"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("bid", "ask", "delta") for n, f in (("low", F.min), ("high", F.max))]
    want = every.groupBy("chain_id", "symbol", "band").agg(F.count(F.lit(1)).alias("trials"), *ends)
    got = stress.quote_extremes(df, key="chain_id", trials=30, seed=5)
    assert got.count() == 9 and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_the_plan_of_the_trials_holds_no_perturbed_rows(spark):
    """The best pair of a trial is chosen before rows are made; the report's leg pairs come with the summary."""
    df = table(spark, [contract(f"K{k}", k, 20 - (k - 100) * 0.3, 20.2 - (k - 100) * 0.3, 0.62 - (k - 100) * 0.009) for k in range(100, 155, 5)])
    df = df.withColumn("max_net_debit", F.lit(D("15")).cast("decimal(18,4)"))
    run = stress.stress_trials(df, key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit", trials=10)
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    base = spreads.best_verticals(df, ["chain_id"], POLICY, at(), "max_net_debit").withColumn("max_net_debit", F.lit(D("15")))
    both = stress.stress_summary(run, base, key="chain_id", policy=POLICY, trials=10, top=2).collect()
    apart = {(r.direction, r.band, r.pair, r["count"], r.rate) for r in stress.top_pairs(run, key="chain_id", limit=2).collect()}
    assert {(r.direction, r.band, p.pair, p["count"], p.rate) for r in both for p in r.top_pairs} == apart


def test_packed_trials_are_the_trials_in_few_rows(spark):
    """Rows grow with the pairs that win, not with the trials, and the summaries and leg pairs are the same."""
    df = table(spark, [contract(f"K{k}", k, 20 - (k - 100) * 0.3, 20.2 - (k - 100) * 0.3, 0.62 - (k - 100) * 0.009) for k in range(100, 155, 5)])
    df = df.withColumn("max_net_debit", F.lit(D("15")).cast("decimal(18,4)"))
    common = dict(key="chain_id", policy=POLICY, now=at(), max_debit="max_net_debit", trials=300, block=150)
    run, few = stress.stress_trials(df, **common), stress.packed_trials(df, **common)
    flat = few.select("chain_id", "direction", "band", "long_symbol", "short_symbol", F.explode(F.arrays_zip("trials", "nets", "debits")).alias("t"))
    got = flat.select("band", "direction", "t.trials", "long_symbol", "short_symbol", "t.nets", "t.debits").collect()
    million, cents = (F.col("net_delta") * 1_000_000).cast("int"), (F.col("net_debit") * 100).cast("long")
    want = run.select("band", "direction", "trial", "long_symbol", "short_symbol", million, cents).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10 * few.count()
    limit = int(np.median([w[6] for w in want]))  # broken by some trials
    base = spreads.best_verticals(df, ["chain_id"], POLICY, at(), "max_net_debit").withColumn("max_net_debit", F.lit(D(limit) / 100))
    one, other = (stress.stress_summary(t, base, key="chain_id", policy=POLICY, trials=300, top=3).collect() for t in (run, few))
    assert sorted(map(str, one)) == sorted(map(str, other)) and {r.direction for r in other} == {"bullish"}
    for r in other:
        own = [w for w in want if w.band == r.band]
        assert r.candidate_count == len(own) and r.risk_invariant_violations == sum(w[6] > limit for w in own)
        assert r.net_debit_p50 == pytest.approx(np.quantile([w[6] / 100 for w in own], 0.5))
        assert r.delta_per_debit_p95 == pytest.approx(np.quantile([w[5] / w[6] / 1e4 for w in own], 0.95))
    assert sum(r.risk_invariant_violations for r in other) > 0
