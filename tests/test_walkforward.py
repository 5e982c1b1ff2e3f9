from datetime import date

import numpy as np
import pytest
from helpers import days
from pyspark.sql import functions as F

from pitsignal.plans import research as rp
from pitsignal.plans import studies
from pitsignal.plans import walkforward as wf

CONFIG = wf.WalkForwardConfig(min_train=40, test_size=20, min_total_signals=20, beta_lookbacks=(10, 20))


def frames(spark, effect, symbols=("S", "CTL"), n=120, control_effect=0.0):
    ds = days(date(2025, 1, 2), n)
    levels = [-2.0, -1.2, 1.2, 2.0]
    rng = np.random.default_rng(4)
    rows = []
    for s in symbols:
        k = control_effect if s == "CTL" else effect
        for i, d in enumerate(ds):
            res = levels[i % 4] / 100
            fwd = k * np.sign(res) * (0.03 + 0.001 * rng.random())
            rows += [(s, lb, d, res, float(fwd), float(fwd) * 0.5) for lb in (10, 20)]
    return spark.createDataFrame(rows, "symbol string, lookback int, session_date date, residual double, forward_60m_return double, forward_30m_return double")


def test_a_planted_effect_goes_and_noise_is_killed(spark):
    _, table = wf.evaluate(frames(spark, 1.0), CONFIG, control="CTL")
    row = table.collect()[0]
    assert row.verdict == "GO" and all(row.checks.values()) and row.total_signals == 80 and row.control_mean == 0
    _, none = wf.evaluate(frames(spark, 0.0), CONFIG, control="CTL")
    assert none.collect()[0].verdict == "KILL"


def test_an_equally_strong_control_kills(spark):
    _, table = wf.evaluate(frames(spark, 1.0, control_effect=1.0), CONFIG, control="CTL")
    row = table.collect()[0]
    assert row.verdict == "KILL" and not row.control_not_equally_strong


def test_train_precedes_test_and_selection_is_continuation_on_sixty_minutes(spark):
    run = wf.walk_forward(frames(spark, 1.0), CONFIG)
    results = run.results.where("symbol = 'S'").orderBy("fold_id").collect()
    assert len(results) == 4
    for earlier, later in zip(results, results[1:]):
        assert later.train_end == earlier.test_end
    for r in results:
        assert r.train_start <= r.train_end < r.test_start <= r.test_end
        assert (r.thesis, r.normalization, r.horizon, r.lookback) == ("continuation", "raw", "forward_60m_return", 10)
        assert r.threshold == 0.005 or r.threshold == 0.015


def test_the_fixed_entry_stands_in_when_no_configuration_has_signals(spark):
    silent = frames(spark, 1.0).withColumn("residual", F.col("residual") * 0 + 1e-9)
    rows = wf.walk_forward(silent, CONFIG).selected.where("symbol = 'S'").collect()
    assert {(r.lookback, r.thesis, r.normalization, r.threshold, r.horizon) for r in rows} == {(10, "reversion", "raw", 0.005, "forward_30m_return")}


def test_dates_missing_for_one_lookback_are_left_out(spark):
    gone = date(2025, 1, 3)
    cut = frames(spark, 1.0).where(~((F.col("lookback") == 20) & (F.col("session_date") == gone)))
    sessions = wf.common_sessions(wf.clean_frames(cut, CONFIG))
    assert sessions.where(F.col("session_date") == gone).count() == 0 and sessions.where("symbol = 'S'").count() == 119


def test_absent_lookbacks_do_not_stop_the_evaluation(spark):
    silent = frames(spark, 1.0).withColumn("residual", F.col("residual") * 0 + 1e-9)
    only = lambda df, *kept: df.where(F.col("lookback").isin(*kept))
    rest = max(CONFIG.beta_lookbacks)
    part = only(silent, rest)
    run = wf.walk_forward(part, CONFIG)
    assert {r.lookback for r in run.selected.collect()} == {rest} and run.folds.count() > 0
    # none of the configured ones: all that the frame has are evaluated
    other = part.withColumn("lookback", F.lit(77)).unionByName(part.withColumn("lookback", F.lit(99)))
    assert {r.lookback for r in wf.walk_forward(other, CONFIG).selected.collect()} == {77}
    assert {r.lookback for r in wf.walk_forward(other, CONFIG).candidates.select("lookback").distinct().collect()} == {77, 99}


def test_folds_have_no_partial_tail_and_sizes_are_checked(spark):
    sessions = spark.createDataFrame([("S", d, i + 1) for i, d in enumerate(days(date(2025, 1, 2), 29))], "symbol string, session_date date, session_rank int")
    got = wf.expanding_folds(sessions, min_train=10, test_size=5).orderBy("fold_id").collect()
    assert [(r.train_end_rank, r.test_end_rank) for r in got] == [(10, 15), (15, 20), (20, 25)]
    for bad in ({"min_train": 1, "test_size": 5}, {"min_train": 5, "test_size": 0}):
        with pytest.raises(ValueError):
            wf.expanding_folds(sessions, **bad)


def test_overall_verdict_and_signal_floor(spark):
    def overall(rows):
        return wf.overall_verdict(spark.createDataFrame(rows, "symbol string, verdict string"), ("A", "B")).collect()[0][0]

    assert overall([("A", "GO"), ("B", "GO")]) == "GO"
    assert overall([("A", "KILL"), ("B", "KILL")]) == "KILL"
    assert overall([("A", "GO"), ("B", "KILL")]) == "MUTATE"
    assert overall([("A", "GO")]) == "KILL" and overall([("A", "GO"), ("B", "GO"), ("C", "GO")]) == "KILL"
    floors = spark.createDataFrame([(50,), (85,), (95,), (338,)], "v int").select("v", rp.signal_floor(F.col("v")).alias("f")).collect()
    assert {r.v: r.f for r in floors} == {50: 8, 85: 8, 95: 10, 338: 34}


def test_short_history_stops_with_mutate(spark):
    run = rp.research(frames(spark, 1.0, n=30), CONFIG, required=("S",), control="CTL")
    stop = rp.insufficient_history(run.capacity).collect()
    assert [(r.verdict, r.reason, r.required_sessions, r.valid_capacity) for r in stop] == [("MUTATE", "insufficient_history", 60, 30)]
    assert run.evaluation is None and run.verdicts is None and run.overall.collect()[0].overall_verdict == "MUTATE"
    row = rp.overall_report(run, feed="recorded").collect()[0]
    assert (row.verdict, row.reason, row.valid_capacity, row.feed) == ("MUTATE", "insufficient_history", 30, "recorded")
    assert {c.symbol for c in row.coverage} == {"S", "CTL"}


def test_the_config_hash_is_stable_and_follows_the_floor(spark):
    hashed = spark.range(1).select(CONFIG.config_hash_column(F.lit(20)).alias("h")).collect()[0].h
    assert hashed == CONFIG.config_hash() != wf.WalkForwardConfig().config_hash()


def horizon_frame(spark, gains):
    base = [0.010, 0.012, 0.011, 0.013, 0.009, 0.014]
    rows = []
    for i, b in enumerate(base):
        sign = 1 if i % 2 else -1
        fwd = {m: sign * (b + gains.get(m, [0] * 6)[i]) for m in (15, 30, 45, 60, 90, 120)}
        rows.append(("S", date(2025 + i // 3, 3, 3 + i), 0.02 * sign, 40, *[fwd[m] for m in (15, 30, 45, 60, 90, 120)]))
    columns = ", ".join(f"forward_{m}m_return double" for m in (15, 30, 45, 60, 90, 120))
    return spark.createDataFrame(rows, f"symbol string, session_date date, residual double, training_count int, {columns}")


def test_a_steady_improvement_is_recommended_and_an_outlier_is_not(spark):
    study = studies.HorizonStudy(samples=200)
    steady = studies.horizon_study(horizon_frame(spark, {90: [0.004, 0.005, 0.004, 0.006, 0.005, 0.004], 120: [0.1, -0.01, -0.01, -0.01, -0.01, -0.01]}), study)
    rows = {r.minutes: r for r in steady.collect()}
    assert rows[90].eligible and not rows[120].eligible and rows[120].loo_min_improvement < 0 and not rows[60].eligible
    best = studies.recommended_horizon(steady).collect()[0]
    assert best.recommended_minutes == 90 and best.promoted
    flat = studies.recommended_horizon(studies.horizon_study(horizon_frame(spark, {}), study)).collect()[0]
    assert flat.recommended_minutes == 60 and not flat.promoted


def test_partial_history_and_missing_values_leave_the_sample(spark):
    frame = horizon_frame(spark, {})
    short = frame.withColumn("training_count", F.when(F.col("session_date") == date(2025, 3, 3), 39).otherwise(40))
    holed = short.withColumn("forward_15m_return", F.when(F.col("session_date") == date(2025, 3, 4), float("nan")).otherwise(F.col("forward_15m_return")))
    sample = studies.horizon_sample(holed, studies.HorizonStudy())
    assert {r["count"] for r in sample.groupBy("minutes").count().collect()} == {4}
    with pytest.raises(ValueError, match="missing columns"):
        studies.horizon_sample(frame.drop("forward_90m_return"), studies.HorizonStudy())


def boundary_frame(spark, shell_loss):
    ds = days(date(2025, 1, 2), 120)
    sizes = [0.0095, 0.0105, 0.0130, 0.0200]
    rows = []
    for i, d in enumerate(ds):
        r = sizes[i % 4] * (1 if i % 8 < 4 else -1)
        gain = -0.05 if shell_loss and i % 4 == 0 else 0.01
        rows.append(("S", d, r, 40, gain * (1 if r > 0 else -1)))
    return spark.createDataFrame(rows, "symbol string, session_date date, residual double, training_count int, forward_60m_return double")


def test_a_knife_edge_below_the_gate_is_reported(spark):
    study = studies.BoundaryStudy()
    for loss, robust in ((False, True), (True, False)):
        sample = studies.boundary_sample(boundary_frame(spark, loss), study)
        sweep = studies.threshold_sweep(sample, study)
        note = studies.boundary_warnings(sweep, study).collect()[0]
        assert note.local_boundary_robust == robust
    assert "lower_neighbor_nonpositive_mean" in note.warnings and "baseline_nonpositive_mean" not in note.warnings
    shells = {r.shell_low: r for r in studies.boundary_shells(sample, study).collect()}
    assert shells[0.009].mean_signed_return == pytest.approx(-0.05) and shells[0.01].mean_signed_return == pytest.approx(0.01)
    totals = {r.threshold: r for r in sweep.where("year is null").collect()}
    assert totals[0.012]["count"] == 60 and totals[0.008].baseline_overlap_rate == 1.0 and totals[0.009].baseline_share_of_selected == 0.75


def test_threshold_grids_are_checked():
    for grid in ((), (0.01, 0.009, 0.011), (0.009, 0.01), (-0.01, 0.009, 0.010, 0.011)):
        with pytest.raises(ValueError):
            studies.BoundaryStudy(thresholds=grid)


def test_a_missing_required_symbol_has_no_capacity(spark):
    frames = spark.createDataFrame([("A", 10, 0.1)] * 90, "symbol string, lookback int, residual double")
    cover = rp.coverage(frames, ["A", "B"], [10])
    assert {(r.symbol, r.valid_sessions) for r in cover.collect()} == {("A", 90), ("B", 0)}
    stop = rp.insufficient_history(rp.capacity(cover, wf.WalkForwardConfig())).collect()
    assert [(r.verdict, r.reason, r.valid_capacity) for r in stop] == [("MUTATE", "insufficient_history", 0)]
