from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import bar, days, ny
from pyspark.sql import functions as F

from pitsignal.functions.clock import SessionSpec
from pitsignal.operators.asof import asof_backward
from pitsignal.operators.calendar import business_days, session_table
from pitsignal.operators.episodes import episode_frame, raw_episodes
from pitsignal.operators.live import live_features
from pitsignal.schemas import BARS

SPEC = SessionSpec()
D0, D1 = date(2026, 8, 27), date(2026, 8, 28)


def market(spark, extra=(), skip=()):
    rows = [
        bar("EQ", ny(D0, "15:59"), 99, 100),
        bar("EQ", ny(D0, "16:00"), 500, 500),
        bar("DR", ny(D0, "15:58"), 1000, 1000),
        bar("EQ", ny(D1, "09:25"), 102, 150),
        bar("DR", ny(D1, "09:25"), 1010, 4000),
        bar("EQ", ny(D1, "09:30"), 103),
        bar("EQ", ny(D1, "09:40"), 106.09),
        bar("EQ", ny(D1, "09:55"), 110, 7),
        bar("EQ", ny(D1, "10:55"), 121, 9),
    ]
    rows = [r for r in rows if (r[0], r[1]) not in skip] + list(extra)
    return spark.createDataFrame(rows, BARS)


def build(spark, bars, sessions=(D1,), **kw):
    table = spark.createDataFrame([(d,) for d in sessions], "session_date date")
    return raw_episodes(bars, table, driver="DR", symbols=["EQ"], spec=SPEC, **kw)


def test_exact_boundaries_use_opens_and_the_start_uses_closes(spark):
    row = build(spark, market(spark)).collect()[0]
    assert row.prior_close == 100 and row.premarket_price == 102
    assert row.driver_return == pytest.approx(0.01)
    assert row.premarket_return == pytest.approx(0.02)
    assert row.opening_return == pytest.approx(0.03)
    assert row.forward_60m_return == pytest.approx(0.1)
    assert row.forward_15m_return is None


def test_a_jump_after_the_freeze_changes_nothing_before_it(spark):
    later = [bar("EQ", ny(D1, "09:26"), 999), bar("DR", ny(D1, "09:26"), 1)]
    calm, jumpy = build(spark, market(spark)).collect()[0], build(spark, market(spark, later)).collect()[0]
    assert calm == jumpy


def test_sessions_without_a_needed_boundary_are_dropped(spark):
    for missing in [("EQ", ny(D1, "09:25")), ("DR", ny(D1, "09:25")), ("DR", ny(D0, "15:58")), ("EQ", ny(D0, "15:59"))]:
        assert build(spark, market(spark, skip=[missing])).count() == 0


def test_a_duplicated_boundary_bar_counts_as_missing(spark):
    twice = [bar("EQ", ny(D1, "10:55"), 130)]
    assert build(spark, market(spark, twice)).collect()[0].forward_60m_return is None


def test_prior_close_reaches_over_a_gap(spark):
    monday = date(2026, 8, 31)
    extra = [bar("EQ", ny(monday, "09:25"), 50), bar("DR", ny(monday, "09:25"), 2000)]
    rows = build(spark, market(spark, extra), sessions=(monday,)).collect()
    assert rows[0].prior_close == 9 and rows[0].driver_return == pytest.approx(2000 / 4000 - 1)


def test_boundaries_follow_daylight_saving(spark):
    table = session_table(spark.createDataFrame([(date(2026, 1, 15),), (date(2026, 8, 31),)], "session_date date"), SPEC)
    got = {r.session_date: r.f for r in table.select("session_date", F.date_format("freeze_ts", "HH:mm").alias("f")).collect()}
    assert got == {date(2026, 1, 15): "14:25", date(2026, 8, 31): "13:25"}


def test_business_days_skip_weekends(spark):
    span = spark.createDataFrame([(date(2026, 8, 28), date(2026, 9, 1))], "first_day date, last_day date")
    assert sorted(r.session_date for r in business_days(span).collect()) == [date(2026, 8, 28), date(2026, 8, 31), date(2026, 9, 1)]


def series(spark, n=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.02, n)
    y = 1.5 * x + rng.normal(0, 0.005, n)
    ds = days(date(2026, 1, 5), n)
    rows = [("EQ", d, ds[i - 1] if i else date(2026, 1, 2), float(x[i]), float(y[i])) for i, d in enumerate(ds)]
    frame = spark.createDataFrame(rows, "symbol string, session_date date, prior_day date, driver_return double, premarket_return double")
    frame = frame.withColumn("prior_ts", F.col("prior_day").cast("timestamp")).drop("prior_day")
    for name in ("prior_close", "premarket_price", "opening_return"):
        frame = frame.withColumn(name, F.lit(1.0))
    return frame, x, y


def test_beta_is_strictly_prior_and_matches_least_squares(spark):
    frame, x, y = series(spark)
    got = {r.session_date: r for r in episode_frame(frame, [5]).collect()}
    ordered = [got[d] for d in sorted(got)]
    assert ordered[0].beta is None and ordered[1].beta is None
    for i in range(2, len(x)):
        lo = max(0, i - 5)
        slope = np.polyfit(x[lo:i], y[lo:i], 1)[0]
        assert ordered[i].beta == pytest.approx(slope)
        assert ordered[i].residual == pytest.approx(y[i] - slope * x[i])
        assert ordered[i].training_count == i - lo and ordered[i].training_end < ordered[i].session_date


def test_full_window_needs_all_prior_rows(spark):
    frame, _, _ = series(spark)
    rows = sorted(episode_frame(frame, [5], full_window=True).collect(), key=lambda r: r.session_date)
    assert [r.beta is None for r in rows] == [i < 5 for i in range(len(rows))]


def test_a_constant_driver_gives_no_beta(spark):
    frame, _, _ = series(spark)
    assert episode_frame(frame.withColumn("driver_return", F.lit(0.01)), [5]).where("beta is not null").count() == 0


def test_live_zscore_uses_only_earlier_full_residuals(spark):
    frame, x, y = series(spark, n=24)
    rows = sorted(live_features(frame, lookback=5, threshold=0.001, history_days=120).collect(), key=lambda r: r.session_date)
    residuals = {i: y[i] - np.polyfit(x[i - 5 : i], y[i - 5 : i], 1)[0] * x[i] for i in range(5, 24)}
    assert len(rows) == 19
    for row, i in zip(rows, range(5, 24)):
        earlier = [residuals[j] for j in range(5, i)]
        assert row.history_count == len(earlier)
        expected = None if len(earlier) < 10 else (residuals[i] - np.mean(earlier)) / np.std(earlier, ddof=1)
        assert row.residual_z == (None if expected is None else pytest.approx(expected))


def test_asof_matches_brute_force_over_gaps_and_ties(spark):
    rng = np.random.default_rng(3)
    right = [("k" if rng.random() < 0.7 else "m", int(t), float(i)) for i, t in enumerate(sorted(set(rng.integers(0, 40 * 86400, 60).tolist())))]
    left = [("k" if rng.random() < 0.5 else "m", int(t)) for t in rng.integers(0, 45 * 86400, 80)] + [(right[4][0], right[4][1])]
    stamp = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    l = stamp(spark.createDataFrame(left, "key string, at long"), "at")
    r = stamp(spark.createDataFrame(right, "key string, rt long, v double"), "rt")
    got = asof_backward(l, r, keys=["key"], left_ts="at", right_ts="rt", values=["v"]).select("key", F.unix_seconds("at").alias("at"), "v").collect()
    assert len(got) == len(left)
    for row in got:
        earlier = [v for k, t, v in right if k == row.key and t <= row.at]
        assert row.v == (earlier[-1] if earlier else None)


def test_asof_over_tiny_buckets_and_runs_with_ties(spark):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    left = spark.createDataFrame([("k", at(s)) for s in (0, 5, 10, 11, 5000, 90_000)] + [("z", at(7))], "key string, at timestamp")
    right = spark.createDataFrame([("k", at(5), 1), ("k", at(5), 3), ("k", at(5), 2), ("k", at(11), 4), ("y", at(0), 9)], "key string, rt timestamp, v int")
    got = asof_backward(left, right, keys=["key"], left_ts="at", right_ts="rt", values=["v"], bucket_seconds=2)
    base = int(at(0).timestamp())
    rows = {(r.key, r.s): r.v for r in got.select("key", (F.unix_seconds("at") - F.lit(base)).alias("s"), "v").collect()}
    assert rows == {("k", 0): None, ("k", 5): 3, ("k", 10): 3, ("k", 11): 4, ("k", 5000): 4, ("k", 90_000): 4, ("z", 7): None}
