import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitsignal.operators.episodes import episode_frame
from pitsignal.operators.ledger import TRANSITIONS
from pitsignal.session import scratch_path
from pitsignal.streaming import bars as sb
from pitsignal.streaming import episodes as se
from pitsignal.streaming.live import rolling_betas
from pitsignal.streaming.run import file_stream, run_available, with_end

T0 = datetime(2026, 8, 31, 13, 0)


def drip(spark, batches, schema):
    """A folder that a stream reads in several micro-batches, oldest file first."""
    path = scratch_path(spark, "drip")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, spark.createDataFrame([], schema).schema, max_files=1)


def test_bars_are_built_across_batches_and_late_ticks_left_out(spark):
    tick = lambda s, i, p: ("A", T0 + timedelta(seconds=s), i, p, 1.0)
    batches = [[tick(0, 1, 10.0), tick(30, 2, 12.0)], [tick(50, 3, 9.0), tick(70, 4, 11.0)], [tick(3600, 5, 20.0)], [tick(3700, 9, 20.0)], [tick(10, 6, 99.0), tick(7200, 7, 20.0)], [tick(9000, 8, 1.0)]]
    stream = drip(spark, batches, "symbol string, ts timestamp, tick_id long, price double, size double")
    got = {r.ts: r for r in run_available(sb.bars_from_ticks(stream), "bars").collect()}
    first = got[T0]
    assert (first.open, first.high, first.low, first.close, first.volume) == (10.0, 12.0, 9.0, 9.0, 3.0)
    assert got[T0 + timedelta(minutes=1)].open == 11.0


def test_copies_in_later_batches_are_ignored(spark):
    row = ("A", T0, 1.0)
    stream = drip(spark, [[row, row], [row, ("B", T0, 1.0)]], "symbol string, ts timestamp, v double")
    assert sorted(r.symbol for r in run_available(sb.ingest_once(stream, ["symbol", "ts"], delay="1 hour"), "once").collect()) == ["A", "B"]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 2, 3), (2, 1, 0, 3), (1, 2, 0, 3)])
def test_the_machine_gives_the_same_steps_in_any_arrival_order(spark, order):
    at = lambda i: T0 + timedelta(seconds=10 * i)
    batches = [
        [(1, 1, "FEATURES_FROZEN", at(1)), (1, 2, "FEATURES_FROZEN", at(2))],
        [(1, 3, "ORDER_FILLED", at(3)), (1, 4, "ABSTAINED", at(4)), (2, 5, "ABSTAINED", at(5))],
        [(1, 6, "COLLECTING", at(6))],
        [(9, 7, "ABSTAINED", at(1000))],
    ]
    stream = drip(spark, [batches[i] for i in order], "episode_id long, transition_id long, requested string, ts timestamp")
    machine = se.episode_steps(stream, allowed=TRANSITIONS, initial="COLLECTING", retain_seconds=3600)
    steps = run_available(machine, "steps", keyed=True).orderBy("transition_id").collect()
    assert [s.outcome for s in steps] == ["applied", "repeat", "illegal", "applied", "applied", "illegal"]
    assert [s.from_state for s in steps] == ["COLLECTING", "FEATURES_FROZEN", "FEATURES_FROZEN", "FEATURES_FROZEN", "COLLECTING", "ABSTAINED"]


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2)])
def test_a_fill_read_before_its_submission_counts(spark, order):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(1, "submitted", "open", at(0)), (2, "submitted", "open", at(5))],
        [(1, "filled", "open", at(60)), (2, "filled", "open", at(400)), (3, "filled", "open", at(1))],
        [(9, "submitted", "open", at(9000))],
    ]
    stream = drip(spark, [batches[i] for i in order], "order_id long, kind string, phase string, ts timestamp")
    got = run_available(se.order_timeouts(stream), "timeouts", keyed=True).collect()
    assert sorted((r.order_id, r.outcome) for r in got) == [(1, "filled"), (2, "timed_out")]


def test_orders_fill_or_time_out(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(1, "submitted", "open", at(0)), (2, "submitted", "open", at(0)), (3, "submitted", "cancel", at(0))],
        [(1, "filled", "open", at(170)), (4, "submitted", "open", at(9000))],
        [(4, "filled", "open", at(9001)), (5, "submitted", "open", at(20_000))],
    ]
    stream = drip(spark, batches, "order_id long, kind string, phase string, ts timestamp")
    got = {r.order_id: (r.outcome, r.at_ms - int(T0.timestamp() * 1000)) for r in run_available(se.order_timeouts(stream), "timeouts", keyed=True).collect()}
    base = {k: v[0] for k, v in got.items()}
    assert base == {1: "filled", 2: "timed_out", 3: "timed_out", 4: "filled"}
    assert got[2][1] - got[3][1] == 150_000 and got[1][1] - got[3][1] == 140_000


def test_freshness_join_and_cutoff(spark):
    later = T0 + timedelta(hours=2)
    decisions = drip(spark, [[(1, T0, "A"), (2, T0, "B")], [(3, later, "C")]], "decision_id long, decided_at timestamp, k string")
    quotes = drip(spark, [[(10, T0 - timedelta(seconds=61), "A"), (11, T0 - timedelta(seconds=60), "A")], [(12, T0 - timedelta(seconds=1), "A"), (13, T0 + timedelta(seconds=1), "A"), (14, T0 - timedelta(seconds=90), "B")], [(15, later, "Z")]], "quote_id long, quoted_at timestamp, k string")
    pairs = run_available(sb.fresh_quotes(decisions, quotes, key="k"), "fresh")
    assert sorted(r.quote_id for r in pairs.where("quote_id is not null").collect()) == [11, 12]
    # the decision without a quote is refused once the watermark has passed it; the last one still waits
    assert sorted((r.decision_id, r.quote_id, r.refused) for r in sb.freshest(pairs).collect()) == [(1, 12, False), (2, None, True)]
    rows = [("in", datetime(2026, 8, 31, 13, 40), datetime(2026, 8, 31, 13, 55)), ("late", datetime(2026, 8, 31, 13, 40), datetime(2026, 8, 31, 13, 56)), ("after", datetime(2026, 8, 31, 13, 41), datetime(2026, 8, 31, 13, 41))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, arrived timestamp")
    routed = sb.route_events(df, cutoff="09:40", tz="America/New_York")
    assert {r.symbol: r.route for r in routed.collect()} == {"in": "feature", "late": "late", "after": "after_cutoff"}
    assert [(r.symbol, r.late_events) for r in sb.abstain_rows(routed, tz="America/New_York").collect()] == [("late", 1)]
    assert routed.select(F.count("route")).collect()[0][0] == 3


def test_an_ended_source_leaves_nothing_waiting(spark):
    at = lambda i: T0 + timedelta(seconds=10 * i)
    batches = [[(1, 1, "FEATURES_FROZEN", at(2)), (1, 0, "ABSTAINED", at(1))], [(2, 3, "FEATURES_FROZEN", at(200)), (1, 2, "ABSTAINED", at(90))]]
    for retain in (None, 600):
        stream, finish = with_end(drip(spark, batches, "episode_id long, transition_id long, requested string, ts timestamp"), "ts")
        machine = se.episode_steps(stream, allowed=TRANSITIONS, initial="COLLECTING", retain_seconds=retain)
        got = run_available(machine, "ended", ends=[finish], keyed=True).orderBy("transition_id").collect()
        assert [(r.transition_id, r.from_state, r.outcome) for r in got] == [
            (0, "COLLECTING", "applied"), (1, "ABSTAINED", "illegal"), (2, "ABSTAINED", "repeat"), (3, "COLLECTING", "applied"),
        ]
    orders, finish = with_end(drip(spark, [[(1, "submitted", "open", at(0))], [(2, "filled", "open", at(1))]], "order_id long, kind string, phase string, ts timestamp"), "ts")
    assert [(r.order_id, r.outcome) for r in run_available(se.order_timeouts(orders), "orders", ends=[finish], keyed=True).collect()] == [(1, "timed_out")]
    decisions, no_decisions = with_end(drip(spark, [[(1, T0, "A"), (2, T0, "B")]], "decision_id long, decided_at timestamp, k string"), "decided_at")
    quotes, no_quotes = with_end(drip(spark, [[(10, T0, "A"), (11, T0, "C")]], "quote_id long, quoted_at timestamp, k string"), "quoted_at")
    pairs = run_available(sb.fresh_quotes(decisions, quotes, key="k"), "pairs", ends=[no_decisions, no_quotes])
    assert sorted((r.decision_id, r.quote_id, r.refused) for r in sb.freshest(pairs).collect()) == [(1, 10, False), (2, None, True)]


def test_late_events_of_a_session_abstain_once_it_is_over(spark):
    late = datetime(2026, 8, 31, 13, 40)
    batches = [
        [("A", late, late + timedelta(minutes=30)), ("B", late, late)],
        [("A", late + timedelta(seconds=-5), late + timedelta(hours=1)), ("B", datetime(2026, 9, 1, 3, 0), datetime(2026, 9, 1, 3, 0))],
        [("B", datetime(2026, 9, 1, 4, 20), datetime(2026, 9, 1, 4, 20))],
    ]
    stream = sb.route_events(drip(spark, batches, "symbol string, ts timestamp, arrived timestamp"), cutoff="09:40", tz="America/New_York")
    got = run_available(sb.abstain_rows(stream, tz="America/New_York"), "abstain").collect()
    assert [(r.symbol, str(r.session_date), r.late_events, r.reason) for r in got] == [("A", "2026-08-31", 2, "late_start")]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 3, 2)])
def test_rolling_betas_equal_the_batch_in_any_arrival_order(spark, order):
    rng = random.Random(5)
    rows = [("A" if i % 3 else "B", date(2026, 1, 5) + timedelta(days=i), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(48)]
    rows[7] = (*rows[7][:2], None, 0.1)
    rows[20] = (*rows[20][:2], 0.3, float("nan"))
    batches = [rows[i * 12 : (i + 1) * 12] for i in range(4)]
    schema = "symbol string, session_date date, driver_return double, premarket_return double"
    stream, finish = with_end(drip(spark, [batches[i] for i in order], schema).withColumn("end_ts", F.col("session_date").cast("timestamp")), "end_ts")
    got = {(r.symbol, r.session_date): r for r in run_available(rolling_betas(stream, lookback=5, delay="30 days"), "betas", ends=[finish], keyed=True).collect()}
    batch = episode_frame(spark.createDataFrame(rows, schema), [5], full_window=True).collect()
    assert len(got) == len(batch) == 48
    for r in batch:
        own = got[r.symbol, r.session_date]
        assert own.training_count == r.training_count
        for name in ("beta", "expected_return", "residual"):
            want = getattr(r, name)
            if want is None or want != want:
                assert getattr(own, name) is None
            else:
                assert getattr(own, name) == pytest.approx(want, abs=1e-9)


def test_keys_of_one_bucket_are_told_apart(spark):
    """Two buckets hold all keys, those without one in a third; the result is that of a bucket per key."""
    rng = random.Random(8)
    at = lambda: T0 + timedelta(seconds=rng.randrange(800))
    states = [*TRANSITIONS, "UNKNOWN"]
    asked = [(e, i, rng.choice(states), at()) for i, e in enumerate([None, 1, 2, 3, 4, 5] * 8)]
    orders = [(o, kind, rng.choice(list(se.PHASE_LIMITS)), at()) for o in [None, *range(20)] for kind in ("submitted", "filled", "submitted")]

    def steps(buckets):
        stream, finish = with_end(drip(spark, [asked[:20], asked[20:]], "episode_id long, transition_id long, requested string, ts timestamp"), "ts")
        machine = se.episode_steps(stream, allowed=TRANSITIONS, initial="COLLECTING", retain_seconds=86_400, buckets=buckets)
        return sorted(run_available(machine, "few", ends=[finish], keyed=True).collect(), key=lambda r: r.transition_id)

    got = steps(2)
    states = dict.fromkeys([r[0] for r in asked], "COLLECTING")
    for (episode, number, requested, _), step in zip(asked, got, strict=True):
        name = states[episode]
        outcome = "repeat" if requested == name else "applied" if requested in TRANSITIONS.get(name, ()) else "illegal"
        assert tuple(step) == (episode, number, name, requested, outcome)
        states[episode] = requested if outcome == "applied" else name

    stream, finish = with_end(drip(spark, [orders], "order_id long, kind string, phase string, ts timestamp"), "ts")
    found = {r.order_id: (r.outcome, r.at_ms) for r in run_available(se.order_timeouts(stream, buckets=2), "few", ends=[finish], keyed=True).collect()}
    for order in [None, *range(20)]:
        own = [(k, int(t.timestamp() * 1000), se.PHASE_LIMITS[p] * 1000) for o, k, p, t in orders if o == order]
        limit, fill = min(ms + cap for k, ms, cap in own if k == "submitted"), min(ms for k, ms, _ in own if k == "filled")
        assert found.pop(order) == (("filled", fill) if fill <= limit else ("timed_out", limit))
    assert not found
