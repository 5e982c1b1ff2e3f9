"""Composition over id ranges against plain loops, with ranges of a few ids."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pitsignal.operators.ledger import TRANSITIONS, replay_steps
from pitsignal.operators.ordering import range_scan
from pitsignal.operators.policies import ewma_choice

STATES = sorted({*TRANSITIONS, *(t for targets in TRANSITIONS.values() for t in targets)})


def machine(requests, allowed, initial):
    out, state = [], {}
    for episode, number, requested in sorted(requests, key=lambda r: r[1]):
        now = state.get(episode, initial)
        outcome = "repeat" if requested == now else "applied" if requested in allowed.get(now, ()) else "illegal"
        out.append((episode, number, now, requested, outcome))
        state[episode] = requested if outcome == "applied" else now
    return sorted(out)


@pytest.mark.parametrize("width", [2, 5, 1024])
def test_replayed_steps_equal_the_machine(spark, width):
    rng = random.Random(width)
    ids = rng.sample(range(-50, 900), 400)
    # one episode has most of the requests; unknown states are illegal
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.choice([*STATES, "NOWHERE"])) for i in ids]
    frame = spark.createDataFrame(rows, "episode_id long, transition_id long, requested string").repartition(5)
    got = replay_steps(frame, width=width).collect()
    assert sorted(tuple(r) for r in got) == machine(rows, TRANSITIONS, "COLLECTING")


def test_no_requests(spark):
    assert replay_steps(spark.createDataFrame([], "episode_id long, transition_id long, requested string")).collect() == []


@pytest.mark.parametrize("width", [3, 1024])
def test_ewma_of_a_long_series(spark, width):
    rng = random.Random(7)
    days = [date(2000, 1, 3) + timedelta(days=i) for i in sorted(rng.sample(range(4000), 1500))]
    rows = [("A", d, rng.uniform(-1, 1)) for d in days] + [("B", d, rng.uniform(-1, 1)) for d in days[:4]]
    frame = spark.createDataFrame(rows, "symbol string, session_date date, continuation double").repartition(4)
    got = {(r.symbol, r.session_date): r.ewma_score for r in ewma_choice(frame, width=width).collect()}
    for symbol in "AB":
        score, n = 0.0, 0
        for _, d, x in [r for r in rows if r[0] == symbol]:
            want = score if n >= 3 else None
            assert got[symbol, d] == (want if want is None else pytest.approx(want, abs=1e-9))
            score, n = score * 0.5 ** (1 / 3) + x, n + 1


def test_order_of_composition(spark):
    rows = [(k, i, chr(97 + i % 26)) for k in (1, 2) for i in range(60) if (i + k) % 3]
    frame = spark.createDataFrame(rows, "k int, i int, c string").repartition(3)
    got = {(r.k, r.i): r.before for r in range_scan(frame, ["k"], "i", F.col("c"), F.concat, "before", width=4).collect()}
    for k in (1, 2):
        text = ""
        for _, i, c in [r for r in rows if r[0] == k]:
            assert got[k, i] == (text or None)
            text += c
    with pytest.raises(ValueError):
        range_scan(frame, ["k"], "i", F.col("c"), F.concat, "before", width=1)
