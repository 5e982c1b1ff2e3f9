"""Episode state machine and open-order timeouts as keyed streaming state with event-time timers.

Start these streams with `run_available(..., keyed=True)`: typed state needs the keyed state store.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pitsignal.streaming.run import watermarked

STEP_SCHEMA = "episode_id bigint, transition_id bigint, from_state string, to_state string, outcome string"
TIMEOUT_SCHEMA = "order_id bigint, outcome string, at_ms bigint"

# fixed values: seconds an order may stay open in each phase
PHASE_LIMITS = {"open": 180, "close": 120, "cancel": 30}

# a call into Python costs more than the work on an episode or order, so one call has all those of a bucket
BUCKETS = 512
NEVER = (1 << 63) - 1  # limit without a submission, time without a fill

REQUESTS = pa.schema([("episode_id", pa.int64()), ("transition_id", pa.int64()), ("requested", pa.string()), ("ms", pa.int64())])
EPISODES = pa.schema([("episode_id", pa.int64()), ("name", pa.string()), ("last", pa.int64())])
ORDERS = pa.schema([("order_id", pa.int64()), ("deadline", pa.int64()), ("filled", pa.int64()), ("done", pa.bool_())])


class EpisodeMachine(StatefulProcessor):
    """The episodes of one bucket: their states as one table, requests that wait as tables in a list, one timer ahead.

    The timer stands one millisecond after the earliest waiting request, or where a finished episode leaves.
    """

    def __init__(self, allowed: Mapping[str, Sequence[str]], initial: str, retain_ms: int | None) -> None:
        self._allowed = {state: frozenset(targets) for state, targets in allowed.items()}
        self._initial, self._retain = initial, retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._timer = _Timer(handle)
        # episode_id, name, time of the last applied request
        self._episodes = handle.getValueState("episodes", "packed binary")
        self._waiting = handle.getListState("waiting", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        late, ahead = [], []
        for chunk in rows:
            requests = pa.Table.from_pandas(chunk, REQUESTS, preserve_index=False)
            due, held = _split(requests, passed)
            if held.num_rows:
                self._waiting.appendValue((_packed(held),))
                ahead.append(pc.min(held["ms"]).as_py() + 1)
            if due.num_rows:
                late.append(due)
        if late:
            # a late request is applied when it comes, in id order with those that the timer is about to take
            due, left = self._take_due(passed)
            states = self._states()
            yield self._apply(key, states, pa.concat_tables([due, *late]))
            self._keep(states)
            ahead += self._leave_times(states, passed).values()
        if ahead:
            self._timer.bring_forward(min(ahead))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self._timer.fired(expiredTimerInfo.getExpiryTimeInMs())
        due, left = self._take_due(passed)
        states = self._states()
        if due.num_rows:
            yield self._apply(key, states, due)
        if self._retain is not None:
            waited = set(left["episode_id"].to_pylist())
            over = lambda e, name, last: not self._allowed.get(name) and last + self._retain <= passed and e not in waited
            states = {e: (name, last) for e, (name, last) in states.items() if not over(e, name, last)}
        self._keep(states)
        ahead = list(self._leave_times(states, passed).values())
        if left.num_rows:
            ahead.append(max(pc.min(left["ms"]).as_py(), passed) + 1)
        if ahead:
            self._timer.bring_forward(min(ahead))

    def close(self) -> None:
        pass

    def _take_due(self, passed: int) -> tuple[pa.Table, pa.Table]:
        """Waiting requests whose time has passed, which leave the list, and those that go on waiting."""
        waiting = [_unpacked(packed) for (packed,) in self._waiting.get()]
        due, left = _split(pa.concat_tables([REQUESTS.empty_table(), *waiting]), passed)
        if due.num_rows:
            self._waiting.put([(_packed(left),)]) if left.num_rows else self._waiting.clear()
        return due, left

    def _states(self) -> dict[int, tuple[str, int]]:
        found = self._episodes.get()
        if found is None:
            return {}
        kept = _unpacked(found[0])
        return dict(zip(kept["episode_id"].to_pylist(), zip(kept["name"].to_pylist(), kept["last"].to_pylist())))

    def _keep(self, states: dict[int, tuple[str, int]]) -> None:
        if not states:
            self._episodes.clear()
            return
        names, lasts = zip(*states.values())
        self._episodes.update((_packed(pa.table([list(states), names, lasts], schema=EPISODES)),))

    def _apply(self, key, states: dict[int, tuple[str, int]], due: pa.Table) -> pd.DataFrame:
        due = due.sort_by([(name, "ascending") for name in ("episode_id", "transition_id", "ms", "requested")])
        of, name, last = None, self._initial, -1
        before, outcomes = [], []
        for episode, at, requested in zip(*(due[c].to_pylist() for c in ("episode_id", "ms", "requested"))):
            if episode != of:
                of = episode
                name, last = states.get(episode, (self._initial, -1))
            outcome = "repeat" if requested == name else "applied" if requested in self._allowed.get(name, ()) else "illegal"
            before.append(name)
            outcomes.append(outcome)
            name, last = requested if outcome == "applied" else name, max(last, at)
            states[episode] = name, last
        steps = due.select(["episode_id", "transition_id", "requested"]).to_pandas().rename(columns={"requested": "to_state"})
        steps.insert(2, "from_state", before)
        return _named(key, steps.assign(outcome=outcomes), "episode_id")

    def _leave_times(self, states: dict[int, tuple[str, int]], passed: int) -> dict[int, int]:
        """When the finished episodes leave the state."""
        if self._retain is None:
            return {}
        return {e: max(last + self._retain, passed + 1) for e, (name, last) in states.items() if not self._allowed.get(name)}


class OrderWatch(StatefulProcessor):
    """The orders of one bucket: earliest limit and earliest fill of each, and a timer at the first limit."""

    def __init__(self, longest: int) -> None:
        self._longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._timer = _Timer(handle)
        self._orders = handle.getValueState("orders", "packed binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = [chunk.groupby("order_id", as_index=False)[["deadline", "filled"]].min() for chunk in rows]
        yield from self._decide(key, earliest, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.fired(expiredTimerInfo.getExpiryTimeInMs())
        yield from self._decide(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _decide(self, key, fresh: list[pd.DataFrame], passed: int) -> Iterator[pd.DataFrame]:
        found = self._orders.get()
        known = (ORDERS.empty_table() if found is None else _unpacked(found[0])).to_pandas()
        decided = known.loc[known["done"], "order_id"]
        # a submission after the decision no longer moves the limit
        fresh = [f.assign(deadline=f["deadline"].mask(f["order_id"].isin(decided), NEVER), done=False) for f in fresh]
        orders = pd.concat([known, *fresh]).groupby("order_id", as_index=False).agg({"deadline": "min", "filled": "min", "done": "max"})
        sent = orders["deadline"] < NEVER
        now = ~orders["done"] & sent & ((orders["filled"] < NEVER) | (orders["deadline"] <= passed))
        in_time = orders["filled"] <= orders["deadline"]
        if now.any():
            rows = orders.assign(outcome=in_time.map({True: "filled", False: "timed_out"}), at_ms=orders["filled"].where(in_time, orders["deadline"]))
            yield _named(key, rows.loc[now, ["order_id", "outcome", "at_ms"]], "order_id")
        until = orders["deadline"].where(sent, orders["filled"].clip(upper=NEVER - self._longest) + self._longest)
        kept = orders.assign(done=orders["done"] | now)[until > passed]
        if len(kept):
            self._orders.update((_packed(pa.Table.from_pandas(kept, ORDERS, preserve_index=False)),))
            self._timer.move_to(int(until[until > passed].min()))
        else:
            self._orders.clear()
            self._timer.move_to(None)


class _Timer:
    """The one timer of a key."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._state = handle, handle.getValueState("timer", "at bigint")

    def move_to(self, at: int | None) -> None:
        found = self._state.get()
        if found is not None and found[0] != at:
            self._handle.deleteTimer(found[0])
            self._state.clear()
        if at is not None and (found is None or found[0] != at):
            self._handle.registerTimer(at)
            self._state.update((at,))

    def bring_forward(self, at: int) -> None:
        found = self._state.get()
        if found is None or at < found[0]:
            self.move_to(at)

    def fired(self, at: int) -> None:
        found = self._state.get()
        if found is not None and found[0] == at:
            self._state.clear()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _split(requests: pa.Table, passed: int) -> tuple[pa.Table, pa.Table]:
    """Requests before that time, and the others."""
    before = pc.less(requests["ms"], passed)
    return requests.filter(before), requests.filter(pc.invert(before))


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Adds `bucket` by a hash of the key; rows without one are bucket -1 and key 0, so that keys stay whole numbers."""
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return rows.withColumns({"bucket": bucket, key: F.coalesce(F.col(key), F.lit(0)).cast("bigint")})


def _named(key, rows: pd.DataFrame, name: str) -> pd.DataFrame:
    """Rows with the keys that _bucketed took away."""
    return rows.assign(**{name: None}) if key[0] < 0 else rows


def episode_steps(
    requests: DataFrame,
    *,
    allowed: Mapping[str, Sequence[str]],
    initial: str,
    delay: str = "15 minutes",
    retain_seconds: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Apply requested transitions in id order: applied, repeat, or illegal (state unchanged).

    Expects episode_id, transition_id, requested, ts. Requests may arrive out of order within the
    delay: they wait in the state until the watermark is past their time and are then applied by id,
    so the result does not depend on the micro-batches. A request later than the delay is applied when
    it comes. The state holds the current name and what waits. With `retain_seconds` an episode in a
    state without successors leaves the state when nothing has come for that time; a request after that
    would start anew, so the time must exceed the life of an episode.

    Episodes share the state of one of `buckets` by a hash of their id. A micro-batch reads and writes the
    states of the buckets in which it applies a request, so the number grows with the episodes that stay.
    """
    machine = EpisodeMachine(allowed, initial, None if retain_seconds is None else retain_seconds * 1000)
    rows = watermarked(requests, "ts", delay).withColumn("ms", F.unix_millis("ts"))
    dealt = _bucketed(rows, "episode_id", buckets).select("bucket", *REQUESTS.names, "ts")
    return dealt.groupBy("bucket").transformWithStateInPandas(machine, STEP_SCHEMA, "Append", "EventTime")


def order_timeouts(
    events: DataFrame, *, limits: Mapping[str, int] = PHASE_LIMITS, delay: str = "15 minutes", buckets: int = BUCKETS
) -> DataFrame:
    """One row per order: filled in time, or timed out at submission plus the phase limit.

    Expects order_id, kind (submitted, filled), phase, ts. Submission and fill may arrive in either
    order: the state holds the earliest of both, and an order is decided once both are known or the
    watermark passes its limit. A decided order stays marked until the watermark is past its limit,
    so that a repeat does not decide it again, and then leaves the state; so does a fill whose
    submission has not come when the longest limit has passed. Orders share the state of one of `buckets`
    by a hash of their id; a submission in a phase without a limit is an error.
    """
    caps = {phase: seconds * 1000 for phase, seconds in limits.items()}
    rows = watermarked(events, "ts", delay).withColumn("ms", F.unix_millis("ts"))
    listed = F.create_map(*[F.lit(x) for cap in caps.items() for x in cap])
    cap = F.coalesce(F.element_at(listed, F.col("phase")).cast("bigint"), F.raise_error(F.concat(F.lit("no limit for phase "), F.coalesce("phase", F.lit("null")))).cast("bigint"))
    fill, never = F.col("kind") == "filled", F.lit(NEVER).cast("bigint")
    times = {"deadline": F.when(fill, never).otherwise(F.col("ms") + cap), "filled": F.when(fill, F.col("ms")).otherwise(never)}
    dealt = _bucketed(rows, "order_id", buckets).withColumns(times).select("bucket", "order_id", "deadline", "filled", "ts")
    return dealt.groupBy("bucket").transformWithStateInPandas(OrderWatch(max(caps.values())), TIMEOUT_SCHEMA, "Append", "EventTime")
