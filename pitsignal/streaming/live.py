"""The strictly-prior beta of a live signal as keyed state: rolling sums over the last sessions of a symbol.

Start this stream with `run_available(..., keyed=True)`: typed state needs the keyed state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pitsignal.functions.numeric import EPS
from pitsignal.schemas import require_positive
from pitsignal.streaming.run import watermarked

BETA_SCHEMA = "symbol string, session_date date, training_count bigint, beta double, expected_return double, residual double"
_COLUMNS = [field.split()[0] for field in BETA_SCHEMA.split(", ")]


class RollingBeta(StatefulProcessor):
    """One symbol: sums of the pairs of its last sessions, those sessions as list entries, and what waits.

    A session that enters adds its pair to the sums, and the one that drops out of the window takes its
    pair away, so a new row costs the same for any lookback.
    """

    def __init__(self, lookback: int) -> None:
        self._lookback = lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._sums = handle.getValueState("sums", "n bigint, sx double, sy double, sxx double, sxy double, timer bigint")
        self._window = handle.getListState("window", "at bigint, x double, y double")
        self._waiting = handle.getListState("waiting", "at bigint, x double, y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        found = [
            (at, x, y)
            for chunk in rows
            for at, x, y in zip(chunk["ms"].tolist(), chunk["driver_return"].tolist(), chunk["premarket_return"].tolist())
            if at >= passed
        ]
        if found:
            self._waiting.appendList(found)
            n, sx, sy, sxx, sxy, timer = self._sums.get() or (0, 0.0, 0.0, 0.0, 0.0, -1)
            first = min(f[0] for f in found) + 1
            if timer < 0 or first < timer:
                if timer >= 0:
                    self._handle.deleteTimer(timer)
                self._handle.registerTimer(first)
                timer = first
            self._sums.update((n, sx, sy, sxx, sxy, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        n, sx, sy, sxx, sxy, _ = self._sums.get()
        waiting = sorted(self._waiting.get(), key=lambda w: w[0])
        due = [w for w in waiting if w[0] < passed]
        left = [w for w in waiting if w[0] >= passed]
        window = list(self._window.get())
        out = []
        for at, x, y in due:
            beta = None
            spread = sxx - sx * sx / n if n else 0.0
            if len(window) >= self._lookback and n >= 2 and spread > EPS:
                beta = (sxy - sx * sy / n) / spread
            expected = beta * x if beta is not None and _real(x) else None
            residual = y - expected if expected is not None and _real(y) else None
            out.append((key[0], pd.Timestamp(at, unit="ms").date(), len(window), beta, expected, residual))
            window.append((at, x, y))
            entering = [(1, x, y)]
            if len(window) > self._lookback:
                _, old_x, old_y = window.pop(0)
                entering.append((-1, old_x, old_y))
            for sign, a, b in entering:
                if _real(a) and _real(b):
                    n, sx, sy, sxx, sxy = n + sign, sx + sign * a, sy + sign * b, sxx + sign * a * a, sxy + sign * a * b
        if due:
            self._window.put(window)
            self._waiting.put(left) if left else self._waiting.clear()
        timer = -1
        if left:
            timer = max(left[0][0] + 1, passed + 1)
            self._handle.registerTimer(timer)
        self._sums.update((n, sx, sy, sxx, sxy, timer))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"beta": "float64", "expected_return": "float64", "residual": "float64"})

    def close(self) -> None:
        pass


def _real(value: float | None) -> bool:
    return value is not None and isfinite(value)


def rolling_betas(sessions: DataFrame, *, lookback: int, delay: str = "3 days") -> DataFrame:
    """Beta, expected return and residual of every session against the `lookback` sessions before it.

    Expects symbol, session_date (unique within a symbol), driver_return, premarket_return. The streaming
    form of `episode_frame(..., full_window=True)`: a session is decided once the watermark has passed its
    day, in the order of days, so any order of arrival within the delay gives the batch rows. Until there
    are `lookback` earlier sessions beta is null. Sessions later than the delay are left out.
    """
    require_positive(beta_lookback=lookback)
    rows = watermarked(sessions.withColumn("ts", F.col("session_date").cast("timestamp")), "ts", delay)
    rows = rows.select("symbol", F.unix_millis("ts").alias("ms"), F.col("driver_return").cast("double"), F.col("premarket_return").cast("double"), "ts")
    return rows.groupBy("symbol").transformWithStateInPandas(RollingBeta(lookback), BETA_SCHEMA, "Append", "EventTime")
