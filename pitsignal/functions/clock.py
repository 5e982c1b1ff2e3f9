"""Wall-clock functions: session boundaries are local times, data are UTC instants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000


def minutes(wall: str) -> int:
    """'09:25' -> minutes after midnight."""
    hour, minute = wall.split(":")[:2]
    return int(hour) * 60 + int(minute)


@dataclass(frozen=True)
class SessionSpec:
    """Named wall-clock boundaries of one market session."""

    # fixed values: the frozen session timetable
    tz: str = "America/New_York"
    premarket_start: str = "04:00"
    freeze: str = "09:25"
    open: str = "09:30"
    confirm: str = "09:40"
    decision: str = "09:55"
    regular_start: str = "09:30"
    regular_end: str = "16:00"
    horizons: dict[int, str] = field(
        default_factory=lambda: {
            15: "10:10",
            30: "10:25",
            45: "10:40",
            60: "10:55",
            90: "11:25",
            120: "11:55",
        }
    )

    def boundaries(self) -> dict[str, int]:
        """Boundary name -> minutes after local midnight, for every exact price lookup."""
        named = {name: minutes(getattr(self, name)) for name in ("freeze", "open", "confirm", "decision")}
        named.update({f"h{m}": minutes(wall) for m, wall in self.horizons.items()})
        return named


def wall_to_utc(day: Column, wall: str, tz: str) -> Column:
    """Instant of a local wall time on a date, daylight saving included."""
    local = F.timestamp_add("MINUTE", F.lit(minutes(wall)), day.cast("timestamp"))
    return F.to_utc_timestamp(local, tz)


def local_date(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_micros(ts: Column, tz: str) -> Column:
    """Microseconds after local midnight, so that a boundary test is exact."""
    return F.pmod(F.unix_micros(F.from_utc_timestamp(ts, tz)), F.lit(_DAY_US))


def at_minute(micros: Column, minute: int) -> Column:
    return micros == F.lit(minute * 60_000_000)


def between_minutes(micros: Column, start: int, end: int, *, include_end: bool) -> Column:
    stop = F.lit(end * 60_000_000)
    return (micros >= F.lit(start * 60_000_000)) & ((micros <= stop) if include_end else (micros < stop))


def regular_hours(micros: Column, spec: SessionSpec) -> Column:
    """Start inclusive, end exclusive: the bar stamped at the close is not regular."""
    return between_minutes(micros, minutes(spec.regular_start), minutes(spec.regular_end), include_end=False)


def in_entry_window(ts: Column, start: str, end: str, tz: str) -> Column:
    """Local wall time inside [start, end], both ends included."""
    return between_minutes(local_micros(ts, tz), minutes(start), minutes(end), include_end=True)
