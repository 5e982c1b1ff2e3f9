from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

NY = ZoneInfo("America/New_York")


def ny(day: date, wall: str) -> datetime:
    hour, minute = map(int, wall.split(":"))
    return datetime(day.year, day.month, day.day, hour, minute, tzinfo=NY).astimezone(timezone.utc).replace(tzinfo=None)


def bar(symbol: str, ts: datetime, open_: float, close: float | None = None) -> tuple:
    close = open_ if close is None else close
    return (symbol, ts, float(open_), float(max(open_, close)), float(min(open_, close)), float(close), 1.0)


def days(start: date, n: int) -> list[date]:
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out
