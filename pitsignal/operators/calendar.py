"""Session tables: business days and their boundary instants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.functions.clock import SessionSpec, wall_to_utc


def business_days(span: DataFrame, start: str = "first_day", end: str = "last_day") -> DataFrame:
    """One row per Monday-to-Friday date of each [start, end] span; holidays are not known here."""
    days = span.select(F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))).alias("session_date"))
    return days.where(F.weekday("session_date") < 5)


def session_table(days: DataFrame, spec: SessionSpec) -> DataFrame:
    """Boundary instants in UTC for each session date."""
    day = F.col("session_date")
    names = {
        "premarket_start": spec.premarket_start,
        "freeze": spec.freeze,
        "open": spec.open,
        "confirm": spec.confirm,
        "decision": spec.decision,
        "regular_end": spec.regular_end,
    }
    columns = [wall_to_utc(day, wall, spec.tz).alias(f"{name}_ts") for name, wall in names.items()]
    columns += [wall_to_utc(day, wall, spec.tz).alias(f"h{m}_ts") for m, wall in spec.horizons.items()]
    return days.select("session_date", *columns)
