"""Fixed table schemas and the guards that reject frames which do not fit them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)
DELTA = T.DecimalType(9, 6)
MONEY = T.DecimalType(18, 2)

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

# provider payload of one bar: short keys, the timestamp still a string
PAYLOAD_BAR = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("o", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("l", T.DoubleType()),
        T.StructField("c", T.DoubleType()),
        T.StructField("v", T.DoubleType()),
    ]
)

# provider payload of one option snapshot; prices are read as text so no digit is lost
PAYLOAD_SNAPSHOT = T.StructType(
    [
        T.StructField(
            "latestQuote",
            T.StructType(
                [
                    T.StructField("t", T.StringType()),
                    T.StructField("bp", T.StringType()),
                    T.StructField("ap", T.StringType()),
                ]
            ),
        ),
        T.StructField("greeks", T.StructType([T.StructField("delta", T.StringType())])),
    ]
)

CHAIN = T.StructType(
    [
        T.StructField("chain_id", T.StringType()),
        T.StructField("underlying", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("expiration", T.DateType()),
        T.StructField("strike", PRICE),
        T.StructField("option_type", T.StringType()),
        T.StructField("bid", PRICE),
        T.StructField("ask", PRICE),
        T.StructField("delta", DELTA),
        T.StructField("quote_ts", T.TimestampType()),
    ]
)

DECISION = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("idiosyncratic_news_detected", T.BooleanType()),
        T.StructField("driver", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def _stamps(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.TimestampType()) for name in names]


_SINGLETON = T.StructType([*_strings("episode_id", "payload_json"), *_stamps("created_at")])

# the seven tables of the decision and order ledger
LEDGER: dict[str, T.StructType] = {
    "episodes": T.StructType(
        [
            *_strings("episode_id"),
            T.StructField("session_date", T.DateType()),
            *_strings("underlying", "state"),
            *_stamps("created_at", "updated_at"),
        ]
    ),
    "transitions": T.StructType(
        [
            T.StructField("transition_id", T.LongType()),
            *_strings("episode_id", "from_state", "to_state", "event", "payload_json"),
            *_stamps("created_at"),
        ]
    ),
    "features": _SINGLETON,
    "agent_decisions": _SINGLETON,
    "risk_decisions": _SINGLETON,
    "orders": T.StructType(
        [
            T.StructField("order_id", T.LongType()),
            *_strings("episode_id", "client_order_id", "broker_order_id", "status", "payload_json"),
            *_stamps("created_at", "updated_at"),
        ]
    ),
    "marks": T.StructType(
        [
            T.StructField("mark_id", T.LongType()),
            *_strings("episode_id"),
            *_stamps("marked_at"),
            *_strings("value", "payload_json"),
        ]
    ),
}


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def require_positive(**sizes: float) -> None:
    bad = sorted(name for name, size in sizes.items() if size <= 0)
    if bad:
        raise ValueError(f"must be positive: {bad}")


def require_increasing(values: Sequence[float], contains: Iterable[float] = ()) -> None:
    if not values or any(v <= 0 for v in values):
        raise ValueError("thresholds must be given and positive")
    if any(b <= a for a, b in zip(values, values[1:])):
        raise ValueError("thresholds must be strictly increasing")
    absent = sorted(set(contains) - set(values))
    if absent:
        raise ValueError(f"threshold grid must contain {absent}")
