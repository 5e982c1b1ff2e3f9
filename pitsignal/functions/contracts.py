"""Option contract functions: symbol parsing, quote age, delta windows, direction mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitsignal.schemas import PRICE

# fixed values: the 15-character tail of an OCC symbol is yymmdd, C or P, strike * 1000
OCC_TAIL = r"(\d{6})([CP])(\d{8})$"
# fixed value: a timestamp text must end in an offset
OFFSET_TAIL = r"(Z|[+-]\d{2}:?\d{2})$"


def contract_terms(symbol: Column) -> tuple[Column, Column, Column]:
    """(expiration, option type, strike) of an OCC symbol; another text is an error."""
    parsed = symbol.rlike(OCC_TAIL)
    safe = F.when(parsed, symbol).otherwise(
        F.raise_error(F.concat(F.lit("unsupported option symbol: "), symbol)).cast("string")
    )
    expiration = F.to_date(F.regexp_extract(safe, OCC_TAIL, 1), "yyMMdd")
    option_type = F.when(F.regexp_extract(safe, OCC_TAIL, 2) == "C", "call").otherwise("put")
    strike = (F.regexp_extract(safe, OCC_TAIL, 3).cast("decimal(18,0)") / 1000).cast(PRICE)
    return expiration, option_type, strike


def offset_timestamp(text: Column) -> Column:
    """ISO-8601 instant; text without an offset is an error."""
    message = F.concat(F.lit("timestamp without offset: "), text)
    return F.when(text.isNull() | text.rlike(OFFSET_TAIL), F.to_timestamp(text)).otherwise(
        F.raise_error(message).cast("timestamp")
    )


def has_offset(text: Column) -> Column:
    return text.rlike(OFFSET_TAIL)


def days_to_expiry(expiration: Column, now: Column) -> Column:
    return F.datediff(expiration, now.cast("date"))


def age_seconds(quote_ts: Column, now: Column) -> Column:
    """Negative for a quote from the future."""
    return (F.unix_micros(now) - F.unix_micros(quote_ts)) / F.lit(1_000_000)


def age_in_limit(quote_ts: Column, now: Column, limit: int) -> Column:
    micros = F.unix_micros(now) - F.unix_micros(quote_ts)
    return micros.between(F.lit(0), F.lit(limit * 1_000_000))


def direction(action: Column, residual_sign: Column) -> Column:
    """bullish or bearish; null for an abstaining action or a sign that is neither +1 nor -1."""
    effective = F.when(action == "continuation", residual_sign).when(action == "reversion", -residual_sign)
    return F.when(effective == 1, "bullish").when(effective == -1, "bearish")


def option_type_for(direction_: Column) -> Column:
    return F.when(direction_ == "bullish", "call").when(direction_ == "bearish", "put")


def structure_for(option_type: Column) -> Column:
    return F.concat(option_type, F.lit("_debit_spread"))
