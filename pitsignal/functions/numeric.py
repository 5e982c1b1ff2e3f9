"""Numeric column functions: masks, guarded returns, rounding, hashed uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitsignal.schemas import PRICE

EPS = 2.220446049250313e-16  # spacing of doubles at 1.0


def finite(value: Column) -> Column:
    """Null for NaN and infinities (Spark orders NaN above infinity, so one test covers all)."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def guarded_return(price: Column, base: Column) -> Column:
    """Simple return; null when a price is missing or the base is not positive."""
    return F.when(base > 0, price / base - 1)


def expected_return(beta: Column, x: Column) -> Column:
    """Slope times driver move; the intercept of the fit is left out on purpose."""
    return beta * x


def residual(y: Column, beta: Column, x: Column) -> Column:
    return y - expected_return(beta, x)


def signed_return(score: Column, forward: Column, thesis: Column | str = "continuation") -> Column:
    """sign(score) * forward, negated when the thesis is reversion; sign(0) is 0."""
    thesis = F.lit(thesis) if isinstance(thesis, str) else thesis
    return F.signum(score) * forward * F.when(thesis == "reversion", -1.0).otherwise(1.0)


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Null when the spread is degenerate or not finite."""
    return F.when(finite(std) > EPS, (value - mean) / std)


def gated(score: Column, threshold: Column, signed: Column) -> Column:
    return F.when(F.abs(score) >= threshold, signed)


def bps(value: Column) -> Column:
    return F.round(value * 10000, 2)


def cents_half_up(value: Column) -> Column:
    """Decimal rounding to cents, ties away from zero."""
    return F.round(value.cast(PRICE), 2)


def truncate_cents(value: Column) -> Column:
    """Decimal truncation towards zero at two digits."""
    scaled = value.cast(PRICE) * 100
    return (F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / 100).cast("decimal(18,2)")


def quote_quantum(value: Column) -> Column:
    """A quote in whole cents, never below one cent."""
    return F.greatest(F.lit(0.01), F.round(value, 2)).cast(PRICE)


def relative_spread(bid: Column, ask: Column) -> Column:
    """(ask - bid) / midpoint; null for zero, negative and crossed quotes."""
    return F.when((bid > 0) & (ask > 0) & (ask >= bid), (ask - bid) * 2 / (ask + bid))


def _hash_text(*parts: object) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]).cast("binary"))


def _hash_segment(digest: Column, segment: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * segment, 8), 16, 10).cast("bigint")


def hash_digest(*parts: object) -> Column:
    """md5 of the parts; carries four independent 32-bit draws (segments 0..3)."""
    return _hash_text(*parts)


def hash_uniform(digest: Column, segment: int = 0) -> Column:
    """Uniform in [0, 1) that depends on the row's own keys only, so a lost task redraws the same."""
    return _hash_segment(digest, segment) / F.lit(4294967296.0)


def hash_index(digest: Column, size: Column, segment: int = 0) -> Column:
    """Uniform index in 0 .. size-1."""
    return F.pmod(_hash_segment(digest, segment), size.cast("bigint"))


# Coefficients of the rational approximation 26.2.17 in Abramowitz and Stegun,
# Handbook of Mathematical Functions (absolute error below 7.5e-8).
_CDF_P = 0.2316419
_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    t = 1.0 / (1.0 + _CDF_P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(_CDF_B):
        poly = (poly + b) * t
    tail = F.exp(-x * x / 2.0) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)
