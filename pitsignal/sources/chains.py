"""Option chain ingest: snapshot payloads, page merge, expiration window, canonical order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.functions.contracts import contract_terms, offset_timestamp
from pitsignal.schemas import DELTA, PAYLOAD_SNAPSHOT, PRICE


def flatten_snapshots(pages: DataFrame, *, keep: Sequence[str] = (), payload: str = "payload") -> DataFrame:
    """One row per contract of each page's symbol -> snapshot map.

    Contracts without a complete quote are skipped; missing greeks leave a null delta. A symbol
    that does not carry expiry, type and strike, a quote time without offset, or a page that is not
    JSON, is an error.
    """
    schema = T.StructType([T.StructField("snapshots", T.MapType(T.StringType(), PAYLOAD_SNAPSHOT))])
    entries = pages.select(*keep, F.explode(F.from_json(payload, schema, {"mode": "FAILFAST"})["snapshots"]).alias("symbol", "_snap"))
    quote = F.col("_snap.latestQuote")
    quoted = entries.where(quote["t"].isNotNull() & quote["bp"].isNotNull() & quote["ap"].isNotNull())
    expiration, option_type, strike = contract_terms(F.col("symbol"))
    return quoted.select(
        *keep,
        "symbol",
        expiration.alias("expiration"),
        option_type.alias("option_type"),
        strike.alias("strike"),
        quote["bp"].cast(PRICE).alias("bid"),
        quote["ap"].cast(PRICE).alias("ask"),
        F.col("_snap.greeks.delta").cast("decimal(38,18)").cast(DELTA).alias("delta"),
        offset_timestamp(quote["t"]).alias("quote_ts"),
    )


def latest_page(contracts: DataFrame, *, keys: Sequence[str], page: str) -> DataFrame:
    """A contract that occurs on several pages keeps its last page's row (aggregated map-side)."""
    rest = [c for c in contracts.columns if c not in keys]
    return (
        contracts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(page)).alias("_last")).select(*keys, "_last.*")
    )


def expiring_between(contracts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Both ends included."""
    return contracts.where(F.col("expiration").between(start, end))


def canonical_order(contracts: DataFrame, chain_key: str) -> DataFrame:
    """Rows of a chain sorted by expiry, type, strike; chains may stay spread over tasks."""
    return contracts.repartitionByRange(F.col(chain_key), F.col("expiration"), F.col("option_type"), F.col("strike"), F.col("symbol")).sortWithinPartitions(
        chain_key, "expiration", "option_type", "strike", "symbol"
    )


def with_position(contracts: DataFrame, chain_key: str) -> DataFrame:
    """Zero-based position of each contract inside its chain's canonical order."""
    from pyspark.sql import Window

    order = Window.partitionBy(chain_key, "expiration").orderBy("option_type", "strike", "symbol")
    sizes = contracts.groupBy(chain_key, "expiration").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(chain_key).orderBy("expiration").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(chain_key, "expiration", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        contracts.withColumn("_in_expiry", F.row_number().over(order) - 1)
        .join(offsets, [chain_key, "expiration"])
        .withColumn("position", F.col("_offset") + F.col("_in_expiry"))
        .drop("_offset", "_in_expiry")
    )
