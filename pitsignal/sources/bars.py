"""Bar ingest: scan, normalise, audit duplicates, flatten provider payloads, cache with manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.schemas import BARS, PAYLOAD_BAR, require_columns

_VALUES = ("open", "high", "low", "close", "volume")


def scan_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan with the fixed schema; filters on symbol and ts reach the files."""
    return spark.read.schema(BARS).format(fmt).load(path)


def normalize_bars(records: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    """Typed bars from loose records: UTC instants and doubles, failing on text that is neither.

    An offset in the text is honoured, text without one is UTC. NaN becomes null. An empty input
    gives an empty frame of the same schema.
    """
    require_columns(records, ("symbol", ts, *_VALUES), "bar records")
    kind = records.schema[ts].dataType
    instant = F.to_timestamp(F.col(ts)) if isinstance(kind, T.StringType) else F.col(ts).cast("timestamp")
    # raise_error keeps the failure independent of the session's ANSI setting
    checked_ts = F.when(
        F.col(ts).isNotNull() & instant.isNull(), F.raise_error(F.concat(F.lit("bad bar timestamp: "), F.col(ts).cast("string")))
    ).otherwise(instant)
    columns = []
    for name in _VALUES:
        number = F.col(name).try_cast("double")
        checked = F.when(
            F.col(name).isNotNull() & number.isNull(),
            F.raise_error(F.concat(F.lit(f"bad bar {name}: "), F.col(name).cast("string"))),
        ).otherwise(number)
        columns.append(F.when(F.isnan(checked), None).otherwise(checked).cast("double").alias(name))
    return records.select("symbol", checked_ts.cast("timestamp").alias("ts"), *columns)


def _versions(bars: DataFrame) -> DataFrame:
    """Rows per distinct bar version: copies collapse before the shuffle, however many there are."""
    return bars.groupBy("symbol", "ts", *_VALUES).agg(F.count(F.lit(1)).alias("copies"))


def conflicting_bars(bars: DataFrame) -> DataFrame:
    """Quarantine table: (symbol, ts) that occur with different values."""
    return (
        _versions(bars)
        .groupBy("symbol", "ts")
        .agg(F.sum("copies").alias("row_count"), F.count(F.lit(1)).alias("version_count"))
        .where("version_count > 1")
    )


def collapse_duplicates(bars: DataFrame, *, strict: bool = True) -> DataFrame:
    """One row per (symbol, ts). Copies collapse; a conflict raises, or is left out when not strict."""
    first = lambda name: F.first(name).alias(name)
    single = (
        _versions(bars)
        .groupBy("symbol", "ts")
        .agg(*[first(name) for name in _VALUES], F.count(F.lit(1)).alias("_versions"))
    )
    if not strict:
        return single.where("_versions = 1").drop("_versions")
    message = F.concat(F.lit("conflicting duplicate bar: "), F.col("symbol"), F.lit(" "), F.col("ts").cast("string"))
    # the guard is a filter, which no choice of columns and no count can leave out
    return single.where(F.assert_true(F.col("_versions") == 1, message).isNull()).drop("_versions")


# a broken page is an error
_FAIL = {"mode": "FAILFAST"}


def flatten_bar_payload(pages: DataFrame, payload: str = "payload", symbol: str | None = None) -> DataFrame:
    """Bars from provider pages: `bars` is a map symbol -> array, or a bare array for one symbol.

    A page that is not JSON raises; it is never left out silently.
    """
    if symbol is None:
        schema = T.StructType([T.StructField("bars", T.MapType(T.StringType(), T.ArrayType(PAYLOAD_BAR)))])
        per_symbol = pages.select(F.explode(F.from_json(payload, schema, _FAIL)["bars"]).alias("symbol", "_bars"))
    else:
        schema = T.StructType([T.StructField("bars", T.ArrayType(PAYLOAD_BAR))])
        per_symbol = pages.select(F.col(symbol).alias("symbol"), F.from_json(payload, schema, _FAIL)["bars"].alias("_bars"))
    bar = per_symbol.select("symbol", F.explode("_bars").alias("_bar"))
    return bar.select(
        "symbol",
        F.to_timestamp("_bar.t").alias("ts"),
        F.col("_bar.o").alias("open"),
        F.col("_bar.h").alias("high"),
        F.col("_bar.l").alias("low"),
        F.col("_bar.c").alias("close"),
        F.col("_bar.v").alias("volume"),
    )


def cache_manifest(bars: DataFrame, *, provider: str, asset_class: str, feed: str, start: str, end: str) -> DataFrame:
    """What was requested and what came, per symbol."""
    return bars.groupBy("symbol").agg(
        F.lit(provider).alias("provider"),
        F.lit(asset_class).alias("asset_class"),
        F.lit(feed).alias("feed"),
        F.lit(start).alias("requested_start"),
        F.lit(end).alias("requested_end"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def write_bar_cache(bars: DataFrame, path: str, *, asset_class: str, ranges: int | None = None) -> None:
    """Partition by class, symbol and month; inside, files hold disjoint ranges of (symbol, instant).

    Ranges are cut by the rows themselves, so a month of a hot symbol is many tasks and many files, and
    the statistics of a file let a filter on ts skip it. `ranges` is the number of ranges; by default
    the session's shuffle partitions, of which small neighbours are joined.
    """
    keys = ("symbol", "ts")
    dealt = bars.repartitionByRange(*keys) if ranges is None else bars.repartitionByRange(ranges, *keys)
    (
        dealt.withColumn("asset_class", F.lit(asset_class))
        .withColumn("month", F.date_format("ts", "yyyy-MM"))
        .sortWithinPartitions(*keys)
        .write.mode("append")
        .partitionBy("asset_class", "symbol", "month")
        .parquet(path)
    )


def read_bar_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache with its partition columns; symbol filters prune folders."""
    schema = T.StructType(
        [f for f in BARS.fields if f.name != "symbol"]
        + [T.StructField(n, T.StringType()) for n in ("asset_class", "symbol", "month")]
    )
    return spark.read.schema(schema).parquet(path)


def history_window(bars: DataFrame, session_date: str, *, days: int, cutoff: str, tz: str) -> DataFrame:
    """Bars a feature of one session may read: [date - days, cutoff], as a range on ts.

    The bounds are literals, so the range is pushed into the Parquet scan.
    """
    day = F.lit(session_date).cast("date")
    hour, minute = cutoff.split(":")[:2]
    end = F.to_utc_timestamp(F.timestamp_add("MINUTE", F.lit(int(hour) * 60 + int(minute)), day.cast("timestamp")), tz)
    start = F.to_utc_timestamp(F.date_sub(day, days).cast("timestamp"), tz)
    return bars.where((F.col("ts") >= start) & (F.col("ts") <= end))
