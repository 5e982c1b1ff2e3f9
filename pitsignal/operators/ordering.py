"""Ordered per-key operations that split a hot key into id ranges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_RANGE = 1_000_000


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(order) / width))


def with_previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, *, width: int = ID_RANGE) -> DataFrame:
    """`lag(value)` by a unique integer order column, computed per (key, id range).

    The first row of a range takes the last value of the key's range before it, which comes from
    one row per (key, range); a key with any number of rows is never one task's work.
    """
    keys = list(keys)
    ranged = _ranged(df, order, width)
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    closing = ranged.groupBy(*keys, "_range").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_closing"))
    carry = closing.select(
        *keys, "_range", F.lag("_closing").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry")
    )
    first = F.row_number().over(inside) == 1
    stepped = ranged.withColumn("_first", first).withColumn("_lag", F.lag(value).over(inside))
    return stepped.join(carry, [*keys, "_range"]).select(
        *df.columns, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col("_lag")).alias(name)
    )


def with_sequence(df: DataFrame, keys: Sequence[str], order: str, name: str, *, width: int = ID_RANGE) -> DataFrame:
    """`row_number` from 1 by an integer order column, with range offsets from counts."""
    keys = list(keys)
    ranged = _ranged(df, order, width)
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_range"])
        .select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(name))
    )


def range_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    compose: Callable[[Column, Column], Column],
    name: str,
    *,
    width: int = 1024,
) -> DataFrame:
    """For every row the composition of the `value` of all earlier rows of its key, null for the first.

    `order` is an integer that is unique within a key. `compose(older, newer)` must be associative; it
    need not commute and has no inverse. So recurrences fit, where each row maps a running state to the
    next: the rows' maps are composed, and nothing is collected. Ids are cut into ranges of `width`;
    within one, log2(width) window steps double the rows a prefix covers, and the ranges' totals are
    scanned in the same way. A key of any size is spread over its ranges.
    """
    if width < 2:
        raise ValueError("a range must hold two ids at least")
    ends = df.agg(F.min(order).cast("bigint"), F.max(order).cast("bigint")).first()
    low, high = (ends[0], ends[1]) if ends[0] is not None else (0, 0)
    rows = df.withColumn("_v", value)
    return _scan(rows, list(keys), order, compose, name, width, low, high).select(*df.columns, name)


def _scan(
    rows: DataFrame, keys: list[str], order: str, compose: Callable[[Column, Column], Column], name: str, width: int, low: int, high: int
) -> DataFrame:
    ranged = rows.withColumn("_range", F.floor((F.col(order) - F.lit(low)) / width))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    step = 1
    while step < min(width, high - low + 1):
        ranged = ranged.withColumn("_before", F.lag("_v", step).over(inside))
        ranged = ranged.withColumn("_v", F.when(F.col("_before").isNull(), F.col("_v")).otherwise(compose(F.col("_before"), F.col("_v"))))
        step *= 2
    own = ranged.withColumn("_before", F.lag("_v").over(inside))
    if high - low < width:
        return own.withColumn(name, F.col("_before"))
    totals = ranged.groupBy(*keys, "_range").agg(F.max_by("_v", order).alias("_v")).withColumnRenamed("_range", "_at")
    carried = _scan(totals, keys, "_at", compose, "_carry", width, 0, (high - low) // width)
    carried = carried.select(*keys, F.col("_at").alias("_range"), "_carry")
    both = F.when(F.col("_before").isNull(), F.col("_carry")).when(F.col("_carry").isNull(), F.col("_before"))
    return own.join(carried, [*keys, "_range"]).withColumn(name, both.otherwise(compose(F.col("_carry"), F.col("_before"))))


def modal_value(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Most frequent value per key with its count; equal counts take the smaller value."""
    counts = df.groupBy(*keys, value.alias(name)).agg(F.count(F.lit(1)).alias("votes"))
    rank = F.struct((-F.col("votes")).alias("n"), F.col(name))
    best = counts.groupBy(*keys).agg(
        F.min_by(F.struct(name, "votes"), rank).alias("_b"), F.sum("votes").alias("total")
    )
    return best.select(*keys, "_b.*", "total")
