"""Backward as-of join without a per-key scan: bucket by time, carry across buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 300
BUCKETS_PER_RUN = 288


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Add to each left row the values of the last right row at or before its instant.

    The instants are reduced to distinct ones, merged with the right rows and scanned per
    (key, time bucket), so one hot key is spread over its buckets; five minutes hold few enough rows
    to sort in one task, and denser data may name a shorter bucket. A bucket without an earlier right
    row takes the last row before it in its run of buckets, or else the last row of an earlier run.
    The last row of a bucket and of a run are aggregates that combine map-side, so the windows see one
    row per bucket of a run, and one per run of a key. Of right rows with equal instants the one with
    the greatest `ties` (by default the values) counts.
    """
    keys = list(keys)
    payload = F.struct(*values)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    tie = F.struct(*(ties or values))
    tie_kind = right.select(tie.alias("t")).schema["t"].dataType
    at = F.col("_at")

    probes = left.where(F.col(left_ts).isNotNull()).select(*keys, F.col(left_ts).alias("_at")).distinct()
    marks = probes.select(*keys, "_at", F.lit(1).alias("_probe"), F.lit(None).cast(tie_kind).alias("_tie"), F.lit(None).cast(kind).alias("_hit"))
    rows = right.where(F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).alias("_at"), F.lit(0).alias("_probe"), tie.alias("_tie"), payload.alias("_hit")
    )
    bucket = F.floor(F.unix_micros(at) / F.lit(bucket_seconds * 1_000_000)).alias("_bucket")
    merged = rows.unionByName(marks).select("*", bucket)

    inside = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_probe", "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = merged.select(*keys, "_at", "_bucket", "_probe", F.last("_hit", ignorenulls=True).over(upto).alias("_seen"))

    place = F.when(F.col("_probe") == 0, F.struct("_at", "_tie"))
    run = F.floor(F.col("_bucket") / BUCKETS_PER_RUN).alias("_run")
    ending = merged.groupBy(*keys, "_bucket").agg(F.max_by("_hit", place).alias("_closing")).select("*", run)
    in_run = Window.partitionBy(*keys, "_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    near = ending.select(*keys, "_bucket", "_run", F.last("_closing", ignorenulls=True).over(in_run).alias("_near"))
    across = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("_closing").isNotNull(), F.col("_bucket"))
    far = ending.groupBy(*keys, "_run").agg(F.max_by("_closing", full).alias("_last")).select(
        *keys, "_run", F.last("_last", ignorenulls=True).over(across).alias("_far")
    )
    carried = near.join(far, [*keys, "_run"]).select(*keys, "_bucket", F.coalesce("_near", "_far").alias("_carry"))

    found = (
        scanned.where("_probe = 1")
        .join(carried, [*keys, "_bucket"], "left")
        .select(*keys, at.alias(left_ts), F.coalesce("_seen", "_carry").alias("_found"))
    )
    kept = [c for c in left.columns if c not in (*keys, left_ts)]
    return left.join(found, [*keys, left_ts], "left").select(*keys, left_ts, *kept, *[F.col(f"_found.{v}").alias(v) for v in values])
