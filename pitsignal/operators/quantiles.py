"""Exact linear-interpolated quantiles of groups that do not fit one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.session import cut_lineage

_ACCURACY = 10_000
_MARGIN = 4.0 / _ACCURACY
_BINS = 256


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per group, one column per requested quantile.

    A mergeable sketch brackets each quantile, and each end moves out to the next value of the group,
    since an interpolated rank lies up to one value beside the sketch's. Values below the bracket are
    only counted, the few inside it are spread over bins of about equally many values, however they are
    spread, and ranked exactly, so no task sees a whole group; a group of any size takes this way. Equal
    values are merged before the shuffle. Where a sketch's bracket misses its rank, the groups concerned
    are ranked once more between their least and greatest value, so a result is never approximate. The
    ranked values are checkpointed (a row per group and quantile) to see whether there is such a group.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs).drop("_all")
    keys = list(keys)
    x = F.col("_v")
    present = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    names = list(probs)
    edges = [e for p in probs.values() for e in (max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0))]
    sketch = present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(x, edges, _ACCURACY).alias("_edges"),
        F.min(x).alias("_min"),
        F.max(x).alias("_max"),
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (F.lit(p) * (F.col("_n") - 1)).alias("rank"),
                (F.col("_min") if p - _MARGIN <= 0 else F.col("_edges")[2 * i]).alias("lo"),
                (F.col("_max") if p + _MARGIN >= 1 else F.col("_edges")[2 * i + 1]).alias("hi"),
            )
            for i, (name, p) in enumerate(probs.items())
        ]
    )
    sketched = sketch.select(*keys, F.explode(wanted).alias("_q")).select(*keys, "_q.*")

    counted = present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    beside = counted.join(sketched, keys).groupBy(*keys, "name", "rank", "lo", "hi").agg(
        F.max(F.when(x < F.col("lo"), x)).alias("_below"), F.min(F.when(x > F.col("hi"), x)).alias("_above")
    )
    brackets = beside.select(*keys, "name", "rank", F.coalesce("_below", "lo").alias("lo"), F.coalesce("_above", "hi").alias("hi"))
    picked = cut_lineage(_ranked(counted, brackets, keys).where(F.col("_x").isNotNull()))
    missed = sketched.select(*keys, "name", "rank").join(picked, [*keys, "name"], "left_anti")
    if missed.limit(1).count():
        ends = sketch.select(*keys, F.col("_min").alias("lo"), F.col("_max").alias("hi"))
        picked = picked.unionByName(_ranked(counted, missed.join(ends, keys), keys))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_x"))).alias(name) for name in names])


def _ranked(counted: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The interpolated value at `rank` of every (group, name), null where [lo, hi] does not hold it."""
    x = F.col("_v")
    group = [*keys, "name"]
    # edges between values of the bracket, each distinct value counted once: bins hold equally many of them
    cuts = (
        counted.join(brackets, keys)
        .where((x >= F.col("lo")) & (x <= F.col("hi")))
        .groupBy(*group)
        .agg(F.percentile_approx(x, [i / _BINS for i in range(1, _BINS)], _ACCURACY).alias("_cuts"))
    )
    placed = counted.join(brackets.join(cuts, group), keys)
    # one row (bin -1) stands for everything below the bracket; the values inside are spread over
    # bins, ranked per bin, and lifted by the counts of the bins before
    at = F.size(F.filter("_cuts", lambda cut: cut < x))
    inside = (
        placed.where(x <= F.col("hi"))
        .withColumn("_bin", F.when(x >= F.col("lo"), at).otherwise(-1))
        .withColumn("_v", F.when(F.col("_bin") >= 0, x))
        .groupBy(*group, "rank", "_bin", "_v")
        .agg(F.sum("_c").alias("_c"))
    )
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inside.groupBy(*group, "_bin").agg(F.sum("_c").alias("_size")).select(
        *group, "_bin", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    order = Window.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    running = inside.join(offsets, [*group, "_bin"]).withColumn("_upto", F.col("_offset") + F.sum("_c").over(order))
    low, high = F.floor("rank"), F.ceil("rank")
    holds = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)
    picked = running.groupBy(*keys, "name", "rank").agg(
        F.max(F.when(holds(low), x)).alias("_lo"), F.max(F.when(holds(high), x)).alias("_hi")
    )
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("rank") - F.floor("rank"))
    return picked.select(*keys, "name", "rank", value_at.cast("double").alias("_x"))
