"""Runs of neighbouring ids: a table in id order without one task sorting it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def constant(values: list, kind: str) -> Column:
    """A literal array of any length, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def id_bounds(items: DataFrame, rows: int) -> tuple[int | None, list[int]]:
    """The least id, and ids that divide the table into runs of about `rows` rows; each is an id of the table."""
    n = items.count()
    parts = min(1 << 16, -(-n // rows))
    if parts < 2:
        return items.agg(F.min("item_id")).first()[0], []
    cuts = F.percentile_approx("item_id", [i / parts for i in range(1, parts)], F.lit(min(10 * parts, 1 << 20)))
    found = items.agg(cuts.alias("cuts"), F.min("item_id").alias("least")).first()
    return found["least"], sorted({c for c in found["cuts"] or [] if c > found["least"]})


def run_of(item_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the id, in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = constant([g[0] for g in groups], "array<bigint>")
    count = lambda array: F.size(F.filter(array, lambda b: b <= item_id))
    group = count(heads)
    inside = count(F.get(constant(groups, "array<array<bigint>>"), group - 1))
    return F.when(item_id.isNull() | (group == 0), 0).otherwise((group - 1) * width + inside)
