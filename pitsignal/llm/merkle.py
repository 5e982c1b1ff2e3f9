"""Merkle manifest of recorded evidence: leaves, group roots, the root of all, and proofs that fold back to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.session import cut_lineage

FIELDS = ("item_id", "tool", "lang", "n_chars", "content")
ARITY = 2
BLOCK_LEVELS = 10  # levels that one pass of windows climbs, so a window holds at most ARITY ** BLOCK_LEVELS rows
RUN_ROWS = 20_000  # rows aimed at in a range of the order
MAX_RUNS = 1 << 14

_PATH = "array<struct<before:string,after:string>>"


def record_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields in a row: `-` for null, else the UTF-8 byte count, `:` and the value as text."""
    coded = []
    for field in fields:
        text = field.cast("string")
        coded.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf digest leads to over the siblings of a path."""
    return F.aggregate(path, digest, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def path_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (grp, key, digest, row) with pos, their place in the group by key and digest, and n, its size.

    The order is cut into ranges that a group or an id of any size spreads over: places are counted
    within a range and begin where the group's earlier ranges end.
    """
    rows = cut_lineage(rows.withColumn("tie", F.monotonically_increasing_id()))
    runs = min(MAX_RUNS, max(1, -(-rows.count() // RUN_ROWS)))
    order = ["key", "digest", "tie"]
    dealt = cut_lineage(rows.repartitionByRange(runs, "grp", *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"))
    begins = counts.select(
        "grp",
        "part",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begin"),
        F.sum("rows").over(Window.partitionBy("grp")).alias("n"),
    )
    within = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(begins, ["grp", "part"]).select(
        "grp", (F.col("begin") + F.col("within")).alias("pos"), "n", "digest", "row"
    )


def _climb(rows: DataFrame, levels: int, arity: int) -> DataFrame:
    """Rows with block and, for each level, d{l} (the node's digest), before{l} and after{l} (its run's others).

    A node of level l stands on the row of its first leaf. Its siblings are lag and lead columns at
    multiples of arity ** l, masked by the node's slot in the run and by the group's size; the run's
    first child row hashes the parent. A group with one node left keeps it.
    """
    block = F.floor(F.col("pos") / F.lit(arity**levels)).cast("long")
    out = rows.withColumn("block", block).withColumn("d0", F.col("digest"))
    window = Window.partitionBy("grp", "block").orderBy("pos")
    for level in range(levels):
        step = arity**level
        digest = F.col(f"d{level}")
        slot = F.floor(F.col("pos") % (step * arity) / step)
        node = F.col("pos") % step == 0
        more = F.col("n") > step
        earlier = [F.when(slot >= j, F.lag(digest, j * step).over(window)).otherwise("") for j in range(arity - 1, 0, -1)]
        later = [
            F.when((slot + j < arity) & (F.col("pos") + j * step < F.col("n")), F.lead(digest, j * step).over(window)).otherwise("")
            for j in range(1, arity)
        ]
        out = out.withColumns(
            {
                f"before{level}": F.when(node & more, F.concat(*earlier)),
                f"after{level}": F.when(node & more, F.concat(*later)),
            }
        )
        parent = F.when(more, F.sha2(F.concat(digest, F.col(f"after{level}")), 256)).otherwise(digest)
        out = out.withColumn(f"d{level + 1}", F.when(node & (slot == 0), parent))
    return out


def _descend(climbed: DataFrame, levels: int, arity: int) -> DataFrame:
    """Path of every row: the steps of its own node and then its parent's path, which a lag by the slot brings."""
    out = climbed.withColumn(f"path{levels}", F.when(F.col("pos") % arity**levels == 0, F.col("given")))
    window = Window.partitionBy("grp", "block").orderBy("pos")
    for level in range(levels - 1, -1, -1):
        step = arity**level
        slot = F.floor(F.col("pos") % (step * arity) / step)
        above = F.col(f"path{level + 1}")
        parent = F.coalesce(F.when(slot == 0, above), *[F.when(slot == j, F.lag(above, j * step).over(window)) for j in range(1, arity)])
        own = F.array(F.struct(F.col(f"before{level}").alias("before"), F.col(f"after{level}").alias("after"))).cast(_PATH)
        here = F.when(F.col("n") > step, F.concat(own, parent)).otherwise(parent)
        out = out.withColumn(f"path{level}", F.when(F.col("pos") % step == 0, here))
    return out.withColumn("path", F.col("path0"))


def _tables(leaves: DataFrame, arity: int, block_levels: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The rows of every pass with the levels it climbs, and the last digest of each group (grp, top)."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    passes = [leaves]
    while largest > arity**block_levels:
        climbed = _climb(passes[-1], block_levels, arity).where(F.col("pos") % arity**block_levels == 0)
        size = F.ceil(F.col("n") / F.lit(arity**block_levels)).cast("long")
        passes.append(
            cut_lineage(climbed.select("grp", F.col("block").alias("pos"), size.alias("n"), F.col(f"d{block_levels}").alias("digest")))
        )
        largest = -(-largest // arity**block_levels)
    last = 0
    while arity**last < largest:
        last += 1
    levels = [block_levels] * (len(passes) - 1) + [last]
    tops = _climb(passes[-1], last, arity).where("pos = 0").select("grp", F.col(f"d{last}").alias("top"))
    return list(zip(passes, levels)), tops


def _paths(tables: list[tuple[DataFrame, int]], given: DataFrame, arity: int) -> DataFrame:
    """The leaves with path, subroot and root, from `given` (grp, block, given, subroot, root) of the last pass."""
    for at, (rows, levels) in reversed(list(enumerate(tables))):
        block = F.floor(F.col("pos") / F.lit(arity**levels)).cast("long")
        joined = rows.withColumn("block", block).join(given, ["grp", "block"])
        found = _descend(_climb(joined, levels, arity), levels, arity)
        if at == 0:
            return found
        given = cut_lineage(found.select("grp", F.col("pos").alias("block"), F.col("path").alias("given"), "subroot", "root"))


def seal_evidence(
    evidence: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    by: str = "tool",
    carried: Sequence[str] = (),
    arity: int = ARITY,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Manifest of evidence items: a Merkle tree per value of `by`, and one over the trees.

    Expects item_id, `by` and the columns of `fields`; `carried` names columns to return as they are (none named like an output column).
    A leaf is the record_digest of the fields. Leaves of a group ascend by item_id; while a group has
    several nodes, every `arity` consecutive ones (of the last run: those there are, even one) become
    the digest of their concatenated hex texts. What is left is the group's subroot. The subroots,
    null group first and then by UTF-8 bytes, give the root in the same way. Returns item_id, `by`,
    the carried columns, leaf, subroot, root and path (array of before and after: the hex texts of
    the run's other nodes, leaf level first); `folded(path, leaf)` equals root.

    Null ids come first, equal ids are ordered by their leaves, and repeated rows are leaves of their
    own. A null field differs from an empty one. A group of one item is its own subroot. An empty
    table gives an empty result. Other columns are ignored, whatever their name.

    Windows run over blocks of arity ** block_levels neighbouring leaves, and the blocks' digests
    form the next, much smaller table; so a hot group is spread over its blocks. Texts are read
    once; only digests are shuffled.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    digest = record_digest(*[F.col(c) for c in fields])
    row = F.struct(F.col("item_id"), F.col(by).alias("by"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carried]).alias("carried"))
    leaves = cut_lineage(_placed(evidence.select(group.alias("grp"), F.col("item_id").alias("key"), digest.alias("digest"), row.alias("row"))))
    tables, tops = _tables(leaves, arity, block_levels)
    groups = cut_lineage(
        _placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("top").alias("digest"), F.struct(F.col("grp").alias("own")).alias("row")))
    )
    group_tables, top = _tables(groups, arity, block_levels)
    start = top.select(
        "grp", F.lit(0).cast("long").alias("block"), F.array().cast(_PATH).alias("given"), F.lit(None).cast("string").alias("subroot"), F.col("top").alias("root")
    )
    over = _paths(group_tables, start, arity).select(
        F.col("row.own").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("path").alias("given"), F.col("digest").alias("subroot"), "root"
    )
    sealed = _paths(tables, cut_lineage(over), arity)
    return sealed.select(
        F.col("row.item_id").alias("item_id"),
        F.col("row.by").alias(by),
        *[F.col(f"row.carried.`{c}`").alias(c) for c in carried],
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "path",
    )
