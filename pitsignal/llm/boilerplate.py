"""Site-relative line frequency: lines that too many of a tool's results contain are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.session import scratch_path

MAX_RATIO = 0.05
FLOOR = 3  # items below which a share of a small tool says nothing
SALTS = 32


def _line_hashes(content: Column) -> Column:
    """64-bit hash of each line without its outer white space; null for a line without a word."""
    return F.transform(
        F.split(F.coalesce(content, F.lit("")), "\n"),
        lambda line: F.when(line.rlike("[^\\x20\\x09-\\x0D]"), F.xxhash64(F.btrim(line, F.lit(" \t\x0b\f\r")))),
    )


def boilerplate_lines(evidence: DataFrame, *, max_ratio: float = MAX_RATIO, min_items: int = FLOOR) -> DataFrame:
    """tool and the hashes of its boilerplate lines.

    A line is boilerplate if it is in at least `min_items` items of the tool and in more than
    `max_ratio` of them. An item counts a line once. A tool has at most (lines per item) / max_ratio
    such lines. Counting combines map-side, so neither a hot tool nor a hot line is one task's work.
    """
    lines = evidence.select(
        "tool", F.explode(F.array_compact(F.array_distinct(_line_hashes(F.col("content"))))).alias("line")
    )
    counts = lines.groupBy("tool", "line").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") >= min_items)
    totals = evidence.groupBy(F.col("tool").alias("_tool")).agg(F.count(F.lit(1)).alias("total"))
    frequent = counts.join(totals, counts["tool"].eqNullSafe(totals["_tool"])).where(F.col("items") > max_ratio * F.col("total"))
    return frequent.groupBy("tool").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(evidence: DataFrame, *, max_ratio: float = MAX_RATIO, min_items: int = FLOOR) -> DataFrame:
    """Evidence without the lines that exceed the boilerplate ratio within their tool, in `min_items` items at least.

    Expects item_id, tool (the site of the text; null is a tool of its own) and content. Returns all input
    columns with content rewritten, plus n_lines and n_dropped. Lines are compared without outer
    white space; lines without a word are kept as they are. Null content stays null (n_lines 0), a
    text whose lines all go becomes empty. Repeated rows count as items of their own. An empty table
    gives an empty result. Input columns named n_lines or n_dropped are replaced.

    The list of a tool is bounded, so the join ships small rows. The lists are written first, so the
    join is planned by their size: while they fit a broadcast no text is shuffled; else the texts are
    dealt by tool and salt, so that a hot tool is spread over SALTS tasks.
    """
    spark = evidence.sparkSession
    path = scratch_path(spark, "boilerplate")
    lines = boilerplate_lines(evidence, max_ratio=max_ratio, min_items=min_items)
    lines.write.parquet(path)
    found = spark.read.schema(lines.schema).parquet(path)
    dropped = found.select(
        F.col("tool").alias("_bp_tool"), F.col("lines").alias("_bp_lines"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_bp_salt")
    )
    extra = [c for c in evidence.columns if c not in ("content", "n_lines", "n_dropped")]
    salted = evidence.withColumn("_bp_key", F.pmod(F.xxhash64("item_id", "content"), F.lit(SALTS)).cast("int"))
    joined = salted.join(dropped, salted["tool"].eqNullSafe(dropped["_bp_tool"]) & (salted["_bp_key"] == dropped["_bp_salt"]), "left")
    split = joined.withColumn("_bp_text", F.split(F.coalesce("content", F.lit("")), "\n")).withColumn("_bp_hash", _line_hashes(F.col("content")))
    marked = F.filter(
        F.arrays_zip(F.col("_bp_text").alias("t"), F.col("_bp_hash").alias("h")),
        lambda e: F.coalesce(~F.array_contains(F.col("_bp_lines"), e["h"]), F.lit(True)),
    )
    cleaned = split.withColumn("_bp_kept", F.when(F.col("_bp_lines").isNull(), F.col("_bp_text")).otherwise(F.transform(marked, lambda e: e["t"])))
    n_lines = F.when(F.col("content").isNull(), 0).otherwise(F.size("_bp_text"))
    return cleaned.select(
        *extra,
        F.when(F.col("content").isNotNull(), F.array_join("_bp_kept", "\n")).alias("content"),
        n_lines.cast("long").alias("n_lines"),
        (F.size("_bp_text") - F.size("_bp_kept")).cast("long").alias("n_dropped"),
    )
