"""One-permutation MinHash of evidence: hashed once, densified, stored as packed low-order bits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.llm.runs import constant, id_bounds, run_of
from pitsignal.llm.words import words

SHINGLE = 5
BINS = 128
BITS = 8  # low-order bits kept of a bin's minimum
SHIFT = 57  # 64 - log2(BINS)
PER_LONG = 64 // BITS
DIRECT = 6  # probes of an empty bin before the long search
ROWS = 2_000  # rows aimed at in a run of neighbouring ids

_TOP = [((b - BINS // 2 + 1) << SHIFT) - 1 for b in range(BINS)]  # largest value of a bin, for an empty one


def _probes() -> tuple[list[int], list[int]]:
    """For each bin an odd step and a start: start + t * step modulo BINS visits every bin once."""
    rng = random.Random(BINS)
    return [2 * rng.randrange(BINS // 2) + 1 for _ in range(BINS)], [rng.randrange(BINS) for _ in range(BINS)]


_STEP, _START = _probes()


def _bin(value: Column) -> Column:
    return F.shiftright(value, SHIFT)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: the packed fingerprint (array of BINS * BITS / 64 longs), empty for text without words.

    Shingles of five words (a shorter text is one shingle) are hashed once. Signed order puts the
    hashes bin by bin, so after one sort the first of a bin is its minimum. An empty bin copies the
    first full bin of its own probe sequence, which is the same for all texts (optimal
    densification); the sequence visits all bins, so it ends. Only column functions of the row are
    used, at a cost of n log n in the words of the text.
    """
    # internal names end in the result's name, so that two fingerprints of a row do not clash
    w, k, s, m, d = (f"_{part}_{name}" for part in ("words", "count", "sorted", "minima", "dense"))
    kept = df.columns
    df = df.select(*kept, words(F.col(text)).alias(w))
    word, n = F.col(w), F.size(w)
    shingles = F.transform(word, lambda x, i: F.xxhash64(x, *[F.get(word, i + j) for j in range(1, SHINGLE)]))
    hashes = F.when(n >= SHINGLE, F.slice(shingles, 1, F.greatest(n - (SHINGLE - 1), F.lit(1)))).otherwise(F.array(F.xxhash64(word)))
    df = df.select(*kept, n.alias(k), F.sort_array(F.concat(hashes, constant(_TOP, "array<bigint>"))).alias(s))
    ordered = F.col(s)
    first = F.filter(ordered, lambda x, i: F.coalesce(_bin(x) != _bin(F.get(ordered, i - 1)), F.lit(True)))
    df = df.select(*kept, k, first.alias(m))
    minima = F.col(m)
    top, step, start = constant(_TOP, "array<bigint>"), constant(_STEP, "array<int>"), constant(_START, "array<int>")

    def at(bin_no: Column) -> Column:
        value = F.get(minima, bin_no)
        return F.when(value != F.get(top, bin_no), value)

    def probe(bin_no: Column, t: Column) -> Column:
        return at((F.get(start, bin_no) + t * F.get(step, bin_no)) % BINS)

    def filled(_: Column, bin_no: Column) -> Column:
        near = [probe(bin_no, F.lit(t)) for t in range(DIRECT)]
        far = F.aggregate(F.sequence(F.lit(DIRECT), F.lit(BINS - 1)), F.lit(None).cast("bigint"), lambda a, t: F.coalesce(a, probe(bin_no, t)))
        return F.coalesce(at(bin_no), *near, far)

    df = df.select(*kept, k, F.transform(minima, filled).alias(d))
    dense = F.col(d)

    def packed(i: Column) -> Column:
        out = None
        for j in range(PER_LONG):
            low = F.shiftleft(F.get(dense, i * PER_LONG + j).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * j)
            out = low if out is None else out.bitwiseOR(low)
        return out

    longs = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), packed)
    return df.select(*kept, F.when(F.col(k) > 0, longs).otherwise(F.array().cast("array<bigint>")).alias(name))


def as_text(fingerprint: Column) -> Column:
    """Lower-case hexadecimal digits of a packed fingerprint."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from equal bins, corrected for chance.

    Two different minima agree in their low-order bits with probability 2^-BITS; the share of equal
    bins is corrected for that and kept within 0 and 1. Two texts without words are alike (1), one
    of them is unlike any other (0).
    """

    def differing(x: Column, y: Column) -> Column:
        # a byte's lowest bit tells whether any of its bits differ
        z = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    corrected = ((BINS - apart) / F.lit(float(BINS)) - chance) / (1 - chance)
    blank_a, blank_b = F.size(a) == 0, F.size(b) == 0
    return F.when(blank_a | blank_b, (blank_a & blank_b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))


def fingerprint_evidence(evidence: DataFrame, *, rows: int = ROWS) -> DataFrame:
    """Fingerprint of every evidence item and of its text edited with the next item's.

    Expects item_id (integer) and content. Returns item_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, one row per input row. The edited text has its last
    floor(n_chars / 2) characters replaced by the first as many of the next item in ascending
    item_id order (after the last: the first); near_edited and near_next are likenesses to the
    edited text and to the next item.

    Null content counts as empty; a text without words has an empty fingerprint. A null item_id
    comes first; rows of equal ids follow each other by their text. A table of one row is its own
    next. An empty table gives an empty result. Other columns are ignored.

    Texts are shuffled once, into runs of neighbouring ids; the row after a run's last is the first
    of the next run, which comes from one row per run.
    """
    base = evidence.select("item_id", F.coalesce("content", F.lit("")).alias("_text"))
    least, bounds = id_bounds(evidence.select("item_id"), rows)
    runs = base.select("*", run_of(F.col("item_id"), bounds).alias("_run"))
    order = Window.partitionBy("_run").orderBy(F.col("item_id").asc_nulls_first(), "_text")
    rowed = runs.select(
        "*",
        F.lead("_text").over(order).alias("_lead"),
        F.row_number().over(order).alias("_at"),
    ).withColumn("_last", F.col("_lead").isNull())
    # a run begins with its bound, the first one with the least id, or rows without one
    begins = F.col("item_id").isNull() | (F.col("item_id") == F.get(constant([least or 0, *bounds], "array<bigint>"), F.col("_run")))
    heads = runs.where(begins).groupBy("_run").agg(F.min_by("_text", F.struct("item_id", "_text")).alias("_head"))
    before = F.when(F.col("_run") == 0, len(bounds)).otherwise(F.col("_run") - 1)
    heads = with_fingerprint(heads.select(before.alias("_of"), "_head"), "_head", "_head_print")
    joined = rowed.join(heads, (F.col("_run") == F.col("_of")) & F.col("_last"), "left")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce("_lead", "_head")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(following, F.lit(1), half))
    both = joined.select("item_id", "_run", "_at", "_last", "_head_print", n.cast("long").alias("n_chars"), "_text", edited.alias("_edited"))
    both = with_fingerprint(with_fingerprint(both, "_text", "_own"), "_edited", "_other")
    narrow = both.select(
        "item_id", "_run", "_at", "_last", "_head_print", "n_chars", "_own", "_other", F.sha2("_edited", 256).alias("edited_sha256")
    )
    lead = F.lead("_own").over(Window.partitionBy("_run").orderBy("_at"))
    nexts = narrow.withColumn("_next", F.when(F.col("_last"), F.col("_head_print")).otherwise(lead))
    return nexts.select(
        "item_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
