"""Native word columns and text measures that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the white space that separates words, and the characters counted as symbols
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
SYMBOL_PATTERN = "[#*$%&|<>]+"


def words(text: Column) -> Column:
    """Array of maximal runs of characters other than SPACES; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def share(part: Column, whole: Column) -> Column:
    """part / whole, zero for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def text_measures(evidence: DataFrame) -> DataFrame:
    """item_id and whole-text counts of `content`, one row per input row.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines
    (equal to an earlier such line), n_repeat_words (words in three-word windows found twice or
    more), n_upper (A-Z), n_stutter (words equal to the word before). Windows are compared by a
    64-bit hash of their words. Everything is a column function of the row: no shuffle, and the
    cost is n log n in the words of a text. Null content counts as empty.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    base = evidence.select("item_id", text.alias("_text")).withColumn("_words", words(F.col("_text")))
    w = F.col("_words")
    n = F.size(w)
    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = base.select(
        "item_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOL_PATTERN, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("n_stutter"),
        lines.alias("_lines"),
        F.when(n >= 3, F.slice(window, 1, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # only a text with a repeated window needs their places
    placed = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ranked = counted.withColumn("_placed", F.when(repeats, placed).otherwise(F.slice(placed, 1, 0)))
    p = F.col("_placed")

    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get(p, i - 1)["h"] == x["h"], F.get(p, i + 1)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    places = F.sort_array(F.transform(F.filter(p, repeated), lambda x: x["i"]))
    spread = ranked.withColumn("_at", places)
    at = F.col("_at")
    covered = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)))
    return spread.select(
        "item_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_stutter",
    )
