"""Topics of evidence by its words: the likeliest of a few word distributions, learned unlabelled."""

from __future__ import annotations

from functools import reduce
from math import log
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.words import SPACES, words
from pitsignal.session import cut_lineage

TOPICS, BINS = 4, 32
SAMPLE = 4000  # rows that the SQL oracle draws in expectation; here the topics are learned from all rows
ROUNDS = 60
SCALE = 10_000  # log probabilities are whole numbers of this fraction, so sums are exact


def word_bin(word: Column) -> Column:
    """Bin of a word, hashed from its first and last letter and its length."""
    return (31 * F.ascii(word) + 17 * F.ascii(F.right(word, F.lit(1))) + F.char_length(word)) % BINS


def with_counts(evidence: DataFrame, *kept: str) -> DataFrame:
    """The columns `kept` and `counts`, an array of the words of every bin (zeros without words), one row per input row.

    Words become rows that are summed where they are made; what is exchanged is one row per text.
    """
    numbered = evidence.select(F.monotonically_increasing_id().alias("_row"), *kept, words(F.col("content")).alias("_words"))
    placed = numbered.select("_row", *kept, F.explode_outer("_words").alias("_word")).select("_row", *kept, word_bin(F.col("_word")).alias("_bin"))
    counted = placed.groupBy("_row", *kept).agg(*[F.count_if(F.col("_bin") == b).alias(f"_b{b}") for b in range(BINS)])
    return counted.select(*kept, F.array(*[f"_b{b}" for b in range(BINS)]).alias("counts"))


def count_words(counts: Column) -> Column:
    """Words of a text from its counts by bin."""
    return reduce(add, [F.get(counts, F.lit(b)) for b in range(BINS)])


def _best(values: Column) -> Column:
    """Place of the largest value, the first of equal ones."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def _tables(weights: list[list[int]]) -> Column:
    """The weights as an array of arrays by bin, one literal in the end."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{v}L" for v in row) + ")" for row in weights) + ")")


def _likeliest(counts: Column, weights: list[list[int]]) -> Column:
    """Place of the topic with the largest sum of weights over the words.

    Lambdas over arrays: a term for every topic and bin would fill the driver with expressions, be new
    code to compile for every table of weights, and too long a method for the JVM to compile further.
    """
    score = lambda row: F.aggregate(F.zip_with(counts, row, lambda n, v: n * v), F.lit(0).cast("long"), add)
    return F.get(F.transform(F.array(F.transform(_tables(weights), score)), _best), F.lit(0))


def learn_topics(evidence: DataFrame, *, topics: int = TOPICS, rounds: int = ROUNDS, counts: Column | None = None) -> list[list[int]]:
    """Log probabilities (times SCALE) of the bins in each topic.

    Learned from all rows with words: their bin counts are taken once and checkpointed (`counts` may name
    those of a checkpointed table instead). A topic without rows has equal probabilities, so it takes texts that fit none
    of the others. Each row starts in the topic of its fullest bin modulo `topics`; then a round
    estimates the bin probabilities of every topic (counts plus one) and moves each row to the topic
    that makes its words likeliest, until no count changes or `rounds` rounds are done. A round is one
    aggregation over the counts and returns topics * BINS sums.
    """
    taken = cut_lineage(with_counts(evidence)) if counts is None else evidence.select(counts.alias("counts"))
    c = F.col("counts")
    rows = taken.where(count_words(c) > 0)
    placed, before, weights = rows.withColumn("_topic", _best(c) % topics), None, []
    sums = [F.sum(F.get(c, F.lit(b))).alias(f"b{b}") for b in range(BINS)]
    for _ in range(rounds):
        found = {r["_topic"]: [r[f"b{b}"] for b in range(BINS)] for r in placed.groupBy("_topic").agg(*sums).collect()}
        if found == before:
            break
        before = found
        table = [found.get(k, [0] * BINS) for k in range(topics)]
        weights = [[round(SCALE * log((v + 1) / (sum(row) + BINS))) for v in row] for row in table]
        placed = rows.withColumn("_topic", _likeliest(c, weights))
    return weights


def topic_of(counts: Column, weights: list[list[int]]) -> Column:
    """Name of the likeliest topic of the whole text by its counts, `unclear` without words; ties go to the first."""
    if not weights:
        return F.lit("unclear")
    return F.when(count_words(counts) == 0, "unclear").otherwise(F.concat(F.lit("topic "), _likeliest(counts, weights).cast("string")))


def _likeliest_text(content: Column, weights: list[list[int]]) -> Column:
    """As _likeliest, in one pass over the words of a text that has no counts."""
    bins = F.transform(words(content), word_bin)
    tables = [F.array(*[F.lit(v).cast("long") for v in row]) for row in weights]
    names = [f"t{k}" for k in range(len(weights))]
    start = F.struct(*[F.lit(0).cast("long").alias(t) for t in names])
    step = lambda acc, b: F.struct(*[(acc[t] + F.get(table, b)).alias(t) for t, table in zip(names, tables)])
    return F.aggregate(bins, start, step, lambda acc: _best(F.array(*[acc[t] for t in names])))


def with_driver(evidence: DataFrame, weights: list[list[int]]) -> DataFrame:
    """Evidence with `driver`, the topic of its content; a column of that name is replaced.

    Null and empty contents are `unclear`; repeated rows and equal texts have one topic; an empty table
    gives an empty result. Texts are read whole, by column functions of the row.
    """
    if not weights:
        return evidence.withColumn("driver", F.lit("unclear"))
    blank = F.btrim(F.coalesce(F.col("content"), F.lit("")), F.lit(SPACES)) == ""
    topic = F.concat(F.lit("topic "), _likeliest_text(F.col("content"), weights).cast("string"))
    return evidence.withColumn("driver", F.when(blank, "unclear").otherwise(topic))
