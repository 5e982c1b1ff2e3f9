"""Weak supervision: rules vote or abstain on evidence, their error rates are learned unlabelled."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.words import text_measures
from pitsignal.session import cut_lineage

KEEP, REJECT, ABSTAIN = 1, -1, 0
VOTES = (KEEP, REJECT, ABSTAIN)


@dataclass(frozen=True)
class Rule:
    """Votes REJECT where `reject` holds, else KEEP where `keep` holds, else abstains."""

    name: str
    reject: str = "false"
    keep: str = "false"


# parameters: shares of the words, letters or lines of one text. Faults exclude each other in most texts, so
# a rule that finds one says nothing where it does not; keeping is voted for by rules that look at several.
RULES = (
    Rule("symbols", reject="n_symbols > 0.10 * n_words"),
    Rule("capitals", reject="n_upper > 0.30 * word_chars"),
    Rule("repeats", reject="n_repeat_words > 0.30 * n_words"),
    Rule("stutter", reject="n_stutter > 0.20 * n_words"),
    Rule("lines", reject="n_dup_lines > 0.50 * n_lines"),
    Rule("plain", keep="n_symbols <= 0.05 * n_words and n_upper <= 0.25 * word_chars"),
    Rule("fluent", keep="n_stutter <= 0.05 * n_words and n_repeat_words <= 0.25 * n_words"),
    Rule("sober", keep="n_symbols <= 0.05 * n_words and n_upper <= 0.25 * word_chars and n_stutter <= 0.05 * n_words"),
)
ITERATIONS = 500  # upper bound; the tolerance ends the learning
TOLERANCE = 1e-7  # change of the log likelihood a row
SMOOTHING = 1.0
MIN_WORDS, MAX_REPEAT_PCT = 50, 50


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.reject), REJECT).when(F.expr(rule.keep), KEEP).otherwise(ABSTAIN)


def _log_ratio(rules: tuple[Rule, ...], rates: dict[tuple[str, int, int], float], prior: float) -> Column:
    """Log odds of KEEP for a row of votes, given P(vote | class) of each rule."""
    total = F.lit(log(prior) - log(1 - prior))
    for rule in rules:
        weight = {v: log(rates[rule.name, KEEP, v]) - log(rates[rule.name, REJECT, v]) for v in VOTES}
        v = F.col(f"vote_{rule.name}")
        total = total + F.when(v == KEEP, weight[KEEP]).when(v == REJECT, weight[REJECT]).otherwise(weight[ABSTAIN])
    return total


def _likelihood(rules: tuple[Rule, ...], rates: dict[tuple[str, int, int], float], prior: float) -> Column:
    """Log likelihood of a row of votes under both classes."""
    sides = []
    for kind, start in ((KEEP, log(prior)), (REJECT, log(1 - prior))):
        total = F.lit(start)
        for rule in rules:
            v = F.col(f"vote_{rule.name}")
            at = {k: log(rates[rule.name, kind, k]) for k in VOTES}
            total = total + F.when(v == KEEP, at[KEEP]).when(v == REJECT, at[REJECT]).otherwise(at[ABSTAIN])
        sides.append(total)
    most = F.greatest(*sides)
    return most + F.log(F.exp(sides[0] - most) + F.exp(sides[1] - most))


def learn_rates(votes: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = ITERATIONS, tolerance: float = TOLERANCE):
    """EM over the distinct vote patterns: P(vote | class) per rule and the share of the class KEEP.

    There are at most 3^len(rules) patterns whatever the number of rows; each round is one small
    aggregation of them and returns 3 + 6 * len(rules) sums. Rounds go on until the mean log likelihood
    of a row changes by `tolerance` at most, `iterations` rounds at most. The first guess takes a pattern
    with a REJECT vote as rejected (0.9). Without rows the prior is one half and all rates are one third.
    """
    names = [f"vote_{rule.name}" for rule in rules]
    patterns = cut_lineage(votes.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")).repartition(1))
    any_reject = F.lit(False)
    for name in names:
        any_reject = any_reject | (F.col(name) == REJECT)
    keep = F.when(any_reject, 0.1).otherwise(0.9)
    rates: dict[tuple[str, int, int], float] = {}
    prior, seen, likelihood = 0.5, None, F.lit(0.0)
    for done in range(iterations):
        q = patterns.withColumn("_k", F.col("n") * keep)
        sums = [F.coalesce(F.sum("n"), F.lit(0.0)).alias("all"), F.coalesce(F.sum("_k"), F.lit(0.0)).alias("keep")]
        sums.append(F.coalesce(F.sum(F.col("n") * likelihood), F.lit(0.0)).alias("likelihood"))
        for name in names:
            for v in VOTES:
                sums.append(F.coalesce(F.sum(F.when(F.col(name) == v, F.col("_k"))), F.lit(0.0)).alias(f"k_{name}_{v}"))
                sums.append(F.coalesce(F.sum(F.when(F.col(name) == v, F.col("n"))), F.lit(0.0)).alias(f"n_{name}_{v}"))
        s = q.agg(*sums).first().asDict()
        total, kept = s["all"], s["keep"]
        # the sums of a round show how likely the rates of the round before made the votes
        if done > 1 and abs(s["likelihood"] - seen) <= tolerance * total:
            break
        seen = s["likelihood"]
        prior = (kept + SMOOTHING) / (total + 2 * SMOOTHING)
        for rule, name in zip(rules, names):
            for v in VOTES:
                k, n = s[f"k_{name}_{v}"], s[f"n_{name}_{v}"]
                rates[rule.name, KEEP, v] = (k + SMOOTHING) / (kept + 3 * SMOOTHING)
                rates[rule.name, REJECT, v] = (n - k + SMOOTHING) / (total - kept + 3 * SMOOTHING)
        keep = F.lit(1.0) / (1 + F.exp(-_log_ratio(rules, rates, prior)))
        likelihood = _likelihood(rules, rates, prior)
    return rates, prior


def accuracies(rates: dict[tuple[str, int, int], float], prior: float, rules: tuple[Rule, ...] = RULES) -> dict[str, float]:
    """Estimated share of right votes among the votes a rule casts."""
    out = {}
    for rule in rules:
        right = prior * rates[rule.name, KEEP, KEEP] + (1 - prior) * rates[rule.name, REJECT, REJECT]
        wrong = prior * rates[rule.name, KEEP, REJECT] + (1 - prior) * rates[rule.name, REJECT, KEEP]
        out[rule.name] = right / (right + wrong)
    return out


def weigh_evidence(evidence: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = ITERATIONS) -> DataFrame:
    """Posterior quality of each evidence item from voting rules, in place of all-must-pass filters.

    Expects item_id and content (the text of a recorded tool result). Returns one row per input row:
    item_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50
    words, or over half of them in repeated windows), kept (not base_failed and posterior >= 0.5),
    posterior, one vote column per rule.

    Null content counts as empty text: no words, base_failed. Repeated rows and equal ids each get
    their row. An empty table gives an empty result. Other columns are ignored, whatever their name.
    Very long texts are read whole. The measures (a few numbers a row) are checkpointed, so that the
    texts are read once for learning and scoring.
    """
    measured = text_measures(evidence)
    voted = cut_lineage(measured.select("*", *[vote(rule).alias(f"vote_{rule.name}") for rule in rules]))
    rates, prior = learn_rates(voted, rules, iterations)
    posterior = 1 / (1 + F.exp(-_log_ratio(rules, rates, prior)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return voted.select(
        "item_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (posterior >= 0.5)).alias("kept"),
        posterior.alias("posterior"),
        *[f"vote_{rule.name}" for rule in rules],
    )
