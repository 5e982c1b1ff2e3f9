"""Regularised quadratic discriminant over document statistics of evidence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.words import share, text_measures
from pitsignal.session import cut_lineage

SHRINK_POOLED = 0.2
SHRINK_SPHERE = 0.05
FLOOR = 1e-4


def transformed(evidence: DataFrame) -> DataFrame:
    """item_id and `features`: log sizes and square roots of shares, which bring skewed counts near a normal form."""
    m = text_measures(evidence)
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    features = [
        F.log1p(n),
        F.log1p(lines),
        F.log1p(share(n, lines)),
        F.log1p(share(chars, n)),
        F.sqrt(share(F.col("n_symbols"), n)),
        F.sqrt(share(F.col("n_upper"), chars)),
        F.sqrt(share(F.col("n_repeat_words"), n)),
        F.sqrt(share(F.col("n_stutter"), n)),
        F.sqrt(share(F.col("n_dup_lines"), lines)),
    ]
    return m.select("item_id", F.array(*[f.cast("double") for f in features]).alias("features"))


@dataclass(frozen=True)
class QuadraticModel:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance, its log determinant, log prior."""

    means: np.ndarray
    whiteners: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, priors included, from Mahalanobis distances."""
        logs = []
        for mean, whitener, log_det, prior in zip(self.means, self.whiteners, self.log_dets, self.log_priors):
            z = (x - mean) @ whitener.T
            logs.append(prior - 0.5 * (log_det + np.einsum("ij,ij->i", z, z)))
        return logs[1] - logs[0]


def fit(labelled: DataFrame, label: str, width: int) -> QuadraticModel | None:
    """Class moments by one aggregation of all labelled rows (features, label 0/1); None if a class is absent.

    The shrunk covariance of a class is a mix of its own, the pooled one and a sphere of the mean
    variance, so that a class of few rows or a constant statistic stays invertible.
    """
    x = [F.get("features", F.lit(i)) for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    rows = (
        labelled.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(c) for c in x]).alias("mean"),
            F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("cov"),
        )
        .collect()
    )
    found = {r["label"]: r for r in rows}
    if set(found) != {0, 1}:
        return None
    n = np.array([found[k]["n"] for k in (0, 1)], dtype=float)
    means = np.array([found[k]["mean"] for k in (0, 1)])
    covs = np.zeros((2, width, width))
    for k in (0, 1):
        for (i, j), v in zip(pairs, found[k]["cov"]):
            covs[k, i, j] = covs[k, j, i] = v
    pooled = np.tensordot(n / n.sum(), covs, axes=1)
    sphere = np.eye(width) * (np.trace(pooled) / width)
    whiteners, log_dets = [], []
    for k in (0, 1):
        own = 1 - SHRINK_POOLED - SHRINK_SPHERE
        shrunk = own * covs[k] + SHRINK_POOLED * pooled + SHRINK_SPHERE * sphere + FLOOR * np.eye(width)
        factor = np.linalg.cholesky(shrunk)
        whiteners.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return QuadraticModel(means, np.array(whiteners), np.array(log_dets), np.log(n / n.sum()))


def score_column(model: QuadraticModel | None, features: Column) -> Column:
    """Probability of label 1; one half everywhere without a model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def probability(batch: pd.Series) -> pd.Series:
        odds = model.log_odds(np.stack(batch.to_numpy()))
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -500, 500))))

    return probability(features)


def grade_evidence(evidence: DataFrame, reviews: DataFrame, *, label: str = "success", reviewed: str = "item_id") -> DataFrame:
    """Quality score of every evidence item, learned from the items whose review says so.

    `evidence`: item_id, content. `reviews`: item_id and `label` (0/1; null ignored); pass only the
    rows that may be learned from. `reviewed` names what reviews call item_id where the evidence has a
    wider key (a struct item_id that tells texts of one id apart). Returns item_id, score (0 to 1, higher means label 1 likelier),
    predicted (score >= 0.5), one row per evidence row.

    Null and empty content have zero statistics and get a score like any other. Without reviews of
    both classes every score is 0.5. Repeated evidence rows count once each in learning, like the
    reviews that name them. Other columns are ignored, whatever their name. Statistics are
    checkpointed (nine numbers a row): the texts are read once.
    """
    stats = cut_lineage(transformed(evidence))
    marks = reviews.select(F.col("item_id").alias("_item"), F.col(label).cast("int").alias("_label"))
    labelled = stats.join(marks, F.col(reviewed) == F.col("_item")).select("features", "_label")
    model = fit(labelled, "_label", 9)
    scored = stats.select("item_id", score_column(model, F.col("features")).alias("score"))
    return scored.select("item_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
