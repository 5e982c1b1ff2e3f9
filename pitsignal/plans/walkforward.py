"""Walk-forward evaluation: expanding folds, selection inside each fold, control, verdict."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.functions.numeric import finite, gated, zscore
from pitsignal.operators.metrics import summarize
from pitsignal.schemas import require_columns, require_positive
from pitsignal.session import cut_lineage


@dataclass(frozen=True)
class WalkForwardConfig:
    # fixed values: frozen defaults of the evaluation; their JSON is the hashed identity of a run
    min_train: int = 60
    test_size: int = 20
    min_total_signals: int = 20
    beta_lookbacks: tuple[int, ...] = (10, 20, 40)
    thresholds: tuple[float, ...] = (0.5, 1.0, 1.5)
    normalizations: tuple[str, ...] = ("raw", "zscore")
    theses: tuple[str, ...] = ("continuation", "reversion")
    horizons: tuple[str, ...] = ("forward_30m_return", "forward_60m_return")
    friction_bps: tuple[int, ...] = (0, 25, 50, 100)

    def __post_init__(self) -> None:
        require_positive(test_size=self.test_size)
        if self.min_train <= 1:
            raise ValueError("min_train must exceed 1")

    def canonical_json(self, min_total_signals: str | None = None) -> str:
        text = json.dumps(asdict(self), sort_keys=True)
        if min_total_signals is not None:
            text = text.replace(f'"min_total_signals": {self.min_total_signals}', f'"min_total_signals": {min_total_signals}')
        return text

    def config_hash(self) -> str:
        return hashlib.sha256(self.canonical_json().encode()).hexdigest()[:16]

    def config_hash_column(self, min_total_signals: Column) -> Column:
        """The same hash when the signal floor comes out of the data."""
        before, after = self.canonical_json("\0").split("\0")
        text = F.concat(F.lit(before), min_total_signals.cast("string"), F.lit(after))
        return F.substring(F.sha2(text, 256), 1, 16)

    def level(self, normalization: str, threshold: float) -> float:
        """Raw thresholds are percent points, z thresholds are sigmas."""
        return threshold / 100.0 if normalization == "raw" else threshold


def clean_frames(frames: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """Finite rows of the lookbacks to evaluate, with `lookbacks`, the set of them.

    A symbol's lookbacks are the configured ones that its frame has; a frame with none of them is
    evaluated over all it has. They are found in the frame before unusable rows are dropped.
    """
    needed = ["symbol", "lookback", "session_date", "residual", *config.horizons]
    require_columns(frames, needed, "walk-forward frames")
    numeric = ["residual", *config.horizons]
    present = F.sort_array(F.collect_set("lookback").over(Window.partitionBy("symbol")))
    wanted = F.array(*[F.lit(k) for k in sorted(set(config.beta_lookbacks))])
    configured = F.filter("_present", lambda k: F.array_contains(wanted, k))
    return (
        frames.withColumn("_present", present)
        .withColumn("lookbacks", F.when(F.size(configured) > 0, configured).otherwise(F.col("_present")))
        .where(F.array_contains("lookbacks", F.col("lookback")))
        .select("symbol", "lookback", "session_date", *[finite(F.col(c)).alias(c) for c in numeric], "lookbacks")
        .dropna(subset=numeric)
    )


def common_sessions(clean: DataFrame) -> DataFrame:
    """Dates present for every lookback of the symbol's frame, numbered per symbol from 1."""
    shared = (
        clean.groupBy("symbol", "session_date")
        .agg(F.count_distinct("lookback").alias("_k"), F.max(F.size("lookbacks")).alias("_all"))
        .where(F.col("_k") == F.col("_all"))
    )
    order = Window.partitionBy("symbol").orderBy("session_date")
    return shared.select("symbol", "session_date", F.row_number().over(order).alias("session_rank"))


def expanding_folds(sessions: DataFrame, *, min_train: int, test_size: int) -> DataFrame:
    """Train on the first k sessions, test on the next m, then k += m; no partial last fold."""
    if min_train <= 1:
        raise ValueError("min_train must exceed 1")
    require_positive(test_size=test_size)
    sized = sessions.groupBy("symbol").agg(F.max("session_rank").alias("_n")).where(F.col("_n") >= min_train + test_size)
    ends = F.sequence(F.lit(min_train), (F.col("_n") - test_size).cast("int"), F.lit(test_size))
    bounds = sized.select("symbol", F.posexplode(ends).alias("fold_id", "train_end_rank")).withColumn(
        "test_end_rank", F.col("train_end_rank") + test_size
    )
    member = sessions.join(bounds, "symbol").where(F.col("session_rank") <= F.col("test_end_rank"))
    in_train = F.col("session_rank") <= F.col("train_end_rank")
    day = F.col("session_date")
    return member.groupBy("symbol", "fold_id", "train_end_rank", "test_end_rank").agg(
        F.min(F.when(in_train, day)).alias("train_start"),
        F.max(F.when(in_train, day)).alias("train_end"),
        F.min(F.when(~in_train, day)).alias("test_start"),
        F.max(F.when(~in_train, day)).alias("test_end"),
    )


def fold_rows(clean: DataFrame, sessions: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold with their role and the fold's train-only mean and deviation.

    Window and later aggregations share the key (symbol, fold, lookback), hence one shuffle.
    """
    ranked = clean.join(sessions, ["symbol", "session_date"])
    bounds = folds.select("symbol", "fold_id", "train_end_rank", "test_end_rank")
    member = ranked.join(bounds, "symbol").where(F.col("session_rank") <= F.col("test_end_rank"))
    is_train = F.col("session_rank") <= F.col("train_end_rank")
    group = Window.partitionBy("symbol", "fold_id", "lookback")
    train_residual = F.when(F.col("is_train"), F.col("residual"))
    return (
        member.withColumn("is_train", is_train)
        .withColumn("train_mean", F.avg(train_residual).over(group))
        .withColumn("train_std", F.stddev_samp(train_residual).over(group))
        .withColumn("zscore", zscore(F.col("residual"), F.col("train_mean"), F.col("train_std")))
        .drop("train_end_rank", "test_end_rank", "train_mean", "train_std", "lookbacks")
    )


# normalization -> the column of the fold rows that holds its score
SCORES = {"raw": "residual", "zscore": "zscore"}


def score_candidates(rows: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """Train count, mean and median of every configuration of the grid, per fold.

    One aggregation with conditional measures instead of one row per configuration. A reversion
    return is the negated continuation return, so both theses come from the same measures.
    `grid_order` is the position in the order lookback, thesis, normalization, threshold, horizon.
    """
    shapes = [(n, config.level(n, t), h) for n in config.normalizations for t in config.thresholds for h in config.horizons]
    measures = []
    for i, (norm, level, horizon) in enumerate(shapes):
        value = SCORES[norm]
        signed = f"CASE WHEN abs({value}) >= {level}D THEN signum({value}) * {horizon} END"
        measures += [F.expr(f"count({signed}) AS _n{i}"), F.expr(f"avg({signed}) AS _a{i}"), F.expr(f"percentile({signed}, 0.5) AS _m{i}")]
    train = rows.where("is_train").groupBy("symbol", "fold_id", "lookback").agg(*measures)
    entries = []
    for k, thesis in enumerate(config.theses):
        flip = "-1D" if thesis == "reversion" else "1D"
        for i, (norm, level, horizon) in enumerate(shapes):
            entries.append(
                f"struct('{thesis}' AS thesis, '{norm}' AS normalization, {level}D AS threshold, '{horizon}' AS horizon, "
                f"{k * len(shapes) + i} AS inner_order, _n{i} AS train_count, _a{i} * {flip} + 0D AS train_mean, _m{i} * {flip} + 0D AS train_median)"
            )
    return (
        train.selectExpr("symbol", "fold_id", "lookback", f"explode(array({', '.join(entries)})) AS _c")
        .selectExpr("symbol", "fold_id", "lookback", "_c.*", f"lookback * {len(entries)} + _c.inner_order AS grid_order")
        .drop("inner_order")
    )


def select_configs(candidates: DataFrame, folds: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """Per fold the largest (median, mean, count) with two signals at least; the first grid entry
    wins ties, and a fixed entry of the smallest lookback at hand stands in when nothing qualifies."""
    chosen = F.struct("lookback", "thesis", "normalization", "threshold", "horizon")
    rank = F.struct("train_median", "train_mean", "train_count", (-F.col("grid_order")).alias("first"))
    enough = F.when(F.col("train_count") >= 2, rank)
    best = candidates.groupBy("symbol", "fold_id").agg(F.max_by(chosen, enough).alias("_best"), F.min("lookback").alias("_least"))
    fallback = F.struct(
        F.coalesce("_least", F.lit(min(config.beta_lookbacks))).alias("lookback"),
        F.lit("reversion").alias("thesis"),
        F.lit("raw").alias("normalization"),
        F.lit(config.level("raw", config.thresholds[0])).cast("double").alias("threshold"),
        F.lit("forward_30m_return").alias("horizon"),
    )
    return (
        folds.join(best, ["symbol", "fold_id"], "left")
        .select("symbol", "fold_id", F.coalesce("_best", fallback).alias("_best"))
        .select("symbol", "fold_id", "_best.*")
    )


def test_signals(rows: DataFrame, selected: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """Out-of-sample signed returns under each fold's own selection."""
    test = rows.where("not is_train").join(selected, ["symbol", "fold_id", "lookback"])
    value = F.coalesce(*[F.when(F.col("normalization") == n, F.col(c)) for n, c in SCORES.items()])
    forward = F.coalesce(*[F.when(F.col("horizon") == h, F.col(h)) for h in config.horizons])
    signed = F.signum(value) * forward * F.when(F.col("thesis") == "reversion", -1.0).otherwise(1.0)
    return (
        test.select("symbol", "fold_id", "session_date", gated(value, F.col("threshold"), signed).alias("signed_return"))
        .where(F.col("signed_return").isNotNull())
    )


def fold_results(folds: DataFrame, selected: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per fold, folds without a signal included."""
    stats = summarize(signals, ["symbol", "fold_id"], "signed_return").select(
        "symbol", "fold_id", F.col("count").alias("signal_count"), "mean", "median", "hit_rate"
    )
    zero = {"signal_count": 0, "mean": 0.0, "median": 0.0, "hit_rate": 0.0}
    return (
        folds.drop("train_end_rank", "test_end_rank")
        .join(selected, ["symbol", "fold_id"])
        .join(stats, ["symbol", "fold_id"], "left")
        .fillna(zero)
    )


@dataclass(frozen=True)
class WalkForward:
    """The lazily evaluated tables of one evaluation."""

    sessions: DataFrame
    folds: DataFrame
    candidates: DataFrame
    selected: DataFrame
    signals: DataFrame
    results: DataFrame
    signals_of: Callable[[DataFrame], DataFrame]

    def settled(self) -> WalkForward:
        """The same tables with the selection and the test signals checkpointed: one row per fold or
        signal, and several later tables read them."""
        selected = cut_lineage(self.selected)
        signals = cut_lineage(self.signals_of(selected))
        return replace(self, selected=selected, signals=signals, results=fold_results(self.folds, selected, signals))


def walk_forward(frames: DataFrame, config: WalkForwardConfig, *, cut: bool = True) -> WalkForward:
    """Evaluate every symbol of the frame, the control series among them, in one plan.

    The cleaned frame is read by sessions, folds and rows. It has one row per (symbol, lookback,
    session), so it is checkpointed once (`cut`) instead of rebuilding the episodes from bars; a
    caller that has checkpointed its frames passes False.
    """
    clean = clean_frames(frames, config)
    if cut:
        clean = cut_lineage(clean)
    sessions = common_sessions(clean)
    folds = expanding_folds(sessions, min_train=config.min_train, test_size=config.test_size)
    rows = fold_rows(clean, sessions, folds)
    candidates = score_candidates(rows, config)
    selected = select_configs(candidates, folds, config)

    def signals_of(chosen: DataFrame) -> DataFrame:
        return test_signals(rows, chosen, config)

    signals = signals_of(selected)
    return WalkForward(sessions, folds, candidates, selected, signals, fold_results(folds, selected, signals), signals_of)


def pooled_summary(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """Summary of all test returns per symbol; symbols without a signal have zeros."""
    symbols = frames.select("symbol").distinct()
    return summarize(symbols.join(signals, "symbol", "left"), ["symbol"], "signed_return")


def evaluate(frames: DataFrame, config: WalkForwardConfig, *, control: str | None) -> tuple[WalkForward, DataFrame]:
    """The evaluation tables and the verdict table with its checks, one row per symbol."""
    kept = cut_lineage(frames)
    run = walk_forward(kept, config, cut=False).settled()
    checks = promotion_checks(pooled_summary(kept, run.signals), run.results, config, control=control)
    return run, verdicts(checks)


# fixed values: names and order of the promotion checks
CHECKS = (
    "multiple_positive_folds",
    "enough_episodes",
    "positive_mean",
    "friction_survives",
    "not_single_episode_driven",
    "control_not_equally_strong",
)


def promotion_checks(
    pooled: DataFrame, results: DataFrame, config: WalkForwardConfig, *, control: str | None, min_signals: Column | None = None
) -> DataFrame:
    """The six checks per symbol; the control's own row is dropped and its mean is a scalar subquery."""
    positive = results.groupBy("symbol").agg(
        F.count(F.when(F.col("mean") > 0, 1)).alias("positive_folds"), F.count(F.lit(1)).alias("fold_count")
    )
    table = pooled.join(positive, "symbol", "left").fillna({"positive_folds": 0, "fold_count": 0})
    control_mean = pooled.where(F.col("symbol") == control).select("mean").scalar() if control else F.lit(None).cast("double")
    table = table.withColumn("control_mean", control_mean)
    if control:
        table = table.where(F.col("symbol") != control)
    mean, n = F.col("mean"), F.col("count")
    friction = max(config.friction_bps, default=0) / 10_000.0
    floor = min_signals if min_signals is not None else F.lit(config.min_total_signals)
    conditions = (
        F.col("positive_folds") >= 2,
        n >= floor,
        mean > 0,
        mean > friction,
        (n > 1) & (F.col("loo_max_mean_impact") <= F.greatest(F.abs(mean), F.lit(0.001))),
        F.col("control_mean").isNull() | (mean <= 0) | (F.col("control_mean") < mean * 0.75),
    )
    return table.select(
        "symbol",
        n.alias("total_signals"),
        mean.alias("mean_test_return"),
        "control_mean",
        "loo_max_mean_impact",
        "fold_count",
        *[c.alias(name) for name, c in zip(CHECKS, conditions)],
    )


def verdicts(checks: DataFrame) -> DataFrame:
    """GO when every check holds; KILL when the control is as strong or the basics fail; else MUTATE."""
    everything = F.forall(F.array(*[F.col(c) for c in CHECKS]), lambda c: c)
    basics = F.col("multiple_positive_folds") & F.col("positive_mean")
    verdict = (
        F.when(~F.col("control_not_equally_strong"), "KILL").when(everything, "GO").when(basics, "MUTATE").otherwise("KILL")
    )
    as_map = F.create_map(*[x for c in CHECKS for x in (F.lit(c), F.col(c))])
    return checks.withColumn("checks", as_map).withColumn("verdict", verdict)


def overall_verdict(table: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: GO / KILL when all required symbols agree, KILL when the set differs, else MUTATE."""
    wanted = F.col("symbol").isin(list(required))
    agg = table.agg(
        F.count_distinct(F.when(wanted, F.col("symbol"))).alias("_have"),
        F.count(F.when(~wanted, 1)).alias("_extra"),
        F.coalesce(F.bool_and(F.col("verdict") == "GO"), F.lit(False)).alias("_go"),
        F.coalesce(F.bool_and(F.col("verdict") == "KILL"), F.lit(False)).alias("_kill"),
    )
    mismatch = (F.col("_have") != len(set(required))) | (F.col("_extra") > 0)
    return agg.select(
        F.when(mismatch, "KILL").when(F.col("_go"), "GO").when(F.col("_kill"), "KILL").otherwise("MUTATE").alias("overall_verdict")
    )
