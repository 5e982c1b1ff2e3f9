"""The full research run: coverage, capacity gate, signal floor, evaluation, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.plans.walkforward import (
    CHECKS, WalkForward, WalkForwardConfig, overall_verdict, pooled_summary, promotion_checks, verdicts, walk_forward,
)
from pitsignal.session import cut_lineage


def coverage(frames: DataFrame, symbols: Sequence[str] = (), lookbacks: Sequence[int] = ()) -> DataFrame:
    """Valid residuals per symbol and lookback; each of `symbols` has a row per lookback, zero without a session."""
    found = frames.groupBy("symbol", "lookback").agg(F.count("residual").alias("valid_sessions"))
    if not symbols:
        return found
    wanted = frames.sparkSession.createDataFrame([(s, n) for s in symbols for n in lookbacks], "symbol string, lookback int")
    wanted = wanted.withColumn("lookback", F.col("lookback").cast(found.schema["lookback"].dataType))
    return wanted.join(found, ["symbol", "lookback"], "left").withColumn("valid_sessions", F.coalesce("valid_sessions", F.lit(0).cast("long")))


def signal_floor(valid_sessions):
    """At least eight signals, else ten percent of the valid sessions, ties rounded to even."""
    return F.greatest(F.lit(8), F.bround(valid_sessions * F.lit(0.10)).cast("int"))


def capacity(cover: DataFrame, config: WalkForwardConfig) -> DataFrame:
    """One row: the smallest coverage, what a fold needs, and the resulting signal floor."""
    need = config.min_train + config.test_size
    have = F.coalesce(F.min("valid_sessions"), F.lit(0))
    return cover.agg(have.alias("valid_capacity")).select(
        "valid_capacity",
        F.lit(need).alias("required_sessions"),
        (F.col("valid_capacity") >= need).alias("enough_history"),
        signal_floor(F.col("valid_capacity")).alias("min_total_signals"),
        F.format_string("max(8, round(10%% of %d valid sessions))", F.col("valid_capacity")).alias("rationale"),
    )


def insufficient_history(cap: DataFrame) -> DataFrame:
    """The stop result, one row when the history cannot form a fold and none otherwise."""
    return cap.where("not enough_history").select(
        F.lit("MUTATE").alias("verdict"), F.lit("insufficient_history").alias("reason"), "required_sessions", "valid_capacity"
    )


@dataclass(frozen=True)
class ResearchRun:
    """A finished run, or a stopped one: then there is no evaluation and no verdict per symbol."""

    coverage: DataFrame
    capacity: DataFrame
    evaluation: WalkForward | None
    verdicts: DataFrame | None
    overall: DataFrame


def research(frames: DataFrame, config: WalkForwardConfig, *, required: Sequence[str], control: str) -> ResearchRun:
    """Evaluate the universe from one episode table.

    The table is written once to the checkpoint folder: it is one row per (symbol, lookback,
    session), tiny next to the bars, and every branch below reads it. Too little history of any
    required symbol stops the run, whatever the others say: nothing is evaluated, and the overall
    verdict is MUTATE.
    """
    kept = cut_lineage(frames.where(F.col("symbol").isin([*required, control])))
    cover = coverage(kept, [*required, control], config.beta_lookbacks)
    cap = capacity(cover, config)
    stop = insufficient_history(cap).select(F.col("verdict").alias("overall_verdict"))
    if stop.first() is not None:  # the capacity is one row
        return ResearchRun(cover, cap, None, None, stop)
    evaluation = walk_forward(kept, config, cut=False).settled()
    floor = cap.select("min_total_signals").scalar()
    checks = promotion_checks(
        pooled_summary(kept, evaluation.signals), evaluation.results, config, control=control, min_signals=floor
    )
    table = (
        verdicts(checks)
        .withColumn("min_total_signals", floor)
        .withColumn("config_hash", config.config_hash_column(F.col("min_total_signals")))
    )
    return ResearchRun(cover, cap, evaluation, table, overall_verdict(table, required))


def report_lines(table: DataFrame, results: DataFrame) -> DataFrame:
    """Readable verdict lines per symbol, in order; a sink writes them as text."""
    head = F.array(
        F.struct(F.lit(0).alias("line_no"), F.format_string("verdict: %s", F.col("verdict")).alias("line")),
        F.struct(F.lit(1).alias("line_no"), F.format_string("test signals: %d", F.col("total_signals")).alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.format_string("mean signed test return: %.6f", F.col("mean_test_return")).alias("line")),
        *[
            F.struct(
                F.lit(10 + i).alias("line_no"),
                F.concat(F.lit("["), F.when(F.col(c), "x").otherwise(" "), F.lit(f"] {c}")).alias("line"),
            )
            for i, c in enumerate(CHECKS)
        ],
    )
    top = table.select("symbol", F.explode(head).alias("_l")).select("symbol", "_l.*")
    folds = results.select(
        "symbol",
        (F.col("fold_id") + 100).alias("line_no"),
        F.format_string(
            "%s to %s: n=%d, mean=%.6f, median=%.6f, hit=%.2f%%, %s/%s/%s/%s",
            F.col("test_start").cast("string"),
            F.col("test_end").cast("string"),
            F.col("signal_count"),
            F.col("mean"),
            F.col("median"),
            F.col("hit_rate") * 100,
            "thesis",
            "normalization",
            F.col("threshold").cast("string"),
            "horizon",
        ).alias("line"),
    ).join(table.select("symbol"), "symbol", "left_semi")
    return top.unionByName(folds)


def overall_report(run: ResearchRun, **settings: str) -> DataFrame:
    """The run in one row: verdict, reason of a stop, history, signal floor with its rationale, coverage, `settings`.

    `settings` are recorded as they are, such as feeds and session times. The coverage has one entry per
    symbol and lookback.
    """
    cover = run.coverage.agg(F.array_sort(F.collect_list(F.struct("symbol", "lookback", "valid_sessions"))).alias("coverage"))
    return run.capacity.select(
        run.overall.scalar().alias("verdict"),
        F.when(~F.col("enough_history"), "insufficient_history").alias("reason"),
        "required_sessions",
        "valid_capacity",
        "min_total_signals",
        "rationale",
        cover.scalar().alias("coverage"),
        *[F.lit(value).alias(name) for name, value in settings.items()],
    )


def write_report(run: ResearchRun, path: str, **settings: str) -> None:
    """The overall row and the verdicts as JSON, tables as Parquet, readable lines as text sorted per symbol.

    A stopped run has the overall row and the coverage only.
    """
    overall_report(run, **settings).write.mode("overwrite").json(f"{path}/overall")
    run.coverage.write.mode("overwrite").parquet(f"{path}/coverage")
    if run.evaluation is None:
        return
    run.verdicts.write.mode("overwrite").json(f"{path}/verdicts")
    run.evaluation.results.write.mode("overwrite").parquet(f"{path}/folds")
    lines = report_lines(run.verdicts, run.evaluation.results)
    (
        lines.repartitionByRange("symbol", "line_no")
        .sortWithinPartitions("symbol", "line_no")
        .select("symbol", "line")
        .write.mode("overwrite")
        .partitionBy("symbol")
        .text(f"{path}/lines")
    )


def research_digest(table: DataFrame, *, primary: str) -> DataFrame:
    """Compact view: role, verdict and mean in basis points with two digits."""
    return table.select(
        "symbol",
        F.when(F.col("symbol") == primary, "live_candidate").otherwise("negative_evidence_only").alias("role"),
        "verdict",
        "total_signals",
        F.round(F.col("mean_test_return") * 10_000, 2).alias("mean_test_return_bps"),
        "config_hash",
    )
