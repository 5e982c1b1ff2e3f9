import numpy as np
import pytest

from pitsignal.operators.metrics import ols_slope, summarize, summarize_large
from pitsignal.operators.quantiles import exact_quantiles
from pitsignal.operators.resampling import bootstrap_ci, resampled_means


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, float(v)) for v in values], "k string, x double")


def test_summary_against_brute_force(spark):
    x = np.array([0.02, -0.01, 0.05, 0.0, -0.03])
    for build in (summarize, summarize_large):
        row = build(frame(spark, [*x, np.nan, np.inf, -np.inf]), ["k"], "x").collect()[0]
        loo = max(abs(x.mean() - np.delete(x, i).mean()) for i in range(len(x)))
        assert row["count"] == 5 and row["mean"] == pytest.approx(x.mean()) and row["median"] == np.median(x)
        assert row["hit_rate"] == pytest.approx(0.4) and row["standard_error"] == pytest.approx(x.std(ddof=1) / np.sqrt(5))
        assert row["loo_max_mean_impact"] == pytest.approx(loo) and (row["worst"], row["best"]) == (-0.03, 0.05)


def test_empty_and_single_value_contracts(spark):
    empty = summarize(frame(spark, [np.nan]), ["k"], "x").collect()[0]
    assert empty["count"] == 0 and empty["mean"] == 0 and empty["loo_max_mean_impact"] == 0
    assert summarize(frame(spark, [np.nan]), ["k"], "x", empty_as_zero=False).collect()[0]["mean"] is None
    one = summarize(frame(spark, [-0.2]), ["k"], "x").collect()[0]
    assert one["standard_error"] == 0 and one["loo_max_mean_impact"] == pytest.approx(0.2)


def test_slope_guards(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.1), ("a", 3.0, 5.9), ("a", float("nan"), 9.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0)]
    got = {r.k: r for r in ols_slope(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["a"].slope == pytest.approx(np.polyfit([1, 2, 3], [2, 4.1, 5.9], 1)[0]) and got["a"].pair_count == 3
    assert got["b"].slope is None and got["c"].slope is None


def test_exact_quantiles_of_a_hot_and_heavy_tailed_group(spark):
    rng = np.random.default_rng(0)
    hot, cold = np.concatenate([rng.lognormal(0, 3, 60_000), np.full(20_000, 1.0), [1e12]]), rng.normal(size=37)
    df = frame(spark, hot, "hot").unionByName(frame(spark, cold, "cold")).repartition(16)
    probs = {"lo": 0.0, "p025": 0.025, "med": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "x", probs).collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        for column, p in probs.items():
            assert got[name][column] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(0.5, 1.0, 40)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, i int, x double")
    runs = [bootstrap_ci(df.repartition(n), ["k"], "x", ["i"], samples=400, seed=11).collect()[0] for n in (1, 7)]
    assert tuple(runs[0])[1:] == pytest.approx(tuple(runs[1])[1:])
    assert runs[0].ci_low < values.mean() < runs[0].ci_high
    assert runs[0].ci_high - runs[0].ci_low == pytest.approx(3.92 * values.std(ddof=1) / np.sqrt(40), rel=0.3)


def test_block_draws_keep_neighbours_together(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "k string, i int, x double")
    means = [r.x for r in resampled_means(df, ["k"], ["x"], ["i"], samples=200, seed=1, block=3).collect()]
    # three blocks of three neighbours: every mean is a mean of three block centres
    assert all(abs(m * 3 - round(m * 3)) < 1e-9 for m in means) and min(means) >= 1 and max(means) <= 7


def test_constant_differences_have_a_point_interval(spark):
    df = spark.createDataFrame([("a", i, 0.25) for i in range(5)], "k string, i int, x double")
    row = bootstrap_ci(df, ["k"], "x", ["i"], samples=50, seed=1).collect()[0]
    assert row.ci_low == pytest.approx(0.25) and row.ci_high == pytest.approx(0.25)
    with pytest.raises(ValueError):
        bootstrap_ci(df, ["k"], "x", ["i"], samples=0, seed=1)


def test_quantiles_of_small_groups_take_the_common_way(spark):
    """Every small size and probability against linear interpolation, ties and a hot value included."""
    rng = np.random.default_rng(3)
    rows = [(n, float(v)) for n in range(1, 40) for v in np.round(rng.normal(size=n), 1)] + [(99, 1.0)] * 500 + [(99, 2.0)]
    probs = {"a": 0.0, "b": 0.05, "c": 0.3, "d": 0.55, "e": 0.95, "f": 1.0}
    got = exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", probs).collect()
    for r in got:
        values = [v for k, v in rows if k == r.k]
        assert [r[n] for n in probs] == pytest.approx(list(np.quantile(values, list(probs.values()))))


def test_a_bracket_that_misses_is_ranked_over_the_whole_group(spark, monkeypatch):
    """A sketch that is far off: every edge lies above the median's place."""
    from pitsignal.operators import quantiles

    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=3001), "b": rng.integers(0, 9, 500).astype(float)}
    rows = [(k, float(v)) for k, own in values.items() for v in own]
    frame = spark.createDataFrame(rows, "k string, x double").repartition(4)
    monkeypatch.setattr(quantiles, "_MARGIN", -0.2)  # edges at 0.2 above and below, in the wrong order: an empty bracket
    got = {r.k: r for r in quantiles.exact_quantiles(frame, ["k"], "x", {"q25": 0.25, "median": 0.5}).collect()}
    for k, own in values.items():
        assert got[k].median == pytest.approx(np.median(own)) and got[k].q25 == pytest.approx(np.quantile(own, 0.25))
