"""Mixing evidence to target shares of tool, language and driver by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.llm.words import words
from pitsignal.session import cut_lineage

MARGINS = ("tool", "lang", "driver")
ROUNDS = 600  # upper bound; the tolerance ends the fitting
TOLERANCE = 1e-6  # largest difference of a margin's share from its target
LAZY_ROUNDS = 6  # rounds planned as one job
FEW_CELLS = 100_000  # up to here one row holds the cells' weights and all rounds are one expression


def token_count(content: Column) -> Column:
    """Words of the whole content."""
    return F.size(words(content)).cast("long")


def token_cells(evidence: DataFrame, margins: tuple[str, ...] = MARGINS, tokens: Column | None = None) -> DataFrame:
    """Tokens of every combination of margin values; `tokens` may name counts at hand, else the words are counted."""
    counted = token_count(F.col("content")) if tokens is None else tokens
    return evidence.groupBy(*margins).agg(F.sum(counted).alias("tokens"))


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target share of each value of a margin: its tokens to a power, so that large values give way."""
    totals = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"))
    return totals.select("value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("share"))


def _quoted(name: str) -> str:
    """A column name in a SQL text that is formatted."""
    return "`" + name.replace("`", "``").replace("{", "{{").replace("}", "}}") + "`"


def _fit_few(cells: DataFrame, margins: list[str], rounds: int, tolerance: float) -> DataFrame:
    """The cells with fitted `weight` and the error left, `_off`, by one expression over arrays of the cells.

    A margin value has a code, its group the places of its cells. A step sums the weights of every
    group of a margin and scales each cell by its group; a batch of LAZY_ROUNDS rounds goes on while
    the error is above the tolerance.
    """
    n = len(margins)
    one = cells.coalesce(1)
    for j, margin in enumerate(margins):
        one = one.withColumn(f"_code{j}", F.dense_rank().over(Window.orderBy(margin)) - 1)
    numbered = cut_lineage(one.withColumn("_place", F.monotonically_increasing_id().cast("int")))
    listed = numbered.agg(F.sort_array(F.collect_list(F.struct("_place", "weight", *[f"_code{j}" for j in range(n)]))).alias("_cells"))
    row = listed.select(F.col("_cells.weight").alias("_weights"), F.array(*[F.col(f"_cells._code{j}") for j in range(n)]).alias("_codes"))
    for j, margin in enumerate(margins):
        groups = numbered.groupBy(f"_code{j}").agg(F.first(f"_want_{margin}").alias("want"), F.sort_array(F.collect_list("_place")).alias("places"))
        row = row.crossJoin(groups.agg(F.sort_array(F.collect_list(F.struct(F.col(f"_code{j}").alias("code"), "want", "places"))).alias(f"_groups{j}")))
    # cut here: an expression taken into a lambda would be evaluated for every cell of every step
    row = cut_lineage(row.select("_weights", "_codes", F.array(*[f"_groups{j}" for j in range(n)]).alias("_groups")))

    def named(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def sums(weights: Column, groups: Column) -> Column:
        return F.transform(groups, lambda g: F.aggregate(g["places"], F.lit(0.0), lambda total, i: total + F.get(weights, i)))

    def step(weights: Column, j: Column) -> Column:
        groups, codes = F.get("_groups", j), F.get("_codes", j)

        def scaled(have: Column) -> Column:
            def cell(x: Column, i: Column) -> Column:
                total, want = F.get(have, F.get(codes, i)), F.get(groups, F.get(codes, i))["want"]
                return F.when(total > 0, x * want / total).otherwise(0.0)

            return F.transform(weights, cell)

        return named(sums(weights, groups), scaled)

    def off(weights: Column) -> Column:
        differ = lambda groups: F.array_max(F.zip_with(sums(weights, groups), groups, lambda have, g: F.abs(have - g["want"])))
        return F.coalesce(F.array_max(F.transform("_groups", differ)), F.lit(0.0))

    def batch(state: Column, at: Column) -> Column:
        some = F.least(F.lit(LAZY_ROUNDS), F.lit(rounds) - at * LAZY_ROUNDS)
        moved = F.aggregate(F.sequence(F.lit(0), some * n - 1), state["weights"], lambda weights, k: step(weights, k % n))
        after = named(moved, lambda weights: F.struct(weights.alias("weights"), off(weights).alias("off")))
        return F.when(state["off"] > tolerance, after).otherwise(state)

    start = F.struct(F.col("_weights").alias("weights"), F.lit(1.0).alias("off"))
    fitted = cut_lineage(row.select(F.aggregate(F.sequence(F.lit(0), F.lit((rounds - 1) // LAZY_ROUNDS)), start, batch).alias("_fit")))
    found = fitted.select(F.posexplode("_fit.weights").alias("_at", "weight"), F.col("_fit.off").alias("_off"))
    return numbered.drop("weight").join(found, F.col("_place") == F.col("_at")).drop("_at", "_place", *[f"_code{j}" for j in range(n)])


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], *, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with `weight` (calibrated share of the tokens), `probability` of their items and `margin_error`.

    `targets` holds for each margin a table (value, share); shares need not add up to one. A margin
    value without a target keeps its own tokens as share, one without tokens has none. Each round scales
    the weights to every margin in turn; a cell without tokens has weight zero. Rounds go on until every
    share is within `tolerance` of its target (looked at every LAZY_ROUNDS rounds), at most `rounds`:
    margins that no weights of the filled cells can meet together never get there, and `margin_error`,
    the largest difference left, says so. The probability is weight over token share, scaled so that the
    most wanted cell keeps everything. The number of cells does not depend on the number of items: up to
    FEW_CELLS of them are arrays of one row that go through all rounds in one plan, beyond that a round
    is one window aggregation per margin, by exchanges.
    """
    w = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, table in targets.items():
        wanted = table.select(F.col("value").alias("_value"), F.col("share").cast("double").alias("_share"))
        sums = cells.groupBy(F.col(margin).alias("_own")).agg(F.sum("tokens").cast("double").alias("_tokens"))
        sums = sums.join(wanted, sums["_own"].eqNullSafe(wanted["_value"]), "left")
        sums = sums.select("_own", F.when(F.col("_tokens") > 0, F.coalesce("_share", "_tokens")).otherwise(0.0).alias("_want"))
        total = sums.agg(F.sum("_want")).first()[0] or 1.0
        sums = sums.select("_own", (F.col("_want") / F.lit(total)).alias(f"_want_{margin}"))
        w = w.join(sums, w[margin].eqNullSafe(sums["_own"])).drop("_own")
    # as one text a batch of rounds is analysed once, not once for every margin of a round
    have = {margin: f"sum(weight) over (partition by {_quoted(margin)})" for margin in targets}
    wanted = {margin: _quoted(f"_want_{margin}") for margin in targets}
    off = ", ".join(f"abs({have[margin]} - {wanted[margin]})" for margin in targets)
    kept = ", ".join(_quoted(c) for c in w.columns if c != "weight")
    w, done, error = cut_lineage(w), 0, 1.0
    if targets and rounds > 0 and w.count() <= FEW_CELLS:
        w, done = cut_lineage(_fit_few(w, list(targets), rounds, tolerance)), rounds
        error = w.agg(F.max("_off")).first()[0] or 0.0
    while done < rounds and error > tolerance:
        batch = "{cells}"
        for _ in range(min(LAZY_ROUNDS, rounds - done)):
            for margin, total in have.items():
                scaled = f"case when {total} > 0 then weight * {wanted[margin]} / {total} else 0D end"
                batch = f"(select {kept}, {scaled} as weight from {batch})"
            done += 1
        w = cut_lineage(w.sparkSession.sql(f"select *, array_max(array({off})) as _off from {batch}", cells=w))
        error = w.agg(F.max("_off")).first()[0] or 0.0
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    sums = w.agg(F.sum("weight").alias("weight"), F.max(ratio).alias("ratio")).first()
    total, most = sums["weight"] or 1.0, sums["ratio"] or 1.0
    return w.select(
        *cells.columns,
        (F.col("weight") / F.lit(total)).alias("weight"),
        F.coalesce(ratio / F.lit(most), F.lit(1.0)).alias("probability"),
        F.lit(float(error)).alias("margin_error"),
    )


def draw(item_id: Column, seed: int) -> Column:
    """Number in [0, 1) from 52 bits of an md5 digest of seed and id: the same in any engine and on any retry."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(item_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_evidence(
    evidence: DataFrame,
    targets: Mapping[str, DataFrame],
    *,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    seed: int = 0,
    cells: DataFrame | None = None,
) -> DataFrame:
    """All evidence rows and columns, with weight and probability of their cell, margin_error and `sampled`.

    Expects item_id, content and a column for each key of `targets` (by default meant: tool, lang and
    driver). `sampled` is true where draw(item_id, seed) < probability, so the sampled tokens have the
    target shares in expectation, and no row is taken twice. `cells` may pass the token_cells at hand.

    Null margin values are values of their own. Items without words have no weight but take part in
    the draw with their cell's probability (1 where the whole cell has no words). Equal ids share a
    draw. An empty table gives an empty result. Input columns named as those added are replaced; any
    other name is kept. The cells join by size: broadcast while small, else sort-merge with skew splitting.
    """
    margins = tuple(targets)
    counted = cut_lineage(token_cells(evidence, margins)) if cells is None else cells
    added = ("weight", "probability", "margin_error")
    found = cut_lineage(rake(counted, targets, rounds=rounds, tolerance=tolerance))
    left, right = evidence.alias("mixed_rows"), found.alias("mixed_rates")
    match = None
    for m in margins:
        same = F.col(f"mixed_rows.`{m}`").eqNullSafe(F.col(f"mixed_rates.`{m}`"))
        match = same if match is None else match & same
    kept = [F.col(f"mixed_rows.`{c}`") for c in evidence.columns if c not in (*added, "sampled")]
    sampled = draw(F.col("mixed_rows.item_id"), seed) < F.col("mixed_rates.probability")
    return left.join(right, match).select(*kept, *[F.col(f"mixed_rates.{c}") for c in added], sampled.alias("sampled"))
