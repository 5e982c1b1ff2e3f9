"""Quote-surface stress: rebuild the best spread under bounded quote and delta perturbations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.functions.contracts import age_in_limit, days_to_expiry
from pitsignal.functions.draws import runs, trial_draws, whole_steps
from pitsignal.functions.numeric import hash_digest, hash_uniform, quote_quantum
from pitsignal.operators.spreads import SpreadPolicy, spread_row
from pitsignal.schemas import DELTA, PRICE, require_positive
from pitsignal.session import cut_lineage


@dataclass(frozen=True)
class Band:
    name: str
    midpoint_fraction: float
    spread_fraction: float
    delta_absolute: float

    def __post_init__(self) -> None:
        if not self.name or min(self.midpoint_fraction, self.spread_fraction, self.delta_absolute) < 0:
            raise ValueError("a band needs a name and non-negative fractions")


# fixed values: declared perturbation envelopes
BANDS = (
    Band("micro", 0.0025, 0.10, 0.005),
    Band("small", 0.0050, 0.20, 0.010),
    Band("moderate", 0.0100, 0.40, 0.020),
)


def _shifted(rows: DataFrame, digest: Column, contract: str, name: str) -> DataFrame:
    """Adds struct `name` (bid, ask, delta): the quotes of struct column `contract` under the digest's three draws.

    Each step is a projection of its own, whose columns are read more than once, so that a digest
    is computed once per row. Expects `band` (struct).
    """
    c = lambda field: F.col(f"{contract}.{field}")
    band = lambda field: F.col(f"band.{field}")
    draw = lambda i, width: -width + 2 * width * hash_uniform(F.col("_digest"), i)
    bid, ask = c("bid").cast("double"), c("ask").cast("double")
    mid = (bid + ask) / 2 * (1 + draw(0, band("midpoint_fraction")))
    half = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), (ask - bid) / 2) * (1 + draw(1, band("spread_fraction"))))
    magnitude = F.abs(c("delta")).cast("double") + draw(2, band("delta_absolute"))
    clamped = F.round(F.least(F.lit(0.999999), F.greatest(F.lit(0.000001), magnitude)), 6)
    sign = F.when(c("delta") >= 0, 1.0).otherwise(-1.0)
    new_delta = F.when(c("delta").isNotNull(), (sign * clamped).cast(DELTA))
    new_bid = quote_quantum(F.greatest(F.lit(0.01), F.col("_mid") - F.col("_half")))
    new_ask = F.greatest(quote_quantum(F.greatest(F.col("_bid").cast("double"), F.col("_mid") + F.col("_half"))), F.col("_bid"))
    kept = rows.columns
    drawn = rows.withColumn("_digest", digest).select(*kept, mid.alias("_mid"), half.alias("_half"), new_delta.alias("_delta"))
    quoted = drawn.withColumn("_bid", new_bid)
    return quoted.select(*kept, F.struct(F.col("_bid").alias("bid"), new_ask.alias("ask"), F.col("_delta").alias("delta")).alias(name))


def perturbed_quotes(rows: DataFrame, *, seed: int) -> DataFrame:
    """Shift midpoint, half spread and |delta| by hashed uniforms of (seed, band, trial, contract).

    Expects `band` (struct) and `trial`; one digest gives the three draws of a row.
    """
    packed = rows.withColumn("_contract", F.struct("bid", "ask", "delta"))
    digest = hash_digest(seed, F.col("band.name"), F.col("trial"), F.col("symbol"))
    kept = [F.col(name) for name in rows.columns if name not in ("bid", "ask", "delta")]
    return _shifted(packed, digest, "_contract", "_new").select(*kept, "_new.bid", "_new.ask", "_new.delta")


def _with_band(chain: DataFrame, bands: Sequence[Band]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(b.name).alias("name"),
            F.lit(b.midpoint_fraction).alias("midpoint_fraction"),
            F.lit(b.spread_fraction).alias("spread_fraction"),
            F.lit(b.delta_absolute).alias("delta_absolute"),
        )
        for b in bands
    ]
    return chain.withColumn("band", F.explode(F.array(*entries)))


def _tasks(chain: DataFrame) -> int:
    """Tasks for rows that are about to fan out: few rows now, so their number must not follow their size."""
    spark = chain.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def band_trials(chain: DataFrame, bands: Sequence[Band], trials: int) -> DataFrame:
    """Every contract once per band and trial; contracts are dealt before they fan out."""
    dealt = chain.repartition(_tasks(chain), "symbol")
    return _with_band(dealt, bands).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))


# widths by which an interval is taken too wide, against rounding in its ends: a cent, and a delta step
_CENT, _STEP = 0.01, 1e-5


def _intervals(chain: DataFrame, policy: SpreadPolicy, now: Column) -> DataFrame:
    """Contracts that can pass the eligibility tests under some draw of `band`, with the range of every draw.

    Columns bid_low .. mag_high bound the quotes and |delta| of any trial; `always` tells that the
    tests of expiry, age and relative spread hold in each trial.
    """
    c = F.col
    bid, ask = c("bid").cast("double"), c("ask").cast("double")
    mid, half = (bid + ask) / 2, F.greatest(F.lit(0.0), (ask - bid) / 2)
    m, s, d = c("band.midpoint_fraction"), c("band.spread_fraction"), c("band.delta_absolute")
    mag = F.abs(c("delta")).cast("double")
    floor = lambda x: F.greatest(F.lit(0.01), x)
    ranged = chain.withColumns(
        {
            "bid_low": floor(mid * (1 - m) - half * (1 + s) - _CENT),
            "bid_high": floor(mid * (1 + m) - F.greatest(F.lit(0.0), half * (1 - s))) + _CENT,
            "ask_low": floor(mid * (1 - m) + F.greatest(F.lit(0.0), half * (1 - s)) - _CENT),
            "ask_high": floor(mid * (1 + m) + half * (1 + s)) + _CENT,
            "mag_low": mag - d - _STEP,
            "mag_high": mag + d + _STEP,
        }
    )
    limit = float(policy.max_relative_spread)
    widest = (c("ask_high") - c("bid_low")) * 2 / (c("ask_high") + c("bid_low"))
    # spread and midpoint move on their own: the narrowest spread over the highest midpoint
    narrowest = (F.greatest(F.lit(0.0), 2 * half * (1 - s)) - 2 * _CENT) / (mid * (1 + m) + _CENT)
    possible = (
        c("delta").isNotNull()
        & policy.is_approved(c("underlying"))
        & days_to_expiry(c("expiration"), now).between(policy.min_dte, policy.max_dte)
        & age_in_limit(c("quote_ts"), now, policy.max_quote_age_seconds)
        & (narrowest <= limit + 1e-9)
    )
    return ranged.where(possible).withColumn("always", widest <= limit - 1e-9)


def _undominated(legs: DataFrame, grid: Sequence[str], best: str, cost: str, side: int) -> DataFrame:
    """Legs of one strike that are not surely worse than the one of surest |delta| in quote and |delta| alike.

    `side` is 1 for long legs (large |delta| and low ask win) and -1 for short ones.
    """
    sure, worst = (f"mag_{best}", f"{cost}_high") if side > 0 else (f"mag_{best}", f"{cost}_low")
    lead = F.struct((side * F.col(sure)).alias("m"), (-side * F.col(worst)).alias("q"))
    leads = legs.where("steady").groupBy(*grid).agg(F.max(lead).alias("_lead"))
    joined = legs.join(leads, list(grid), "left")
    own_mag = side * F.col("mag_high" if side > 0 else "mag_low")
    own_cost = -side * F.col(f"{cost}_low" if side > 0 else f"{cost}_high")
    worse = (own_mag < F.col("_lead.m")) & (own_cost < F.col("_lead.q"))
    return joined.where(F.col("_lead").isNull() | ~worse).drop("_lead")


def contending_pairs(
    chain: DataFrame, *, key: str, policy: SpreadPolicy, now: Column, max_debit: str, bands: Sequence[Band] = BANDS
) -> DataFrame:
    """Leg pairs per (chain, option type, band) that can rank first in some trial.

    Interval bounds of quotes and |delta| leave out, before any trial is drawn, pairs that never meet
    the conditions of a vertical and pairs whose best score is below the worst score of a pair that
    meets them in every trial. Contracts of one strike are thinned first, so that pairs grow with the
    listing grid and not with the contracts.
    """
    c = F.col
    long_min, long_max = float(policy.long_delta_min), float(policy.long_delta_max)
    short_min, net_min = float(policy.min_short_abs_delta), float(policy.min_net_delta)
    grid = [key, "band", "expiration", "option_type", "strike"]
    rows = _intervals(_with_band(chain, bands), policy, now)
    longs = rows.where((c("mag_high") >= long_min) & (c("mag_low") <= long_max))
    longs = longs.withColumn("steady", c("always") & (c("mag_low") >= long_min) & (c("mag_high") <= long_max))
    shorts = rows.where((c("mag_high") >= short_min) & (c("mag_low") <= long_max - net_min))
    shorts = shorts.withColumn("steady", c("always") & (c("mag_low") >= short_min))
    fields = ("symbol", "bid", "ask", "delta", "quote_ts", "strike", "bid_low", "bid_high", "ask_low", "ask_high", "mag_low", "mag_high", "steady")
    shared = [key, "band", "expiration", "option_type"]
    left = _undominated(longs, grid, "low", "ask", 1).select(*shared, max_debit, F.struct(*fields).alias("_l"))
    right = _undominated(shorts, grid, "high", "bid", -1).select(*shared, F.struct(*fields).alias("_s"))
    width = (c("_s.strike") - c("_l.strike")).cast("double") * F.when(c("option_type") == "call", 1).otherwise(-1)
    budget = c(max_debit).cast("double")
    bounds = left.join(right, shared).select(
        "*",
        width.alias("_width"),
        (c("_l.ask_low") - c("_s.bid_high")).alias("_debit_low"),
        (c("_l.ask_high") - c("_s.bid_low")).alias("_debit_high"),
        (c("_l.mag_low") - c("_s.mag_high")).alias("_net_low"),
        (c("_l.mag_high") - c("_s.mag_low")).alias("_net_high"),
    )
    can = (c("_width") > 0) & (c("_debit_high") > 0) & (c("_debit_low") < c("_width")) & (c("_net_high") >= net_min) & (c("_debit_low") <= budget)
    must = c("_l.steady") & c("_s.steady") & (c("_debit_low") > 0) & (c("_debit_high") < c("_width")) & (c("_net_low") >= net_min) & (c("_debit_high") <= budget)
    most = c("_net_high") / F.greatest(F.lit(0.01), c("_debit_low"))
    sure = F.when(must, c("_net_low") / c("_debit_high"))
    scored = bounds.where(can).select(*shared, max_debit, "_l", "_s", most.alias("_most"), sure.alias("_sure"))
    scored = cut_lineage(scored)
    side = [key, "band", "option_type"]
    floors = scored.groupBy(*side).agg(F.max("_sure").alias("_floor"))
    return scored.join(floors, side).where(c("_floor").isNull() | (c("_most") >= c("_floor") - 1e-9)).drop("_most", "_sure", "_floor")


def quote_extremes(chain: DataFrame, *, key: str, bands: Sequence[Band] = BANDS, trials: int = 2_000, seed: int = 20260901) -> DataFrame:
    """Per (chain, contract, band): the number of trials, and the extremes of the quotes and the delta of all of them.

    Columns: key, symbol, band, trials, low_bid .. high_delta. The quotes are those of perturbed_quotes. Rounding and
    clamping never turn an order round, so they are left to the extremes of the unrounded values.
    """
    require_positive(trials=trials)
    c = F.col
    ends = [f"{end}_{what}" for what in ("under", "over", "mag") for end in ("low", "high")]
    fields = "".join(f", {name} double" for name in ends)
    dealt = chain.select(key, "symbol", *[c(x).cast("double").alias(x) for x in ("bid", "ask")], c("delta").cast("double").alias("delta"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _NAMES):
                part = batch.iloc[at : at + _NAMES]
                for band in bands:
                    draws = trial_draws(f"{seed}|{band.name}", part["symbol"].tolist(), range(1, trials + 1))
                    values = _moved(band, part["bid"].to_numpy(), part["ask"].to_numpy(), part["delta"].to_numpy(), draws)
                    found = {f"{end}_{what}": f(v, axis=1) for what, v in zip(("under", "over", "mag"), values) for end, f in (("low", np.min), ("high", np.max))}
                    yield part[[key, "symbol", "delta"]].assign(band=band.name, trials=trials, **found)

    kind = dict(chain.dtypes)
    folded = dealt.repartition(_tasks(chain), "symbol").mapInPandas(fold, f"{key} {kind[key]}, symbol {kind['symbol']}, delta double, band string, trials bigint{fields}")
    risen = c("delta") >= 0
    near, far = F.when(risen, c("low_mag")).otherwise(-c("high_mag")), F.when(risen, c("high_mag")).otherwise(-c("low_mag"))
    quotes = {f"{end}_{what}": quote_quantum(c(f"{end}_{raw}")) for what, raw in (("bid", "under"), ("ask", "over")) for end in ("low", "high")}
    deltas = {f"{end}_delta": F.when(c("delta").isNotNull() & ~F.isnan("delta"), F.round(x, 6).cast(DELTA)) for end, x in (("low", near), ("high", far))}
    rounded = folded.select(key, "symbol", "band", "trials", *[v.alias(n) for n, v in (quotes | deltas).items()])
    # rows of one contract count together
    extremes = [f(n).alias(n) for n in (*quotes, *deltas) for f in ((F.min if n.startswith("low") else F.max),)]
    return rounded.groupBy(key, "symbol", "band").agg(F.sum("trials").alias("trials"), *extremes)


_NAMES = 100  # contracts that are drawn at once
_CELLS = 1 << 15  # pairs times trials that are priced at once


def _moved(band: Band, bid: np.ndarray, ask: np.ndarray, delta: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bid and ask before they are rounded, and |delta| before it is, of (contract, trial): the same steps as in _shifted."""
    draw = lambda i, width: -width + 2 * width * draws[i]
    mid = ((bid + ask) / 2)[:, None] * (1 + draw(0, band.midpoint_fraction))
    half = np.fmax(0.0, np.fmax(0.0, (ask - bid) / 2)[:, None] * (1 + draw(1, band.spread_fraction)))
    magnitude = np.abs(delta)[:, None] + draw(2, band.delta_absolute)
    return np.fmax(0.01, mid - half), np.fmax(0.01, mid + half), np.fmin(0.999999, np.fmax(0.000001, magnitude))


def _decimals(units: np.ndarray, precision: int, scale: int) -> pa.Array:
    """Decimal column of whole numbers of the last digit."""
    halves = np.stack([units, units >> 63], axis=1).astype("<i8")
    return pa.Array.from_buffers(pa.decimal128(precision, scale), len(units), [None, pa.py_buffer(halves.tobytes())])


def _best_of(pairs: pa.Table, starts: np.ndarray, band: Band, trials: range, limits: dict[str, int | tuple[int, int]], seed: int) -> tuple[np.ndarray, ...]:
    """Row, trial, |deltas| and debit of the pair that ranks first in each trial and side that has one.

    `pairs` holds whole sides of one band, which begin at `starts`, in the order in which equal pairs rank.
    """
    n = pairs.num_rows
    column = lambda name: pairs[name].to_numpy()
    both = lambda name: np.concatenate([column(f"_l_{name}"), column(f"_s_{name}")])
    draws = trial_draws(f"{seed}|{band.name}", pairs["long_symbol"].to_pylist() + pairs["short_symbol"].to_pylist(), trials)
    under, over, magnitude = _moved(band, both("bid"), both("ask"), both("delta"), draws)
    bid, ask, mag = whole_steps(under, 2), whole_steps(over, 2), whole_steps(magnitude, 6)
    bid = np.maximum(bid, 1)
    ask = np.maximum(ask, bid)
    top, bottom = limits["spread"]
    narrow = 2 * (ask - bid) * bottom <= top * (ask + bid)
    debit, net = ask[:n] - bid[n:], mag[:n] - mag[n:]
    ok = narrow[:n] & narrow[n:] & (mag[:n] >= limits["long_min"]) & (mag[:n] <= limits["long_max"]) & (mag[n:] >= limits["short_min"])
    ok &= (debit > 0) & (debit * 100 < column("_width")[:, None]) & (debit * 100 <= column("_budget")[:, None]) & (net >= limits["net_min"])
    # both are whole numbers far below 2 ** 26, so that equal quotients, and no others, are equal doubles
    score = np.where(ok, net / np.where(ok, debit, 1), -np.inf)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    first = ok & (score == np.maximum.reduceat(score, starts, axis=0)[of])
    # of equal scores the larger net delta, then the cheaper, then the first pair
    for rank in (-net, debit, np.broadcast_to(np.arange(n)[:, None], net.shape)):
        if not (np.add.reduceat(first, starts, axis=0, dtype=np.int64) > 1).any():
            break
        rank = np.where(first, rank, np.iinfo(np.int64).max)
        first &= rank == np.minimum.reduceat(rank, starts, axis=0)[of]
    row, column_no = np.nonzero(first)
    return row, column_no + trials[0], mag[:n][row, column_no], mag[n:][row, column_no], debit[row, column_no]


def _limits(policy: SpreadPolicy) -> dict[str, int | tuple[int, int]]:
    """The policy in whole millionths of delta, and the relative spread as a ratio."""
    million = lambda x: Decimal(str(x)).scaleb(6)
    return {
        "spread": Decimal(str(policy.max_relative_spread)).as_integer_ratio(),
        "long_min": ceil(million(policy.long_delta_min)),
        "long_max": floor(million(policy.long_delta_max)),
        "short_min": ceil(million(policy.min_short_abs_delta)),
        "net_min": ceil(million(policy.min_net_delta)),
    }


_PACKED = (("trials", T.ArrayType(T.IntegerType())), ("nets", T.ArrayType(T.IntegerType())), ("debits", T.ArrayType(T.LongType())))


def _drawn(
    chain: DataFrame, packed: bool, *, key: str, policy: SpreadPolicy, now: Column, max_debit: str, bands: Sequence[Band], trials: int, seed: int, block: int
) -> DataFrame:
    """Winning pairs with their figures: a row per trial, or, packed, a row per pair and block with arrays over its trials."""
    require_positive(trials=trials, block=block)
    if len({b.name for b in bands}) != len(bands):
        raise ValueError("band names must be unique")
    c = F.col
    pairs = contending_pairs(chain, key=key, policy=policy, now=now, max_debit=max_debit, bands=bands)
    units = lambda x: x.cast(PRICE) * 10_000
    width = units(F.when(c("option_type") == "call", c("_s.strike") - c("_l.strike")).otherwise(c("_l.strike") - c("_s.strike")))
    numbers = [c(f"{leg}.{field}").cast("double").alias(f"{leg}_{field}") for leg in ("_l", "_s") for field in ("bid", "ask", "delta")]
    side = [key, "option_type"]
    flat = pairs.select(
        *side, c("band.name").alias("band"), F.explode(F.sequence(F.lit(0), F.lit((trials - 1) // block))).alias("block"),
        "expiration", c("_l.symbol").alias("long_symbol"), c("_s.symbol").alias("short_symbol"), c("_l.strike").alias("long_strike"), c("_s.strike").alias("short_strike"),
        c("_l.quote_ts").alias("long_ts"), c("_s.quote_ts").alias("short_ts"), *numbers,
        F.ceil(width).cast("bigint").alias("_width"), F.floor(c(max_debit).cast("decimal(38,8)") * 10_000).cast("bigint").alias("_budget"),
    )
    dealt = flat.repartition(_tasks(chain), *side, "band", "block").sortWithinPartitions("band", "block", *side, "expiration", "long_symbol", "short_symbol")
    static = [*side, "band", "expiration", "long_symbol", "short_symbol", "long_strike", "short_strike", "long_ts", "short_ts", "_l_delta", "_s_delta"]
    if packed:
        static = static[:6]
    schema = T.StructType([dealt.schema[name] for name in static])
    for name, kind in _PACKED if packed else (("trial", T.IntegerType()), ("long_mag", DELTA), ("short_mag", DELTA), ("debit", T.DecimalType(19, 4))):
        schema.add(name, kind)
    by_name, limits, place = {b.name: b for b in bands}, _limits(policy), ("band", "block", *side)

    def priced(sides: pa.Table) -> Iterator[pa.RecordBatch]:
        """The trials of whole sides, a few sides and trials at a time."""
        names, blocks, *marks = (sides[name].to_pylist() for name in place)
        for at, end in runs(names, blocks):
            drawn = range(blocks[at] * block + 1, min(trials, (blocks[at] + 1) * block) + 1)
            few = max(1, _CELLS // len(drawn))
            starts = np.array([at + start for start, _ in runs(*[m[at:end] for m in marks])])
            cuts = [at]
            for upto in [*starts[1:].tolist(), end]:
                if upto - cuts[-1] >= few or upto == end:
                    cuts.append(upto)
            for first, last in zip(cuts, cuts[1:]):
                own = sides.slice(first, last - first)
                step = max(1, min(len(drawn), 4 * _CELLS // (last - first)))
                for k in range(0, len(drawn), step):
                    row, trial, long_mag, short_mag, debit = _best_of(own, starts[(starts >= first) & (starts < last)] - first, by_name[names[at]], drawn[k : k + step], limits, seed)
                    if packed:
                        # rows come in ascending order
                        row, at_first = np.unique(row, return_index=True)
                        ends = pa.array(np.append(at_first, len(trial)), pa.int32())
                        values = [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in ((trial, pa.int32()), (long_mag - short_mag, pa.int32()), (debit, pa.int64()))]
                    else:
                        values = [pa.array(trial, pa.int32()), _decimals(long_mag, 9, 6), _decimals(short_mag, 9, 6), _decimals(debit * 100, 19, 4)]
                    chosen = own.select(static).take(row).combine_chunks()
                    for name, value in zip(schema.names[len(static) :], values):
                        chosen = chosen.append_column(name, value)
                    yield from chosen.to_batches()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            # the last side may go on in the next batch
            kept = list(runs(*[held[name].to_pylist() for name in place]))[-1][0]
            yield from priced(held.slice(0, kept).combine_chunks())
            held = held.slice(kept)
        if held is not None:
            yield from priced(held.combine_chunks())

    return dealt.mapInArrow(best, schema)


def stress_trials(
    chain: DataFrame,
    *,
    key: str,
    policy: SpreadPolicy,
    now: Column,
    max_debit: str,
    bands: Sequence[Band] = BANDS,
    trials: int = 2_000,
    seed: int = 20260901,
    block: int = 500,
) -> DataFrame:
    """Best spread of every (chain, band, trial, direction) that has one.

    Only contending pairs are drawn. They are dealt by (chain, option type, band, block of trials), and a task
    sorts its pairs by side, draws and prices a few sides at once as arrays, and keeps the best pair of each
    trial, so the perturbed rows are never rows of a table and a chain is spread over its blocks. A
    contract's draws hash its own name, so that every pair it is in sees the same quotes. For summaries there is packed_trials.
    """
    c, side = F.col, [key, "option_type"]
    drawn = _drawn(chain, False, key=key, policy=policy, now=now, max_debit=max_debit, bands=bands, trials=trials, seed=seed, block=block)
    sign = lambda leg: F.when(c(f"{leg}_delta") >= 0, c(f"{'long' if leg == '_l' else 'short'}_mag")).otherwise(-c(f"{'long' if leg == '_l' else 'short'}_mag"))
    leg = lambda name, old: F.struct(
        c(f"{name}_symbol").alias("symbol"), c(f"{name}_mag").alias("mag"), sign(old).cast(DELTA).alias("delta"), c(f"{name}_ts").alias("quote_ts")
    )
    net = c("long_mag") - c("short_mag")
    chosen = drawn.select(
        *side, "band", "trial", "expiration", leg("long", "_l").alias("long"), leg("short", "_s").alias("short"),
        "long_strike", "short_strike", "debit", net.alias("net_delta"), (net / c("debit")).alias("score"),
    )
    return spread_row(chosen, [key, "band", "trial"])


def packed_trials(
    chain: DataFrame,
    *,
    key: str,
    policy: SpreadPolicy,
    now: Column,
    max_debit: str,
    bands: Sequence[Band] = BANDS,
    trials: int = 2_000,
    seed: int = 20260901,
    block: int = 500,
) -> DataFrame:
    """The trials of stress_trials as one row per (chain, direction, band, leg pair, block) that it wins trials of.

    Columns: key, direction, band, expiration, long_symbol, short_symbol and arrays of equal length: trials, nets
    (net delta in millionths), debits (in cents). A study's rows and shuffles grow with its pairs, not its trials.
    """
    drawn = _drawn(chain, True, key=key, policy=policy, now=now, max_debit=max_debit, bands=bands, trials=trials, seed=seed, block=block)
    return drawn.withColumn("option_type", F.when(F.col("option_type") == "call", "bullish").otherwise("bearish")).withColumnRenamed("option_type", "direction")


def _pack(trials_table: DataFrame, key: str) -> DataFrame:
    """packed_trials of a table of trials; a packed one stays as it is."""
    if "nets" in trials_table.columns:
        return trials_table
    units = lambda name, scale: F.collect_list((F.col(name) * scale).cast("bigint"))
    return trials_table.groupBy(key, "direction", "band", "expiration", "long_symbol", "short_symbol").agg(
        units("net_delta", 1_000_000).cast("array<int>").alias("nets"), units("net_debit", 100).alias("debits")
    )


_FIGURES = ("net_delta", "max_loss", "net_debit", "delta_per_debit")
_QUANTILES = (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))


def _quantile(ordered: np.ndarray, p: float) -> float | None:
    """As Spark's percentile: linear between the two nearest of the sorted values."""
    if not len(ordered):
        return None
    place = (len(ordered) - 1) * p
    low, high = floor(place), ceil(place)
    return float(ordered[low] if low == high else (high - place) * ordered[low] + (place - low) * ordered[high])


def stress_summary(
    trials_table: DataFrame, baseline: DataFrame, *, key: str, policy: SpreadPolicy, trials: int, bands: Sequence[Band] = BANDS, top: int = 0
) -> DataFrame:
    """Per (chain, direction, band): rates against the unperturbed choice, quantiles, violations.

    Only sides whose baseline is constructible are reported. Every quantile is over at most
    `trials` values, so a group is a small array. With `top` a column top_pairs holds the most frequent leg
    pairs (pair, count, rate), as in top_pairs. `trials_table`: packed_trials, or stress_trials of them.
    """
    base = baseline.select(
        key,
        "direction",
        F.col("long_symbol").alias("_long"),
        F.col("short_symbol").alias("_short"),
        F.col("expiration").alias("_expiration"),
        "max_net_debit",
    )
    groups = [key, "direction", "band"]
    grid = base.withColumn("band", F.explode(F.array(*[F.lit(b.name) for b in bands])))
    compared = grid.join(_pack(trials_table, key), groups, "left")
    c = F.col
    same_long, same_short = c("long_symbol") == c("_long"), c("short_symbol") == c("_short")
    flags = {"same_pair": same_long & same_short, "same_long": same_long, "same_short": same_short, "same_expiration": c("expiration") == c("_expiration")}
    pair = [F.concat_ws("|", "long_symbol", "short_symbol").alias("_pair")] if top else []
    cents = F.floor(c("max_net_debit").cast("decimal(38,8)") * 100).cast("bigint")
    rows = compared.select(
        *groups, *[F.coalesce(test, F.lit(False)).alias(name) for name, test in flags.items()], F.coalesce(cents, F.lit((1 << 63) - 1)).alias("_most"), "nets", "debits", *pair
    )
    rates, least = list(flags), _limits(policy)["net_min"]
    schema = T.StructType([rows.schema[name] for name in groups])
    for name in ("candidate_count", "abstention_count"):
        schema.add(name, T.LongType())
    for name in ("candidate_rate", *[f"{name}_rate" for name in rates]):
        schema.add(name, T.DoubleType())
    schema.add("risk_invariant_violations", T.LongType())
    for name in _FIGURES:
        for label, _ in _QUANTILES:
            schema.add(f"{name}_{label}", T.DoubleType())
    kinds = {"top_pairs": pa.list_(pa.struct([("pair", pa.string()), ("count", pa.int64()), ("rate", pa.float64())]))}
    if top:
        entry = T.StructType().add("pair", T.StringType()).add("count", T.LongType()).add("rate", T.DoubleType())
        schema.add("top_pairs", T.ArrayType(entry))

    def side(names: tuple, table: pa.Table) -> pa.Table:
        table = table.filter(pc.is_valid(table["nets"]))
        sizes = pc.list_value_length(table["nets"]).to_numpy()
        nets, debits = (pc.list_flatten(table[name]).to_numpy() for name in ("nets", "debits"))
        n = len(nets)
        count = {name: int(sizes[table[name].to_numpy()].sum()) for name in rates}
        out = dict(zip(groups, [name.as_py() for name in names]))
        out |= {"candidate_count": n, "abstention_count": trials - n, "candidate_rate": n / trials}
        out |= {f"{name}_rate": count[name] / n if n else 0.0 for name in rates}
        out["risk_invariant_violations"] = int(((debits > np.repeat(table["_most"].to_numpy(), sizes)) | (nets < least) | (debits <= 0)).sum())
        # quotients of whole numbers, so the doubles nearest to the decimals
        for name, values in zip(_FIGURES, (nets / 1e6, debits * 1.0, debits / 100, nets / (debits * 1e4))):
            ordered = np.sort(values)
            out |= {f"{name}_{label}": _quantile(ordered, p) for label, p in _QUANTILES}
        if top:
            found = Counter()
            for name, size in zip(table["_pair"].to_pylist(), sizes.tolist()):
                found[name] += size
            ranked = sorted(found.items(), key=lambda r: (-r[1], r[0]))[:top]
            out["top_pairs"] = [{"pair": name, "count": size, "rate": size / n} for name, size in ranked] or None
        kept = {name: table.schema.field(name).type for name in groups}
        whole = lambda field: pa.int64() if isinstance(field.dataType, T.LongType) else pa.float64()
        return pa.table({f.name: pa.array([out[f.name]], kept.get(f.name) or kinds.get(f.name) or whole(f)) for f in schema.fields})

    return rows.groupBy(*groups).applyInArrow(side, schema)


def top_pairs(trials_table: DataFrame, *, key: str, limit: int = 5) -> DataFrame:
    """Most frequent leg pairs per (chain, direction, band); equal counts order by pair name."""
    groups = [key, "direction", "band"]
    pair = F.concat_ws("|", "long_symbol", "short_symbol")
    counts = _pack(trials_table, key).groupBy(*groups, pair.alias("pair")).agg(F.sum(F.size("nets")).alias("count"))
    whole = Window.partitionBy(*groups)
    ranked = counts.withColumn("rate", F.col("count") / F.sum("count").over(whole)).withColumn(
        "position", F.row_number().over(whole.orderBy(F.desc("count"), "pair"))
    )
    return ranked.where(F.col("position") <= limit)


def stress_report(
    chain: DataFrame,
    trials_table: DataFrame,
    baseline: DataFrame,
    *,
    key: str,
    policy: SpreadPolicy,
    trials: int,
    max_debit: str,
    bands: Sequence[Band] = BANDS,
    top: int = 5,
) -> DataFrame:
    """The whole study: each (chain, direction), with a row per band if its baseline is constructible.

    A side without a baseline has one row without band. Columns: contract_count, trials_per_band, the
    debit budget, baseline_constructible, the baseline's legs and figures (base_*), the band's widths,
    the columns of stress_summary, and top_pairs (array of pair, count, rate, most frequent first).
    `baseline` is best_verticals of the chain plus `max_debit` as max_net_debit. The table of trials is read
    once: summary and leg pairs of a side come from the same group.
    """
    figures = ("long_symbol", "short_symbol", "expiration", "net_delta", "net_debit", "delta_per_debit", "max_loss")
    counts = chain.groupBy(key).agg(F.count(F.lit(1)).alias("contract_count"), F.max(max_debit).alias("max_net_debit"))
    sides = counts.withColumn("direction", F.explode(F.array(F.lit("bullish"), F.lit("bearish")))).withColumn("trials_per_band", F.lit(trials))
    base = baseline.select(key, "direction", F.lit(True).alias("_has"), *[F.col(c).alias(f"base_{c}") for c in figures])
    named = sides.join(base, [key, "direction"], "left").withColumn("baseline_constructible", F.coalesce("_has", F.lit(False))).drop("_has")
    widths = F.array(*[F.struct(F.lit(b.name).alias("band"), *[F.lit(w).alias(n) for n, w in (
        ("midpoint_fraction", b.midpoint_fraction), ("spread_fraction", b.spread_fraction), ("delta_absolute", b.delta_absolute))]) for b in bands])
    per_band = named.withColumn("_w", F.explode_outer(F.when(F.col("baseline_constructible"), widths))).select("*", "_w.*").drop("_w")
    summary = stress_summary(trials_table, baseline, key=key, policy=policy, trials=trials, bands=bands, top=top)
    return per_band.join(summary, [key, "direction", "band"], "left")
