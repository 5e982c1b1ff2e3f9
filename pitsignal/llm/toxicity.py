"""Convolutional text classifier over hashed word embeddings, trained in numpy by tasks whose weights are averaged."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.session import cut_lineage

BUCKETS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
STEM = 4
COLUMNS = [(w, k) for w in WIDTHS for k in range(w)]  # a block of FILTERS bank columns each

SAMPLE = 6000  # labelled rows that give the starting weights, at most half of them of either label
SAMPLE_CHARS = 20_000_000  # and the characters in them
HELD = 5  # one labelled row in so many sets the thresholds instead
STEPS = 700  # batches for the starting weights, whatever the size of the sample
PASSES = 3  # parts of the labelled rows; after each the tasks' weights are averaged
PART_CHARS = 10_000_000  # of the texts that one task learns from in a pass
UNIT = 1 << 20  # changes of weights are whole numbers of this fraction, so their sums are exact
STEPS_A_UNIT = 64  # groups of scores in a unit of log odds, for the thresholds
BATCH = 64
MIN_TEXTS = 4  # for a bucket to be learned
RATE = 0.1
MIN_POSITIVES = 20  # of a language, to have a threshold of its own
CHUNK = 100_000  # words scored at once


def pair_of(word: str) -> tuple[int, int]:
    """Buckets of a lower-case word and of its first letters; bucket 0 is the blank word."""
    bare = word.strip(".,;:!?\"'()[]") or word
    whole = xxhash.xxh32_intdigest(bare.encode("utf-8", "surrogatepass"), 1)
    stem = xxhash.xxh32_intdigest(bare[:STEM].encode("utf-8", "surrogatepass"), 2)
    return 1 + whole % (BUCKETS - 1), 1 + stem % (BUCKETS - 1)


@dataclass
class Texts:
    """Texts as places in a list of distinct words; place 0 is a blank word and ends every text."""

    pairs: np.ndarray
    place: np.ndarray
    starts: np.ndarray


def index_texts(texts: Iterable[str | None]) -> Texts:
    known: dict[str, int] = {"": 0}
    place, starts = array("i"), array("q")
    for text in texts:
        starts.append(len(place))
        place.extend([known.setdefault(w, len(known)) for w in (text or "").lower().split()])
        place.append(0)
    pairs = np.zeros((len(known), 2), dtype=np.int32)
    for word, i in known.items():
        if i:
            pairs[i] = pair_of(word)
    return Texts(pairs, np.array(place, dtype=np.int32), np.array(starts, dtype=np.int64))


def bucket_codes(text: str | None) -> np.ndarray:
    """A number for the two buckets of each word of the text, and 0 for the blank word that ends it."""
    first = np.array([pair_of(w) for w in (text or "").lower().split()], dtype=np.int64).reshape(-1, 2)
    return np.append(first[:, 0] * BUCKETS + first[:, 1], 0)


def gather_texts(codes: list[np.ndarray]) -> Texts:
    """The same from bucket_codes of each text, where words of equal buckets are one."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    known, place = np.unique(np.concatenate([np.zeros(1, np.int64), *codes]), return_inverse=True)
    pairs = np.stack([known // BUCKETS, known % BUCKETS], axis=1).astype(np.int32)
    return Texts(pairs, place[1:].astype(np.int32), np.cumsum(sizes) - sizes)


def pieces(texts: Texts, chosen: np.ndarray, words: int) -> Iterator[Texts]:
    """The chosen texts in order, in pieces of about `words` words; a longer text is a piece of its own."""
    ends = np.append(texts.starts[1:], len(texts.place))
    at = 0
    while at < len(chosen):
        upto, size = at, 0
        while upto < len(chosen) and (upto == at or size + ends[chosen[upto]] - texts.starts[chosen[upto]] <= words):
            size += ends[chosen[upto]] - texts.starts[chosen[upto]]
            upto += 1
        own = chosen[at:upto]
        place = np.concatenate([texts.place[texts.starts[i] : ends[i]] for i in own])
        sizes = ends[own] - texts.starts[own]
        distinct, place = np.unique(np.append(0, place), return_inverse=True)
        yield Texts(texts.pairs[distinct], place[1:].astype(np.int32), np.cumsum(sizes) - sizes)
        at = upto


def window_sums(responses: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each width the filter responses of the windows that start at each place.

    A window beyond its text's end, or on the blank word, counts as zero: so a text without words
    has a response too, and no window crosses texts.
    """
    out, block = [], 0
    for width in WIDTHS:
        total = responses[:, block : block + FILTERS][place]
        whole = place != 0
        for offset in range(1, width):
            ahead = responses[:, block + offset * FILTERS : block + (offset + 1) * FILTERS][place[offset:]]
            total[:-offset] += ahead
            total[-offset:] = 0
            # a window whose later word is a blank has ended there
            whole[:-offset] &= place[offset:] != 0
            whole[-offset:] = False
        total[~whole] = 0
        out.append(total)
        block += width * FILTERS
    return out


@dataclass(frozen=True)
class ConvModel:
    """Embedding table, filter banks and output layer; a place for thresholds, which flag_evidence joins by language."""

    table: np.ndarray
    banks: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float]

    def log_odds(self, texts: Texts) -> np.ndarray:
        if not len(texts.starts):
            return np.zeros(0)
        embedded = self.table[texts.pairs[:, 0]] + self.table[texts.pairs[:, 1]]
        embedded[0] = 0
        sums = window_sums(embedded @ self.banks, texts.place)
        pooled = np.concatenate([np.maximum.reduceat(s, texts.starts, axis=0) for s in sums], axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


class _Adagrad:
    def __init__(self, seen: np.ndarray) -> None:
        self.seen = seen

    def step(self, grad: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        if rows is None:
            self.seen += grad * grad
            return RATE * grad / np.sqrt(self.seen)
        self.seen[rows] += grad * grad
        return RATE * grad / np.sqrt(self.seen[rows])


def descend(weights: list[np.ndarray], seen: list[np.ndarray], texts: Texts, labels: np.ndarray, batches: Iterable[np.ndarray], common: np.ndarray | None = None) -> None:
    """Stochastic gradient descent on the log loss, in place; only the window that won the pooling learns.

    `weights` are table, banks, bias, out and its bias, `seen` their sums of squares; with `common` only
    the buckets marked there learn.
    """
    table, banks, bias, out, out_bias = weights
    grad_table, grad_banks, grad_bias, grad_out, grad_last = (_Adagrad(s) for s in seen)
    ends = np.append(texts.starts[1:], len(texts.place))
    for batch in batches:
        sizes = ends[batch] - texts.starts[batch]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.concatenate([texts.place[texts.starts[b] : ends[b]] for b in batch])
        distinct, place = np.unique(np.append(0, place), return_inverse=True)
        place = place[1:]
        pairs = texts.pairs[distinct]
        embedded = table[pairs[:, 0]] + table[pairs[:, 1]]
        embedded[0] = 0
        sums = window_sums(embedded @ banks, place)
        best = [np.stack([s + total[s : s + n].argmax(axis=0) for s, n in zip(starts, sizes)]) for total in sums]
        pooled = np.concatenate([np.take_along_axis(t, b, axis=0) for t, b in zip(sums, best)], axis=1)
        z = pooled + bias
        active = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ out + out_bias, -30, 30)))
        g = ((p - labels[batch]) / len(batch)).astype(np.float32)
        back = g[:, None] * out * (z > 0)
        grad = np.zeros((len(distinct), banks.shape[1]), dtype=np.float32)
        block = 0
        for i, width in enumerate(WIDTHS):
            share, won = back[:, i * FILTERS : (i + 1) * FILTERS], best[i]
            columns = np.broadcast_to(np.arange(FILTERS), won.shape)
            share = np.where(np.take_along_axis(sums[i], won, axis=0) == 0, 0, share)
            for offset in range(width):
                spot = place[np.minimum(won + offset, len(place) - 1)]
                np.add.at(grad, (spot, columns + block), share)
                block += FILTERS
        grad[0] = 0
        touched = np.flatnonzero(grad.any(axis=1))
        rows, where = np.unique(pairs[touched], return_inverse=True)
        moved = np.zeros((len(rows), DIM), dtype=np.float32)
        toward = grad[touched] @ banks.T
        where = where.reshape(-1, 2)
        np.add.at(moved, where[:, 0], toward)
        np.add.at(moved, where[:, 1], toward)
        banks -= grad_banks.step(embedded.T @ grad)
        bias -= grad_bias.step(back.sum(axis=0))
        out -= grad_out.step(active.T @ g)
        out_bias -= grad_last.step(np.array([g.sum()]))
        learnt = np.ones(len(rows), dtype=bool) if common is None else common[rows]
        if learnt.any():
            table[rows[learnt]] -= grad_table.step(moved[learnt], rows[learnt])


def train(texts: Texts, labels: np.ndarray, chosen: np.ndarray, seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights and their sums of squares after STEPS batches of the chosen texts.

    A bucket found in fewer than MIN_TEXTS of the texts stays zero, so that words of one text are not
    learned by heart and unknown words are as good as blank.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    ends = np.append(texts.starts[1:], len(texts.place))
    found = np.zeros(BUCKETS, dtype=np.int32)
    for b in chosen:
        found[np.unique(texts.pairs[texts.place[texts.starts[b] : ends[b]]])] += 1
    common = found >= MIN_TEXTS
    table[~common] = 0
    banks = rng.normal(0, 0.5, (DIM, len(COLUMNS) * FILTERS)).astype(np.float32)
    bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
    out = rng.normal(0, 0.3, len(bias)).astype(np.float32)
    weights = [table, banks, bias, out, np.zeros(1, dtype=np.float32)]
    seen = [np.full(x.shape, 1e-3, dtype=np.float32) for x in weights]
    rounds = -(-STEPS * BATCH // len(chosen))
    order = np.concatenate([rng.permutation(chosen) for _ in range(rounds)])[: STEPS * BATCH]
    descend(weights, seen, texts, labels, (order[at : at + BATCH] for at in range(0, len(order), BATCH)), common)
    return weights, seen


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Score with the best F1; of equal ones the middle of the range up to the next lower score."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(f1.argmax())
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


def _sample(evidence: DataFrame, marks: DataFrame) -> tuple[list, float]:
    """Rows to start from (id, label, language, bucket codes), by a hash of the id, and the share of label 1 in all.

    The executors turn the words into buckets, so that the driver gets numbers only.
    """
    labelled = evidence.select("item_id", F.length("content").alias("_chars")).join(marks, "item_id")
    counts = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    picked: list[tuple[int, int]] = []
    for label in (0, 1):
        size = 0
        firsts = labelled.where((F.col("_label") == label) & (F.coalesce("_chars", F.lit(0)) <= SAMPLE_CHARS // 2)).orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE // 2)
        for row in firsts.select("item_id", "_chars").collect():
            chars = row["_chars"] or 0
            if size + chars > SAMPLE_CHARS // 2:
                continue  # a text that does not fit leaves its place to shorter ones
            size += chars
            picked.append((row["item_id"], label))
    if not picked:
        return [], 0.5
    spark = evidence.sparkSession
    ids = F.broadcast(spark.createDataFrame(picked, f"item_id {dict(evidence.dtypes)['item_id']}, _label int").dropDuplicates(["item_id"]))
    kind = dict(evidence.dtypes)["item_id"]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["item_id", "_label", "lang"]].assign(codes=[bucket_codes(t).tobytes() for t in batch["content"]])

    chosen = evidence.join(ids, "item_id").select("item_id", "_label", "lang", "content")
    rows = chosen.mapInPandas(number, f"item_id {kind}, _label int, lang string, codes binary").collect()
    return sorted(rows, key=lambda r: (xxhash.xxh32_intdigest(str(r["item_id"])), bytes(r["codes"]))), counts.get(1, 0) / total


def _chunks(texts: list, chars: int = 6 * CHUNK) -> Iterator[slice]:
    """Runs of the texts with about `chars` characters; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= chars):
            size += len(texts[upto] or "")
            upto += 1
        yield slice(at, upto)
        at = upto


def _learn_part(frames: Iterator[pd.DataFrame], weights: list[np.ndarray], seen: list[np.ndarray]) -> pd.DataFrame:
    """What the rows of a task change: bucket (below zero for the weights that are no embeddings), texts it was in, changes."""
    start, weights, seen = weights, [x.copy() for x in weights], [x.copy() for x in seen]
    found, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for frame in frames:
        contents, marks = frame["content"].tolist(), frame["_label"].to_numpy(dtype=np.float32)
        for run in _chunks(contents):
            texts, labels = index_texts(contents[run]), marks[run]
            ends = np.append(texts.starts[1:], len(texts.place))
            for first, end in zip(texts.starts, ends):
                found[np.unique(texts.pairs[texts.place[first:end]])] += 1
            own = np.arange(len(labels))
            descend(weights, seen, texts, labels, (own[at : at + BATCH] for at in range(0, len(own), BATCH)))
            rows += len(labels)
    if not rows:
        return pd.DataFrame({"bucket": [], "texts": [], **{f"d{i}": [] for i in range(DIM)}}).astype("int32")
    others = _joined(weights) - _joined(start)
    buckets = np.flatnonzero(found)
    places = np.concatenate([buckets, -1 - np.arange(len(others))])
    changes = np.rint(np.concatenate([(weights[0] - start[0])[buckets], others]).astype(float) * UNIT)
    texts_in = np.concatenate([found[buckets], np.full(len(others), rows)])
    return pd.DataFrame({"bucket": places, "texts": texts_in, **{f"d{i}": changes[:, i] for i in range(DIM)}}).astype("int32")


def _joined(weights: list[np.ndarray]) -> np.ndarray:
    """The weights beside the table, in rows as wide as an embedding."""
    flat = np.concatenate([x.ravel() for x in weights[1:]])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _learn_all(evidence: DataFrame, marks: DataFrame, weights: list[np.ndarray], seen: list[np.ndarray]) -> list[np.ndarray]:
    """The weights after each row of `marks` was learned from once, in PASSES parts.

    In a pass every task goes through its texts from the weights so far; the changes are averaged, those
    of a bucket by the number of texts that it was in. Tasks have about PART_CHARS characters, so the
    rows for the driver are bounded by BUCKETS and the work of a task does not grow. A bucket in fewer
    than MIN_TEXTS texts of all is zero in the end.
    """
    context, found = evidence.sparkSession.sparkContext, np.zeros(BUCKETS, dtype=np.int64)
    share = lambda rows, k: rows.where(F.pmod(F.xxhash64(F.lit("pass"), "item_id"), F.lit(PASSES)) == k)
    chars = evidence.select("item_id", F.length("content").alias("_chars")).join(marks, "item_id").agg(F.sum("_chars")).first()[0] or 0
    parts = -(-chars // (PASSES * PART_CHARS)) or 1
    columns = [f"d{i}" for i in range(DIM)]
    for k in range(PASSES):
        sent = context.broadcast((weights, seen))
        rows = share(evidence, k).select("item_id", "content").repartition(parts, "item_id").join(share(marks, k).repartition(parts, "item_id"), "item_id")
        # Spark deals a join into spark.sql.shuffle.partitions at least; fewer tasks send fewer changes
        rows = rows.coalesce(parts).sortWithinPartitions(F.xxhash64("item_id", "content"), "item_id", "content").select("content", "_label")
        changed = rows.mapInPandas(lambda frames, sent=sent: iter([_learn_part(frames, *sent.value)]), "bucket int, texts int, " + ", ".join(f"{c} int" for c in columns))
        texts = F.sum(F.col("texts").cast("long"))
        mean = [(F.sum(F.col("texts").cast("long") * F.col(c)) / (texts * UNIT)).cast("float").alias(c) for c in columns]
        got = changed.groupBy("bucket").agg(texts.alias("texts"), *mean).toArrow()
        sent.unpersist()
        if not got.num_rows:
            continue
        bucket, count = got["bucket"].to_numpy(), got["texts"].to_numpy()
        change = np.stack([got[c].to_numpy() for c in columns], axis=1)
        of_table = bucket >= 0
        weights = [x.copy() for x in weights]
        weights[0][bucket[of_table]] += change[of_table]
        found[bucket[of_table]] += count[of_table]
        others = _joined(weights)
        others[-1 - bucket[~of_table]] += change[~of_table]
        at = 0
        for i, x in enumerate(weights[1:], 1):
            weights[i] = others.ravel()[at : at + x.size].reshape(x.shape)
            at += x.size
    weights[0][found < MIN_TEXTS] = 0
    return weights


def learn(evidence: DataFrame, reviews: DataFrame, label: str) -> tuple[ConvModel, DataFrame] | None:
    """The model trained on all reviewed rows and the reviews (item_id, _label) for its thresholds; None unless both labels are reviewed."""
    marks = reviews.where(F.col(label).isin(0, 1)).groupBy("item_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    held = F.pmod(F.xxhash64(F.lit("held"), "item_id"), F.lit(HELD)) == 0
    # where the rows to learn from lack a label, all rows do both
    for learned, judged in ((marks.where(~held), marks.where(held)), (marks, marks)):
        rows, share = _sample(evidence, learned)
        labels = np.array([r["_label"] for r in rows], dtype=np.float32)
        if len(labels) and labels.min() != labels.max():
            break
    else:
        return None
    texts = gather_texts([np.frombuffer(r["codes"], np.int64) for r in rows])
    del rows
    weights, seen = train(texts, labels, np.arange(len(labels)))
    # the sample is balanced, the table is not: shift the intercept to the table's share of label 1
    sampled = labels.mean()
    weights[4] += np.float32(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    del texts
    table, banks, bias, out, last = _learn_all(evidence, learned, weights, seen)
    return ConvModel(table, banks, bias, out, float(last[0]), {"": 0.5}), judged


def best_thresholds(judged: DataFrame) -> DataFrame:
    """_lang, _limit: the score with the best F1 by language (of MIN_POSITIVES texts of label 1 at least) and, as null, over all.

    Expects lang, score, _label. As best_threshold, with equal scores as one: exact, from running counts over
    ranges of scores and inside each range, so that no task has all scores.
    """
    odds = F.log(F.greatest("score", F.lit(1e-300)) / F.greatest(1 - F.col("score"), F.lit(1e-300)))
    named = judged.where(F.coalesce("lang", F.lit("")) != "").select(F.col("lang").alias("_lang"), "score", "_label")
    every = judged.select(F.lit(None).cast("string").alias("_lang"), "score", "_label")
    counts = (F.count(F.lit(1)).alias("n"), F.sum("_label").alias("hits"))
    scores = named.unionByName(every).groupBy("_lang", "score").agg(*counts).withColumn("_range", F.floor(odds * STEPS_A_UNIT))
    ranges = scores.groupBy("_lang", "_range").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("score").alias("top"))
    down = Window.partitionBy("_lang").orderBy(F.desc("_range"))
    higher = down.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("_lang").alias("_own"),
        F.col("_range").alias("_part"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("hits").over(higher), F.lit(0)).alias("_hits"),
        F.coalesce(F.lead("top").over(down), F.lit(0.0)).alias("_next"),
        F.sum("hits").over(Window.partitionBy("_lang")).alias("_all"),
    )
    ranges = ranges.where((F.col("_all") >= MIN_POSITIVES) | (F.col("_own").isNull() & (F.col("_all") > 0)))
    inside = Window.partitionBy("_lang", "_range").orderBy(F.desc("score"))
    placed = scores.join(ranges, scores["_lang"].eqNullSafe(ranges["_own"]) & (scores["_range"] == ranges["_part"])).select(
        "_lang",
        "score",
        F.coalesce(F.lead("score").over(inside), F.col("_next")).alias("_below"),
        (2 * (F.col("_hits") + F.sum("hits").over(inside)) / (F.col("_n") + F.sum("n").over(inside) + F.col("_all"))).alias("_f1"),
    )
    best = placed.groupBy("_lang").agg(F.max(F.struct("_f1", "score", "_below")).alias("_best"))
    return best.select("_lang", ((F.col("_best.score") + F.col("_best._below")) / 2).alias("_limit"))


def flag_evidence(evidence: DataFrame, reviews: DataFrame, *, label: str) -> DataFrame:
    """Probability that a text is of the flagged kind (toxic), from a convolutional network.

    `evidence`: item_id, content, lang. `reviews`: item_id and `label` (0/1; others ignored); pass
    only the rows that may be learned from. The reference's records carry no such mark, so the label
    column is an argument. Returns item_id, score (0 to 1), predicted (score >= 0.5), threshold (of
    the row's language), flagged (score >= threshold), one row per evidence row.

    A word is the sum of two hashed embeddings (the word, its first letters); filters of widths 1 to
    3 slide over the whole text, their maxima feed a logistic output. The driver fits starting weights
    on at most SAMPLE reviewed rows and SAMPLE_CHARS characters; then tasks learn from all reviewed
    rows but one in HELD and their weights are averaged (see _learn_all). Those left out set the
    thresholds, all of them. The language picks a threshold only and never enters the score.

    Null or empty content has the score of a text without words. Unknown or null language takes the
    common threshold. Without reviews of both kinds every score is 0.5. An item reviewed twice
    counts once, as 1 if either says so. Repeated evidence rows are scored each. Other columns are ignored.
    """
    rows = evidence.select("item_id", "content", "lang")
    found = learn(rows, reviews.select("item_id", label), label)
    kind = dict(rows.dtypes)["item_id"]
    if found is None:
        return rows.select("item_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(0.5).alias("threshold"), F.lit(True).alias("flagged"))
    model, judged = found
    shared = evidence.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for batch in batches:
            texts = batch["content"].tolist()
            for run in _chunks(texts):
                odds = net.log_odds(index_texts(texts[run]))
                part = batch.iloc[run]
                yield pd.DataFrame({"item_id": part["item_id"], "lang": part["lang"], "score": 1 / (1 + np.exp(-np.clip(odds.astype(float), -500, 500)))})

    scored = cut_lineage(rows.mapInPandas(score, f"item_id {kind}, lang string, score double"))
    limits = cut_lineage(best_thresholds(scored.join(judged, "item_id")))
    common = limits.where("_lang is null").first()
    scored = scored.join(limits.where("_lang is not null"), F.col("lang") == F.col("_lang"), "left")
    scored = scored.withColumn("threshold", F.coalesce("_limit", F.lit(common["_limit"] if common else 0.5)))
    return scored.select(
        "item_id",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        (F.col("score") >= F.col("threshold")).alias("flagged"),
    )
