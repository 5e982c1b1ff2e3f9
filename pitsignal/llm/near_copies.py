"""SimHash fingerprints of evidence, linked exactly within a Hamming radius through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.session import cut_lineage

RADIUS = 2
SHINGLE = 3
SEED = 42
FIT_SAMPLE = 20_000  # distinct fingerprints that place the shared tree's vantage points
LEAF = 8_192  # fingerprints aimed at in a shard of the shared tree
BRUTE = 1_024  # a set this small, or one that no vantage point divides, is compared block by block
BLOCK = 1_024

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 values of the text's word shingles, repeats included."""
    normal = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not normal:
        return 0
    ends = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32).tolist()
    ends.append(len(normal))
    if len(ends) <= shingle:
        return xxhash.xxh64_intdigest(normal, SEED)
    digest = xxhash.xxh64_intdigest
    begins = [0, *[e + 1 for e in ends[: -shingle]]]
    hashes = np.array([digest(normal[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :])], dtype="<u8")
    per_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (per_byte @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(evidence: DataFrame) -> DataFrame:
    """item_id and `bits`, the fingerprint as a signed 64-bit integer."""
    kind = dict(evidence.dtypes)["item_id"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(t) for t in batch["content"]], dtype=np.uint64)
            yield pd.DataFrame({"item_id": batch["item_id"], "bits": bits.view(np.int64)})

    return evidence.select("item_id", "content").mapInPandas(build, f"item_id {kind}, bits long")


@dataclass(frozen=True)
class Node:
    """A vantage point and the distance that divides its set; a leaf has a shard number only."""

    shard: int = -1
    vantage: int = 0
    middle: int = 0
    near: Node | None = None
    far: Node | None = None


def distances(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


def divide(points: np.ndarray, rng: np.random.Generator, radius: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Vantage point, middle distance, and the two overlapping parts, or None if no part gets small.

    By the triangle bound two points within `radius` have distances from the vantage point that
    differ by no more than it. The far part therefore starts `radius` below the middle, and any
    such pair is whole in one part.
    """
    best = None
    for vantage in rng.choice(points, size=min(8, len(points)), replace=False):
        d = distances(points, int(vantage))
        for middle in {int(np.median(d)), int(np.quantile(d, 0.35)), int(np.quantile(d, 0.65))}:
            near, far = d <= middle, d > middle - radius
            worst = max(near.sum(), far.sum())
            if best is None or worst < best[0]:
                best = (worst, int(vantage), middle, near, far)
    if best is None or best[0] > 0.9 * len(points):
        return None
    return best[1:]


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator, radius: int) -> Node:
    """Tree over a sample; its leaves, numbered from left to right, are the shards."""
    count = 0

    def build(part: np.ndarray) -> Node:
        nonlocal count
        halves = divide(part, rng, radius) if len(part) > leaf else None
        if halves is None:
            count += 1
            return Node(shard=count - 1)
        vantage, middle, near, far = halves
        return Node(-1, vantage, middle, build(part[near]), build(part[far]))

    return build(points)


def route(tree: Node, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the points and the shards they belong to; near a boundary a point has several."""
    index, shard = [], []

    def walk(node: Node, own: np.ndarray) -> None:
        if node.near is None:
            index.append(own)
            shard.append(np.full(len(own), node.shard, dtype=np.int64))
            return
        d = distances(points[own], node.vantage)
        walk(node.near, own[d <= node.middle])
        walk(node.far, own[d > node.middle - radius])

    walk(tree, np.arange(len(points)))
    return np.concatenate(index), np.concatenate(shard)


def merge(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each x and y; a label is the first point of its component."""
    while True:
        high, low = np.maximum(labels[x], labels[y]), np.minimum(labels[x], labels[y])
        apart = high != low
        if not apart.any():
            return labels
        x, y = x[apart], y[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def link(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct points the first point of its component within this set.

    Sets are divided by vantage points, with overlap, until they are small; then all pairs of a set
    are compared in blocks. The memory is bounded by the points and one block.
    """
    labels = np.arange(len(points))
    rng = np.random.default_rng(SEED)
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        halves = divide(points[own], rng, radius) if len(own) > BRUTE else None
        if halves is not None:
            stack += [own[halves[2]], own[halves[3]]]
            continue
        for i in range(0, len(own), BLOCK):
            for j in range(i, len(own), BLOCK):
                a, b = own[i : i + BLOCK], own[j : j + BLOCK]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= radius)
                labels = merge(labels, a[x], b[y])
    return labels


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b) of fingerprints with a != b whose closure joins all pairs within RADIUS.

    Every shard of the shared tree yields a star per component: at most one row per fingerprint.
    """
    n = distinct.count()
    if n < 2:
        return distinct.select(F.col("bits").alias("a"), F.col("bits").alias("b")).limit(0)
    fraction = min(1.0, 1.1 * FIT_SAMPLE / n)
    chosen = F.pmod(F.xxhash64("bits"), F.lit(1 << 30)) < int(fraction * (1 << 30))
    sample = distinct.where(chosen).limit(FIT_SAMPLE).select("bits").toPandas()["bits"].to_numpy(np.int64).view(np.uint64)
    leaf = max(16, int(LEAF * len(sample) / n))
    tree = grow(np.sort(sample), leaf, np.random.default_rng(SEED), RADIUS)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = batch["bits"].to_numpy(np.int64)
            index, shard = route(tree, bits.view(np.uint64))
            yield pd.DataFrame({"bits": bits[index], "shard": shard})

    def stars(batch: pd.DataFrame) -> pd.DataFrame:
        bits = np.sort(batch["bits"].to_numpy(np.int64))
        root = link(bits.view(np.uint64))
        other = root != np.arange(len(bits))
        return pd.DataFrame({"a": bits[other], "b": bits[root[other]]})

    dealt = distinct.select("bits").mapInPandas(deal, "bits long, shard long")
    return dealt.groupBy("shard").applyInPandas(stars, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """bits and the smallest fingerprint reachable, for every fingerprint in a pair.

    Each round every node takes the smallest label among itself and its neighbours, then the label
    of its label, so that chains shorten by halves; labels only fall, and a round without a change
    ends it. Only linked fingerprints take part.
    """
    edges = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    nearest = edges.groupBy("a").agg(F.min("b").alias("_near"))
    labels = cut_lineage(nearest.select(F.col("a").alias("bits"), F.least("a", "_near").alias("root")))
    while True:
        seen = edges.join(labels, edges["b"] == labels["bits"]).groupBy(F.col("a").alias("bits")).agg(F.min("root").alias("_near"))
        near = labels.join(seen, "bits").select("bits", F.col("root").alias("_old"), F.least("root", "_near").alias("_new"))
        jump = labels.select(F.col("bits").alias("_at"), F.col("root").alias("_further"))
        step = near.join(jump, near["_new"] == jump["_at"], "left").select(
            "bits", F.least("_new", F.coalesce("_further", "_new")).alias("root"), "_old"
        )
        step = cut_lineage(step)
        changed = step.where(F.col("root") != F.col("_old")).limit(1).count()
        labels = step.select("bits", "root")
        if not changed:
            return labels


def near_copies(evidence: DataFrame) -> DataFrame:
    """Fingerprint and near-copy component of every evidence item.

    Expects item_id (integer) and content. Texts are lower-cased in A-Z, words are runs of
    characters other than U+0020 and U+0009..U+000D, shingles have three words (a shorter text is
    one shingle, a text without words has fingerprint zero). Fingerprints that differ in at most two
    bits are linked. Returns item_id, fingerprint (16 hex digits), component_id (smallest item_id
    reachable over links, itself included), one row per input row.

    Null content counts as empty. Equal texts and repeated rows share a fingerprint, so a group of
    copies of any size is one fingerprint before the search. A null item_id never names a component
    unless all its members are null. An empty table gives an empty result. Other columns are
    ignored. Only a bounded sample of fingerprints reaches the driver, to place vantage points.
    """
    marked = cut_lineage(fingerprints(evidence))
    firsts = cut_lineage(marked.groupBy("bits").agg(F.min("item_id").alias("first_id")))
    roots = components(linked_pairs(firsts))
    rooted = firsts.join(roots, "bits", "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select(
        "item_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
