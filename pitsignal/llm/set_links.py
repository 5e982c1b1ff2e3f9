"""Links between texts of similar shingle sets: a Hamming join of b-bit MinHash signatures, confirmed on the sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.near_copies import components, fingerprint, linked_pairs, merge
from pitsignal.session import cut_lineage

SHINGLE = 3
PERCENT = 85
SYMBOLS = 40  # 16-bit values of a signature
CHUNK = 4  # of them in a chunk
ERRORS = 1  # differing values allowed within a chunk
CROWD = 4096  # signatures of a bucket, or sets of a group, compared in one task
CROWD_SHINGLES = 2_000_000  # and shingles in a group's sets
SMALL = 24  # buckets up to this size are compared together
BROADCAST_KEYS = 2_000_000  # texts to fetch up to which their keys are sent to all workers

SEED = 42

_P = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(11).integers(0, 1 << 63, (2, SYMBOLS), dtype=np.uint64)
_XOR, _TIMES = _DRAWN[0][:, None], (_DRAWN[1] | np.uint64(1))[:, None]
_PART = 8192


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; words as in near_copies, a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    digest = xxhash.xxh64_intdigest
    hashed = np.array([digest(w, SEED) for w in words], np.uint64)
    n = len(words) - shingle + 1
    out = np.zeros(n, np.uint64)
    for j in range(shingle):
        out = (out ^ hashed[j : j + n]) * _P
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def radius(symbols: int = SYMBOLS, chunk: int = CHUNK, errors: int = ERRORS) -> int:
    """Differing values that signatures may have so that some chunk must have `errors` at most."""
    return symbols // chunk * (errors + 1) - 1


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the set's least value under each of SYMBOLS hash functions."""
    tokens = hashes.view(np.uint64)
    least = np.full(SYMBOLS, ~np.uint64(0))
    for at in range(0, len(tokens), _PART):
        least = np.minimum(least, ((tokens[at : at + _PART] ^ _XOR) * _TIMES).min(axis=1))
    return (least & np.uint64(0xFFFF)).astype("<u2")


def chunk_keys(signatures: np.ndarray, chunk: int = CHUNK, errors: int = ERRORS) -> np.ndarray:
    """For every signature the keys of its chunks with any `errors` of their values left out.

    Two signatures that differ in `errors` values of a chunk at most have one of its keys in common;
    keys are 64-bit hashes, so that a chance meeting costs a comparison only.
    """
    keys = []
    values = signatures.astype(np.uint64)
    for at in range(0, values.shape[1] - chunk + 1, chunk):
        for kept in combinations(range(at, at + chunk), chunk - errors):
            key = np.full(len(values), len(keys) + 1, np.uint64) * _P
            for place in kept:
                key = (key ^ values[:, place]) * _P
                key ^= key >> np.uint64(29)
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def crowd_labels(signatures: np.ndarray, within: int) -> np.ndarray:
    """Component labels of a large bucket: all are compared with a pivot, and those far from it with all."""
    labels = np.arange(len(signatures))
    near = np.zeros(0, bool)
    for pivot in np.linspace(0, len(signatures) - 1, 4).astype(int):
        own = (signatures != signatures[pivot]).sum(axis=1) <= within
        if own.sum() > near.sum():
            near, best = own, pivot
    labels = merge(labels, np.full(near.sum(), best), np.flatnonzero(near))
    rest = np.flatnonzero(~near)
    for at in range(0, len(rest), 32):
        part = rest[at : at + 32]
        x, y = np.nonzero((signatures[part][:, None, :] != signatures[None]).sum(axis=2) <= within)
        labels = merge(labels, part[x], y)
    return labels


def bucket_stars(bucket: np.ndarray, node: np.ndarray, signatures: np.ndarray, within: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, first node) that join all nodes whose signatures are near and share one of the sorted buckets."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, len(bucket)))
    size = np.repeat(sizes, sizes)
    place = np.arange(len(bucket)) - np.repeat(starts, sizes)
    x, y = [], []
    for ahead in range(1, small):
        i = np.flatnonzero((size <= small) & (place + ahead < size))
        if not len(i):
            break
        i = i[(signatures[i] != signatures[i + ahead]).sum(axis=1) <= within]
        x.append(i)
        y.append(i + ahead)
    for start, n in zip(starts[sizes > small], sizes[sizes > small]):
        labels = crowd_labels(signatures[start : start + n], within)
        x.append(start + np.arange(n))
        y.append(start + labels)
    distinct, at = np.unique(node, return_inverse=True)
    if not x:
        return distinct[:0], distinct[:0]
    labels = merge(np.arange(len(distinct)), at[np.concatenate(x)], at[np.concatenate(y)])
    other = labels != np.arange(len(distinct))
    return distinct[other], distinct[labels[other]]


def set_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component labels over all pairs of the non-empty sets with 100 * shared >= percent * union.

    All are compared with a pivot, and those not linked to it with all: a link that joins two
    components has an end outside the pivot's.
    """
    sizes = np.array([len(s) for s in sets])
    labels = np.arange(len(sets))
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return labels * (100 * shared < percent * (sizes.sum() - shared))
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes

    def linked(i: int) -> np.ndarray:
        mark = np.zeros(len(known), np.int32)
        mark[at[starts[i] : starts[i] + sizes[i]]] = 1
        shared = np.add.reduceat(mark[at], starts)
        return np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes - shared))

    pivot = int(np.argsort(sizes, kind="stable")[len(sizes) // 2])
    first = linked(pivot)
    labels = merge(labels, np.full(len(first), pivot), first)
    for i in np.setdiff1d(np.arange(len(sets)), first):
        own = linked(int(i))
        labels = merge(labels, np.full(len(own), i), own)
    return labels


def whole_groups(batches: Iterator[pd.DataFrame], group: str, once: list[str] | None = None) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, from batches sorted by group; rows equal in `once` are taken once."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if once:
            held = held.drop_duplicates(once)
        open_ = (held[group] == held[group].iloc[-1]).to_numpy()
        if not open_.all():
            yield held[~open_]
            held = held[open_]
    if held is not None:
        yield held


def _marked(evidence: DataFrame, shingle: int, with_bits: bool) -> DataFrame:
    """item_id, text_key, node (hash of the shingle set), n (its size), signature and bits (SimHash) of every row."""
    kind = dict(evidence.dtypes)["item_id"]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sizes, signatures, bits = [], [], [], []
            for text in batch["content"]:
                hashes = shingle_hashes(text, shingle)
                nodes.append(set_id(hashes))
                sizes.append(len(hashes))
                signatures.append(signature(hashes).tobytes())
                bits.append(fingerprint(text, shingle) if with_bits else 0)
            yield pd.DataFrame(
                {
                    "item_id": batch["item_id"],
                    "text_key": batch["text_key"],
                    "node": nodes,
                    "n": sizes,
                    "signature": signatures,
                    "bits": np.array(bits, np.uint64).view(np.int64),
                }
            )

    return evidence.select("item_id", "content", F.xxhash64("content").alias("text_key")).mapInPandas(
        mark, f"item_id {kind}, text_key long, node long, n long, signature binary, bits long"
    )


def _spread(bucket: Column, n: Column, by: Column, crowd: int) -> Column:
    """The buckets of a row: its own, or if that holds over `crowd` rows, those of all pairs of its part with a part."""
    parts = F.ceil(n / F.lit(crowd // 2)).cast("long")
    part = F.pmod(F.xxhash64(by), parts)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.xxhash64(bucket, F.least(part, j), F.greatest(part, j)))
    return F.when(n <= crowd, F.array(bucket)).otherwise(pairs)


def _candidates(nodes: DataFrame, crowd: int) -> DataFrame:
    """(a, b): stars that join all nodes within the signature radius of one another."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = chunk_keys(np.frombuffer(b"".join(batch["signature"]), "<u2").reshape(len(batch), SYMBOLS))
                yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(batch["node"].to_numpy(), keys.shape[1])})

    within = radius()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, "bucket"):
            signatures = np.frombuffer(b"".join(whole["signature"]), "<u2").reshape(len(whole), SYMBOLS)
            a, b = bucket_stars(whole["bucket"].to_numpy(), whole["node"].to_numpy(), signatures, within)
            yield pd.DataFrame({"a": a, "b": b})

    postings = cut_lineage(nodes.select("node", "signature").mapInPandas(post, "key long, node long"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    dealt = postings.join(shared, "key").select("node", F.explode(_spread(F.col("key"), F.col("met"), F.col("node"), crowd)).alias("bucket"))
    signed = dealt.join(nodes.select("node", "signature"), "node").select("bucket", "node", "signature")
    return signed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(meet, "a long, b long").distinct()


def _thinned(stars: DataFrame) -> DataFrame:
    """The same components from fewer edges: a node keeps its smallest root, to which its other roots are tied.

    A family shares many buckets, each with a root of its own: so every member comes with many roots.
    """
    stars = cut_lineage(stars)
    least = stars.groupBy("a").agg(F.min("b").alias("_least"))
    tied = stars.join(least, "a").where(F.col("b") != F.col("_least")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return least.select("a", F.col("_least").alias("b")).union(tied.distinct())


def _near_bits(nodes: DataFrame) -> DataFrame:
    """(a, b) that join nodes whose SimHash fingerprints the vantage-point search links."""
    firsts = cut_lineage(nodes.groupBy("bits").agg(F.min("node").alias("least")))
    same = nodes.join(firsts, "bits").where(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = linked_pairs(firsts.select("bits"))
    left = firsts.select(F.col("bits").alias("a"), F.col("least").alias("_a"))
    right = firsts.select(F.col("bits").alias("b"), F.col("least").alias("_b"))
    return same.union(near.join(left, "a").join(right, "b").select("_a", "_b"))


def _confirmed(evidence: DataFrame, nodes: DataFrame, grouped: DataFrame, shingle: int, percent: int, crowd: int, crowd_shingles: int) -> tuple[DataFrame, bool]:
    """(a, b): stars that join all nodes of a candidate group linked on the whole sets, and whether a group was cut."""
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    # the crowd that the group has room for, in sets, as a count of parts
    load = F.greatest(F.col("sets"), F.ceil(F.col("shingles") * crowd / F.lit(crowd_shingles)))
    sizes = cut_lineage(sizes.withColumn("load", load.cast("long")))
    cut = bool(sizes.where(F.col("load") > crowd).limit(1).count())
    wanted = grouped.join(sizes.select("root", "load"), "root")
    wanted = cut_lineage(wanted.select(F.col("item_id").alias("_id"), F.col("text_key").alias("_key"), "node", F.explode(_spread(F.col("root"), F.col("load"), F.col("node"), crowd)).alias("group")))
    few = wanted.count() <= BROADCAST_KEYS
    texts = evidence.select("item_id", "content", F.xxhash64("content").alias("text_key"))
    match = (texts["text_key"] == wanted["_key"]) & texts["item_id"].eqNullSafe(wanted["_id"])
    rows = texts.join(F.broadcast(wanted) if few else wanted, match).select("group", "node", "content")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, "group", ["group", "node"]):
            a, b = [], []
            for _, own in whole.groupby("group", sort=False):
                if len(own) > 1:
                    names = own["node"].to_numpy()
                    labels = set_labels([shingle_hashes(t, shingle) for t in own["content"]], percent)
                    other = labels != np.arange(len(labels))
                    a.append(names[other])
                    b.append(names[labels[other]])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return cut_lineage(rows.repartition("group").sortWithinPartitions("group").mapInPandas(confirm, "a long, b long")), cut


def link_evidence(
    evidence: DataFrame,
    *,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    fingerprints_too: bool = False,
    empty_linked: bool = False,
    crowd: int = CROWD,
    crowd_shingles: int = CROWD_SHINGLES,
) -> DataFrame:
    """Component of every evidence item over links between texts with similar shingle sets.

    Expects item_id (any ordered type) and content. Texts are lower-cased in A-Z; words are runs of
    characters other than U+0020 and U+0009..U+000D; a text's set holds its different runs of
    `shingle` words, of a shorter text the whole text. Texts are linked if 100 * shared shingles >=
    percent * shingles of either. Returns item_id, n_shingles and component_id (smallest item_id
    reachable, itself included), one row per input row.

    A set's signature is the low 16 bits of its least value under 40 hash functions. Signatures are
    cut into ten chunks of four; two that differ in 19 values at most have a chunk with one error at
    most, so they share a key of three of its values, and none of those pairs is missed. A pair of
    85 percent exceeds 19 with odds of 2 in ten million, one of 80 percent with 2 in a hundred
    thousand; a link counts only when the whole sets confirm it. `fingerprints_too` adds the groups
    of the vantage-point search over SimHash fingerprints to the candidates.

    Equal sets are one node, so copies cost nothing more. Buckets and candidate groups yield stars,
    never all their pairs; one of over `crowd` nodes (or `crowd_shingles`) is cut into parts, and all
    pairs of parts are compared. Null content counts as empty. Items without words are components
    of their own, or one of all of them if `empty_linked`. A null item_id names a component only if
    all its members are null. Repeated rows share a component. An empty table gives an empty
    result. Other columns are ignored, whatever their name.
    """
    evidence = evidence.select("item_id", "content")
    marked = cut_lineage(_marked(evidence, shingle, fingerprints_too))
    one = F.min(F.struct(F.col("item_id").isNull().alias("_null"), "item_id", "text_key")).alias("_one")
    same = [F.first(c).alias(c) for c in ("n", "signature")]
    least_bits = [F.min("bits").alias("bits")]
    nodes = marked.where("n > 0").groupBy("node").agg(one, *same, *least_bits)
    nodes = cut_lineage(nodes.select("node", "_one.item_id", "_one.text_key", "n", "signature", "bits"))
    near = _candidates(nodes, crowd)
    if fingerprints_too:
        near = near.union(_near_bits(nodes))
    roots = components(_thinned(near)).select(F.col("bits").alias("node"), "root")
    grouped = cut_lineage(nodes.select("node", "item_id", "text_key", "n").join(roots, "node"))
    links, cut = _confirmed(evidence, nodes, grouped, shingle, percent, crowd, crowd_shingles)
    # stars of whole groups are components already
    linked = components(links).select(F.col("bits").alias("_node"), F.col("root").alias("_root")) if cut else links.select(F.col("a").alias("_node"), F.col("b").alias("_root"))
    rooted = nodes.join(linked, nodes["node"] == linked["_node"], "left").select("node", "item_id", F.coalesce("_root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("item_id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    if empty_linked:
        none = marked.where("n = 0").groupBy("node").agg(F.min("item_id").alias("component_id"))
        named = named.union(none)
    found = marked.select("item_id", "node", "n").join(named, "node", "left")
    own = F.when((F.col("n") == 0) & F.lit(not empty_linked), F.col("item_id")).otherwise(F.col("component_id"))
    return found.select("item_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
