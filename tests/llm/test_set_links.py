"""The signature join and its confirmation against all pairs."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from pitsignal.llm import set_links as sl

SMALL = "/root/testdata/sf0.001"


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=3, percent=85, empty_linked=False):
    """(id, set size, component) of every row by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a and b and 100 * len(a & b) >= percent * len(a | b)) or (empty_linked and not a and not b):
                root[find(i)] = find(j)
    out = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((name, len(sets[i]), min(ids) if ids and (sets[i] or empty_linked) else name))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r.item_id, r.n_shingles, r.component_id) for r in frame.collect()), key=repr)


def test_op11_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = brute([(d.doc_id, d.text) for d in docs])
    got = entry.queries()["op11_minhash_near_dedup"](spark, SMALL).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def families(seed, n_families, members, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n_families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("shingle, percent, crowd, loads", [(3, 85, 4096, 2_000_000), (3, 85, 6, 2_000_000), (5, 80, 4096, 400)])
def test_families_of_near_texts(spark, shingle, percent, crowd, loads):
    """Families at the bound of the similarity, buckets and groups also cut into parts of a few rows."""
    rows = families(shingle + crowd, 12, 25)
    frame = spark.createDataFrame(rows, "item_id long, content string").repartition(6)
    got = result(sl.link_evidence(frame, shingle=shingle, percent=percent, crowd=crowd, crowd_shingles=loads, fingerprints_too=crowd == 6))
    assert got == brute(rows, shingle, percent)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 977} y{i % 31}" for i in range(120_000))
    rows = [(None, None), (None, ""), (4, " \t"), (4, "one two"), (9, "ONE  two"), (None, "One two"), (3, "two one"), (7, "same id other text here now"),
            (7, "quite another text with id seven"), (5, "quite another text with id seven"), (11, long), (12, long + " end"), (13, "É é"), (14, "é é"), (None, "alone"), (None, "alone")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, content string, node int, root string").repartition(3)
    assert result(sl.link_evidence(frame)) == brute(rows)
    assert result(sl.link_evidence(frame, empty_linked=True)) == brute(rows, empty_linked=True)
    assert sl.link_evidence(frame.limit(0)).collect() == []


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, sl.SYMBOLS).astype("<u2")
    others = np.repeat(base[None], 3000, axis=0)
    for i in range(len(others)):
        places = rng.choice(sl.SYMBOLS, size=sl.radius() if i % 2 else rng.integers(0, sl.radius() + 1), replace=False)
        others[i, places] += 1
    keys = sl.chunk_keys(np.concatenate([base[None], others]))
    assert (keys[1:] == keys[0]).any(axis=1).all()


def test_crowded_buckets_lose_no_component():
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 1 << 16, (6, sl.SYMBOLS))
    rows = []
    for b in bases:
        for _ in range(40):
            own = b.copy()
            own[rng.choice(sl.SYMBOLS, size=rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 16)
            rows.append(own)
    signatures = rng.permutation(np.array(rows)).astype("<u2")
    near = (signatures[:, None] != signatures[None]).sum(axis=2) <= sl.radius()
    want = sl.merge(np.arange(len(signatures)), *np.nonzero(near))
    assert (sl.crowd_labels(signatures, sl.radius()) == want).all()
    node = np.arange(len(signatures)) * 10
    for small in (2, 1000):
        a, b = sl.bucket_stars(np.zeros(len(node), int), node, signatures, sl.radius(), small)
        got = np.arange(len(node))
        got[a // 10] = b // 10
        assert (got == want).all()


def test_signature_of_a_set_in_pieces(monkeypatch):
    tokens = np.sort(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    whole = sl.signature(tokens)
    monkeypatch.setattr(sl, "_PART", 64)
    assert (sl.signature(tokens) == whole).all()
