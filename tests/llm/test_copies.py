"""Near copies, fingerprints and line frequencies against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from pitsignal.llm import near_copies as nc
from pitsignal.llm.boilerplate import drop_boilerplate
from pitsignal.llm.fingerprints import fingerprint_evidence
from pitsignal.llm.set_links import link_evidence

SMALL = "/root/testdata/sf0.001"


def brute_bits(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits):
    n = len(bits)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= nc.RADIUS:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_op5_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    bits = [brute_bits(d.text) for d in docs]
    ids = [d.doc_id for d in docs]
    want = {ids[i]: (format(bits[i], "016x"), ids[r]) for i, r in enumerate(brute_components(bits))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op5_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("spread", [2, 4, 64])
def test_tree_loses_no_link(spread):
    """Clusters of near points and random points: tree shards, and division inside a shard, find all links."""
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**64, 60, dtype=np.uint64)
    points = [int(c) for c in centres]
    for c in points[:60]:
        for _ in range(60):
            p = c
            for b in rng.choice(64, size=min(spread, rng.integers(1, 5)), replace=False):
                p ^= 1 << int(b)
            points.append(p)
    points = np.unique(np.array(points, dtype=np.uint64))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= nc.RADIUS
    tree = nc.grow(points[::2], 40, rng, nc.RADIUS)
    index, shard = nc.route(tree, points)
    member = np.zeros((len(points), shard.max() + 1), dtype=bool)
    member[index, shard] = True
    assert ((member.astype(int) @ member.T.astype(int) > 0) | ~near).all()
    labels = np.arange(len(points))
    x, y = np.nonzero(near)
    want = nc.merge(labels, x, y)
    nc_brute, nc.BRUTE = nc.BRUTE, 50
    try:
        assert (nc.link(points) == want).all()
    finally:
        nc.BRUTE = nc_brute


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(-40, 40)] + [(100, 101)]
    got = {r.bits: r.root for r in nc.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: -40 for i in range(-40, 41)}, 100: 100, 101: 100}


def test_near_copies_odd_rows(spark):
    rows = [(None, None), (None, ""), (4, ""), (4, ""), (7, "A b C"), (9, "a B c"), (8, "only")]
    frame = spark.createDataFrame(rows, "item_id long, content string").selectExpr("*", "1 as bits", "2 as component_id")
    got = sorted(((r.item_id, r.fingerprint == "0" * 16, r.component_id) for r in nc.near_copies(frame).collect()), key=str)
    assert got == sorted([(None, True, 4), (None, True, 4), (4, True, 4), (4, True, 4), (7, False, 7), (9, False, 7), (8, False, 8)], key=str)
    assert nc.near_copies(frame.limit(0)).count() == 0


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_op8_texts_and_likeness(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    frame = spark.createDataFrame([(d.doc_id, d.text) for d in docs], "item_id long, content string").repartition(7)
    got = {r.item_id: r for r in fingerprint_evidence(frame, rows=17).collect()}
    errors = []
    for d, e in zip(docs, docs[1:] + docs[:1]):
        r, m = got[d.doc_id], len(d.text) // 2
        edited = d.text[: len(d.text) - m] + e.text[:m]
        assert r.n_chars == len(d.text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, e.text)):
            a, b = shingles(d.text), shingles(other)
            errors.append(near - len(a & b) / len(a | b))
    assert np.abs(errors).max() < 0.25
    assert abs(np.mean(errors)) < 0.02
    by_text = {}
    for d in docs:
        assert by_text.setdefault(d.text, got[d.doc_id].fingerprint) == got[d.doc_id].fingerprint


def test_fingerprints_odd_rows(spark):
    rows = [(None, "one two"), (3, None), (3, ""), (5, "a b c d e f"), (6, "a b c d e f")]
    frame = spark.createDataFrame(rows, "item_id long, content string").selectExpr("*", "1 as _text", "2 as fingerprint")
    got = fingerprint_evidence(frame.select("item_id", "content", "fingerprint"), rows=2).collect()
    assert len(got) == 5
    assert [r.near_next for r in got if r.item_id == 5] == [1.0]
    assert all(r.fingerprint == "" for r in got if r.item_id == 3)
    alone = fingerprint_evidence(frame.where("item_id = 5")).collect()
    assert alone[0].near_next == 1.0 and alone[0].near_edited < 1.0
    assert fingerprint_evidence(frame.limit(0)).count() == 0


def test_boilerplate_by_tool(spark):
    rows = [(i, "news" if i < 20 else None, f"unique {i}\n  share this  \n\nbody {i % 3}") for i in range(40)]
    rows += [(90, "news", None), (91, "news", ""), (92, "rare", "share this\nx"), (93, "news", "share this")]
    frame = spark.createDataFrame(rows, "item_id long, tool string, content string").selectExpr("*", "7 as n_dropped", "'z' as total")
    got = {r.item_id: r for r in drop_boilerplate(frame, max_ratio=0.5, min_items=10).collect()}
    pages = Counter(r[1] for r in rows)
    assert pages["news"] == 23
    for i in range(40):
        assert got[i].content == f"unique {i}\n\nbody {i % 3}" and got[i].n_dropped == 1 and got[i].total == "z"
    assert got[90].content is None and got[90].n_dropped == 0 and got[90].n_lines == 0
    assert got[91].content == "" and got[92].content == "share this\nx" and got[93].content == ""
    assert drop_boilerplate(frame.limit(0)).count() == 0


def brute_similar(rows):
    """item_id to the smallest item_id reachable over Jaccard 0.8 on five-word shingles, all pairs compared."""
    sets = [shingles((t or "").lower()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for (item, _), r in zip(rows, root):
        least[r] = min(least.get(r, item), item)
    return {item: least[r] for (item, _), r in zip(rows, root)}


def edited_texts():
    """Texts with one to nine changed words, of which two-bit fingerprints link next to none, and a shared passage."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words, 40))
    rows = []
    for base in range(12):
        text = list(rng.choice(words, 160))
        for copy in range(9):
            edited = list(text)
            for at in rng.choice(160, copy, replace=False):
                edited[at] = f"x{base}-{copy}-{at}"
            rows.append((1000 - len(rows), f"{passage} {' '.join(edited)}"))
    return rows + [(5, None), (6, ""), (7, "Short text"), (8, "short  TEXT")]


def test_similar_texts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    for rows in (edited_texts(), [(d.doc_id, d.text) for d in docs]):
        frame = spark.createDataFrame(rows, "item_id long, content string").repartition(5)
        want = brute_similar(rows)
        twice = frame.unionByName(frame.limit(1)).union(spark.createDataFrame([(None, "Short text")], frame.schema))
        got = link_evidence(twice, shingle=5, percent=80, fingerprints_too=True, empty_linked=True)
        short = {7} if rows[0][0] == 1000 else {None}
        found = {(r.item_id, r.component_id) for r in got.collect()}
        assert {r for r in found if r[0] is not None} == set(want.items()) and {c for i, c in found if i is None} == short


def test_pipeline_drops_copies_of_similarity_08(spark):
    rows = edited_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    kept = corpus_pipeline.drop_copies(spark, frame, SMALL).collect()
    assert {r.doc_id for r in kept} == set(brute_similar(rows).values())


def test_stages_tell_texts_of_one_id_apart(spark):
    body = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"else{i}" for i in range(80))
    rows = [(1, other), (1, body), (2, body + " more"), (None, "alone here"), (None, "alone here"), (None, "alone there"), (3, ""), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, frame, SMALL).collect()]
    assert sorted(kept, key=repr) == sorted([(1, other), (1, body), (None, "alone here"), (None, "alone there"), (3, "")], key=repr)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marked = {q: docs.join(spark.read.parquet(f"{SMALL}/labels.parquet").where(f"quality = {q}"), "doc_id").select(docs.columns) for q in (0, 1)}
    left = {(r.doc_id, r.text) for r in corpus_pipeline.keep_good(spark, docs, SMALL).collect()}
    bad = next(r for r in marked[0].orderBy("doc_id").collect() if (r.doc_id, r.text) not in left)
    good = next(r for r in marked[1].orderBy("doc_id").collect() if (r.doc_id, r.text) in left)
    more = docs.union(spark.createDataFrame([(good.doc_id, bad.text, "en", "s", 1), (None, bad.text, "en", "s", 1), (None, good.text, "en", "s", 1)], docs.schema))
    again = {(r.doc_id, r.text) for r in corpus_pipeline.keep_good(spark, more, SMALL).collect()}
    assert {(good.doc_id, good.text), (None, good.text)} <= again
    assert not {(good.doc_id, bad.text), (None, bad.text), (bad.doc_id, bad.text)} & again
    cleaned = corpus_pipeline.drop_lines(spark, frame, SMALL)
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=repr) == sorted(rows, key=repr)


def test_lines_of_small_hosts_go_by_the_ratio(spark):
    rows = [(i, f"menu\npage {i}", "nine") for i in range(9)] + [(100 + i, f"{'foot' if i < 9 else 'x'}\nbody {i}", "ten") for i in range(10)]
    rows += [(200 + i, "pair\nbody", "two") for i in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' as lang")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, frame, SMALL).collect()}
    want = {r[0]: r[1] for r in rows} | {i: f"page {i}" for i in range(9)} | {100 + i: f"body {i}" for i in range(9)}
    assert got == want
