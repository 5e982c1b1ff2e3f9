"""The Merkle manifest against a plain tree, for several arities, block heights and odd rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pitsignal.llm.merkle import FIELDS, folded, path_digest, record_digest, seal_evidence

SCHEMA = "item_id long, tool string, lang string, n_chars long, content string, grp string, root int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, arity):
    """Root, and for each leaf the texts before and after it level by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] - at[i] % arity
            nodes = level[run : run + arity]
            slot = at[i] - run
            p.append(("".join(nodes[:slot]), "".join(nodes[slot + 1 :])))
            at[i] //= arity
        level = [digest("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def plain(rows, arity):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row[:5])
    out, subroots = [], []
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in groups[name])
        leaves = [k[2] for k, _ in own]
        subroot, paths = tree(leaves, arity)
        subroots.append(subroot)
        out.append([(r[0], name, d, subroot, p) for (_, r), d, p in zip(own, leaves, paths)])
    root, above = tree(subroots, arity)
    return [(i, g, d, s, root, p + over) for rows, over in zip(out, above) for i, g, d, s, p in rows]


def sealed(frame, **options):
    found = seal_evidence(frame, **options).withColumn("back", folded(F.col("path"), F.col("leaf"))).withColumn("proof", path_digest(F.col("path")))
    out = []
    for r in found.collect():
        assert r.back == r.root
        path = [(s.before, s.after) for s in r.path]
        assert r.proof == digest("".join(a + b for a, b in path))
        out.append((r.item_id, r.tool, r.leaf, r.subroot, r.root, path))
    return sorted(out, key=repr)


ODD = [
    (None, None, None, None, None),
    (None, None, "en", 0, ""),
    (4, "quotes", None, 3, "ä€"),
    (4, "quotes", None, 3, "ä€"),
    (4, "quotes", "en", 3, "other"),
    (-1, "quotes", "en", None, "x" * 5000),
    (9, "", "en", 1, "-"),
    (10, "alone", "en", 1, None),
]


@pytest.mark.parametrize("arity, block_levels", [(2, 10), (2, 2), (3, 1)])
def test_equals_a_plain_tree(spark, arity, block_levels):
    rows = ODD + [(i * 7 % 101, f"tool{i % 13 % 4}", "en", i, f"text {i}") for i in range(101)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = sealed(frame, arity=arity, block_levels=block_levels)
    assert got == sorted(plain(rows, arity), key=repr)


def test_changed_record_does_not_fold_to_the_root(spark):
    rows = [(i, "tool", "en", i, f"text {i}") for i in range(9)]
    frame = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    claimed = record_digest(*[F.col(c) + F.when(F.col("item_id") == 5, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in FIELDS])
    found = seal_evidence(frame.withColumn("claimed", claimed), carried=["claimed", "root"])
    verified = found.select("item_id", (folded(F.col("path"), F.col("claimed")) == F.col("subroot")).alias("_"), "claimed", "leaf", "path").collect()
    assert {r.item_id for r in verified if r.claimed != r.leaf} == {5}
    back = found.select("item_id", (folded(F.col("path"), F.col("claimed")) == F.col("subroot")).alias("same")).collect()
    assert {r.item_id for r in back if not r.same} == {5}


def test_ranges_smaller_than_a_hot_id(spark, monkeypatch):
    from pitsignal.llm import merkle

    monkeypatch.setattr(merkle, "RUN_ROWS", 3)
    rows = [(1, "tool", "en", i % 3, "same") for i in range(30)] + [(2, "tool", "en", 0, "same")]
    frame = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    assert sealed(frame, block_levels=2) == sorted(plain(rows, 2), key=repr)


def test_empty_table_and_single_item(spark):
    frame = spark.createDataFrame([(1, "tool", "en", 1, "a", "", 0)], SCHEMA)
    assert seal_evidence(frame.limit(0)).collect() == []
    one = seal_evidence(frame).collect()[0]
    assert one.leaf == one.subroot == one.root == leaf((1, "tool", "en", 1, "a")) and one.path == []
