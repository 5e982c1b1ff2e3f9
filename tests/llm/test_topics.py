import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.llm import mixing
from pitsignal.llm.mixing import mix_evidence, rake
from pitsignal.llm.quality_rules import RULES, learn_rates
from pitsignal.llm.topics import learn_topics, topic_of, with_counts, with_driver
from pitsignal.session import cut_lineage


def test_topics_follow_the_words(spark):
    """Texts of two vocabularies that share no bin never share a topic; whole texts decide, and rows without words are unclear."""
    rng = np.random.default_rng(3)
    kinds = [["market", "rates", "bonds"], ["zebra", "quokkas", "jackdaw"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 40))) for i in range(120)] + [(None, None), (1, ""), (1, " \n"), (999, "market " * 2_000 + "zebra quokkas jackdaw " * 20_000)]
    frame = spark.createDataFrame(rows, "item_id long, content string").selectExpr("*", "'old' as driver", "1 as bins")
    weights = learn_topics(frame.where("item_id < 120"))
    got = with_driver(frame, weights).collect()
    names = [{r.driver for r in got[:120] if r.item_id % 2 == k} for k in (0, 1)]
    assert not names[0] & names[1]
    assert [r.driver for r in got[120:123]] == ["unclear"] * 3 and got[123].driver in names[1]
    for row in got[:120] + got[123:]:  # brute force
        bins = [(31 * ord(w[0]) + 17 * ord(w[-1]) + len(w)) % 32 for w in row.content.split()]
        sums = [sum(table[b] for b in bins) for table in weights]
        assert row.driver == f"topic {sums.index(max(sums))}"
    assert with_driver(frame.limit(0), learn_topics(frame.limit(0))).count() == 0


def test_rake_says_what_error_is_left(spark):
    """Two cells on a diagonal cannot meet margins that differ; a full table is met to the tolerance."""
    share = lambda a, b: spark.createDataFrame([("a", a), ("b", b)], "value string, share double")
    diagonal = spark.createDataFrame([("a", "a", 5), ("b", "b", 5)], "tool string, lang string, tokens long")
    got = rake(diagonal, {"tool": share(0.9, 0.1), "lang": share(0.2, 0.8)}, rounds=18).collect()
    assert got[0].margin_error == pytest.approx(0.7)
    full = diagonal.union(spark.createDataFrame([("a", "b", 1), ("b", "a", 90)], diagonal.schema))
    got = rake(full, {"tool": share(0.9, 0.1), "lang": share(0.2, 0.8)}).collect()
    assert got[0].margin_error <= 1e-6
    assert sum(r.weight for r in got if r.tool == "a") == pytest.approx(0.9, abs=1e-5)
    assert sum(r.weight for r in got if r.lang == "b") == pytest.approx(0.8, abs=1e-5)


def test_mixing_keeps_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "x", 7, 8, "w")], "item_id long, content string, tool string, _w int, _cell_tool int, weight string")
    even = spark.createDataFrame([("x", 1.0)], "value string, share double")
    row = mix_evidence(frame, {"tool": even}).collect()[0]
    assert (row["_w"], row["_cell_tool"], row.weight, row.sampled) == (7, 8, 1.0, True)


def test_em_ends_by_its_tolerance(spark):
    """More rounds than the tolerance asks for change the rates by little."""
    votes = spark.createDataFrame([(1, 1, 0)] * 60 + [(-1, -1, 0)] * 30 + [(1, -1, 1)] * 5 + [(0, 0, 0)] * 5, ", ".join(f"vote_{r.name} int" for r in RULES[:3]))
    ended, prior = learn_rates(votes, RULES[:3])
    longer, other = learn_rates(votes, RULES[:3], iterations=400, tolerance=0.0)
    assert prior == pytest.approx(other, abs=1e-2)
    assert max(abs(ended[k] - longer[k]) for k in ended) < 2e-2


def test_topics_are_learned_from_all_rows(spark):
    """The weights are those of the whole table, of more rows than were once drawn, with words of any script and white space."""
    rng = np.random.default_rng(11)
    letters = list("abcdefgh") + ["é", "Ж", "𝔞", " ", "\x1c"]
    pool = ["".join(rng.choice(letters, rng.integers(1, 7))) for _ in range(300)]
    texts = ["\t".join(rng.choice(pool[60 * (i % 5) : 60 * (i % 5) + 60], rng.integers(0, 9))) + " \x0b\n" for i in range(6_000)]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    counts = np.zeros((len(texts), 32), dtype=int)
    for i, own in enumerate(words):
        for w in own:
            counts[i, (31 * ord(w[0]) + 17 * ord(w[-1]) + len(w)) % 32] += 1
    frame = spark.createDataFrame([*enumerate(texts), (None, None), (None, None)], "item_id long, content string")
    got = [(r.item_id, r.counts) for r in with_counts(frame, "item_id").collect()]
    assert sorted(got, key=str) == sorted([*enumerate(counts.tolist()), (None, [0] * 32), (None, [0] * 32)], key=str)
    counts = counts[counts.sum(axis=1) > 0]
    topic, before = counts.argmax(axis=1) % 4, None
    for _ in range(60):
        table = np.stack([counts[topic == k].sum(axis=0) for k in range(4)])
        if before is not None and (table == before).all():
            break
        before = table
        weights = [[round(10_000 * math.log((int(v) + 1) / (int(row.sum()) + 32))) for v in row] for row in table]
        topic = (counts @ np.array(weights).T).argmax(axis=1)
    assert learn_topics(frame) == weights
    by_text = {r.driver for r in with_driver(frame, weights).join(with_counts(frame, "item_id"), "item_id").where(topic_of(F.col("counts"), weights) != F.col("driver")).collect()}
    assert not by_text


def test_more_rounds_are_no_more_jobs(spark):
    """Cells that never meet their margins go through 600 rounds in as many jobs as through 6; few and many cells fit alike."""
    share = lambda a, b: spark.createDataFrame([("a", a), ("b", b), (None, 0.3)], "value string, share double")
    cells = spark.createDataFrame([("a", "a", 5), ("b", "b", 5), (None, "b", 2), ("a", None, 0)], "tool string, lang string, tokens long")
    targets = {"tool": share(0.9, 0.1), "lang": share(0.2, 0.8)}
    jobs, got = [], {}
    for rounds in (6, 600):
        spark.sparkContext.setJobGroup(f"rake {rounds}", "")
        got[rounds] = sorted(rake(cells, targets, rounds=rounds).collect(), key=str)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rake {rounds}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] < jobs[0] + 20  # a job for each batch of rounds would be hundreds; AQE makes a few more or less
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing, "FEW_CELLS", 0)
        many = sorted(rake(cells, targets, rounds=6).collect(), key=str)
    assert [tuple(r)[:2] for r in many] == [tuple(r)[:2] for r in got[6]]
    assert [x for r in many for x in r[2:]] == pytest.approx([x for r in got[6] for x in r[2:]])


def test_rounds_of_topics_share_their_code(spark):
    """The driver compiles nothing anew for a further round: the weights of a round are data of its plan."""
    rng = np.random.default_rng(5)
    pool = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 8))) for _ in range(200)]
    frame = cut_lineage(with_counts(spark.createDataFrame([(" ".join(rng.choice(pool, 6)),) for _ in range(500)], "content string")))
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount
    few, before = learn_topics(frame, rounds=3, counts=F.col("counts")), compiled()
    more = learn_topics(frame, rounds=9, counts=F.col("counts"))
    assert few != more and compiled() == before
