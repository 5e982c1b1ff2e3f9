"""Quality rules, quality model and flag network against plain Python and held-out labels."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
from pitsignal.llm import toxicity
from pitsignal.llm.quality_model import QuadraticModel, fit, grade_evidence
from pitsignal.llm.quality_rules import RULES, accuracies, learn_rates, vote, weigh_evidence
from pitsignal.llm.toxicity import best_threshold, flag_evidence, index_texts, window_sums
from pitsignal.llm.words import text_measures

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "a b c a b c d",
    "x x x x x",
    "line one\nline one\n\nother\nline one",
    "AB#* cd$\tef|gh\x0bij",
    "naïve  word \U0001f600 end " * 40,
    "to be or not to be or not " * 400,
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    at = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines),
        len(lines) - len(set(lines)),
        len(at),
        sum("A" <= c <= "Z" for c in text),
        sum(a == b for a, b in zip(words, words[1:])),
    )


def test_measures_match_plain_python(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, content string")
    got = {r[0]: tuple(r)[1:] for r in text_measures(frame).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_rules_defined_for_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 60, "x"), (3, " ".join(f"w{i}" for i in range(80)), "x")]
    frame = spark.createDataFrame(rows, "item_id long, content string, posterior string")
    got = sorted(weigh_evidence(frame).select("item_id", "base_failed", "kept").collect(), key=str)
    assert len(got) == 5
    assert all(r.base_failed and not r.kept for r in got if r.item_id in (None, 1, 2))
    assert [r.kept for r in got if r.item_id == 3] == [True]
    assert weigh_evidence(frame.limit(0)).count() == 0


def test_em_learns_which_rules_err(spark):
    rng = np.random.default_rng(1)
    keep = rng.random(4000) < 0.7
    votes = []
    for k in keep:
        good = 1 if k else -1
        votes.append(tuple(int(good if rng.random() < a else -good) if rng.random() < 0.8 else 0 for a in (0.95, 0.9, 0.9, 0.6)))
    rules = RULES[:4]
    frame = spark.createDataFrame(votes, ", ".join(f"vote_{r.name} int" for r in rules))
    rates, prior = learn_rates(frame, rules, 40)
    found = accuracies(rates, prior, rules)
    assert prior == pytest.approx(0.7, abs=0.05)
    assert [found[r.name] for r in rules] == pytest.approx([0.95, 0.9, 0.9, 0.6], abs=0.06)


def test_rules_agree_with_reviewed_quality(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = entry.queries()["op1_quality_rules"](spark, MIDDLE).join(labels, "doc_id").where("not base_failed")
    right = got.where("kept = (quality = 1)").count()
    assert right / got.count() > 0.99


def test_quality_model_moments_and_held_out(spark):
    x = np.random.default_rng(0).normal(size=(400, 2)) * [1, 3]
    rows = [([float(a), float(b)], int(i % 2)) for i, (a, b) in enumerate(x)]
    model = fit(spark.createDataFrame(rows, "features array<double>, label int"), "label", 2)
    assert model.means[1] == pytest.approx(x[1::2].mean(axis=0))
    far = model.log_odds(np.array([[0.0, 0.0]]))
    assert np.isfinite(far).all()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = entry.queries()["op2_quality_classifier"](spark, MIDDLE).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() / got.count() > 0.98


def test_quality_model_odd_input(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "good words here"), (3, "### $$$")]
    frame = spark.createDataFrame(rows, "item_id long, content string").selectExpr("*", "'x' as features", "'y' as score")
    marks = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, None)], "item_id long, success int")
    got = grade_evidence(frame, marks)
    assert got.count() == 5 and got.where("score is null or score < 0 or score > 1").count() == 0
    one_kind = grade_evidence(frame, marks.where("success = 1"))
    assert {r.score for r in one_kind.collect()} == {0.5}
    assert grade_evidence(frame.limit(0), marks).count() == 0


def test_windows_do_not_cross_texts():
    texts = index_texts(["a b c", "", None, "d"])
    responses = np.ones((len(texts.pairs), 48), dtype=np.float32)
    responses[0] = 100
    one, two, three = (s[:, 0] for s in window_sums(responses, texts.place))
    assert one.tolist() == [1, 1, 1, 0, 0, 0, 1, 0]
    assert two.tolist() == [2, 2, 0, 0, 0, 0, 0, 0]
    assert three.tolist() == [3, 0, 0, 0, 0, 0, 0, 0]


def test_pieces_score_like_a_direct_convolution():
    """Every window of every width, one by one, with the filter bank of its place."""
    rng = np.random.default_rng(4)
    words = [f"wort{i}" for i in range(40)]
    raw = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 40, 7, 200)] + ["", None]
    table = rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32)
    banks = rng.normal(size=(toxicity.DIM, len(toxicity.COLUMNS) * toxicity.FILTERS)).astype(np.float32)
    bias, out = rng.normal(size=(2, len(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32)
    model = toxicity.ConvModel(table, banks, bias, out, 0.3, {"": 0.5})
    want = []
    for text in raw:
        vectors = [table[a] + table[b] for a, b in map(toxicity.pair_of, (text or "").split())]
        pooled, block = [], 0
        for width in toxicity.WIDTHS:
            best = np.zeros(toxicity.FILTERS)  # the place after the last word counts as zero
            for at in range(len(vectors) - width + 1):
                parts = [vectors[at + k] @ banks[:, (block + k) * toxicity.FILTERS : (block + k + 1) * toxicity.FILTERS] for k in range(width)]
                best = np.maximum(best, sum(parts))
            pooled.append(best)
            block += width
        want.append(np.maximum(np.concatenate(pooled) + bias, 0) @ out + 0.3)
    assert model.log_odds(index_texts(raw)) == pytest.approx(np.array(want), abs=1e-3)
    texts = toxicity.gather_texts([toxicity.bucket_codes(t) for t in raw])
    chosen = np.array([5, 0, 7, 3, 6])
    for words_at_once in (1, 10, 10_000):
        got = np.concatenate([model.log_odds(p) for p in toxicity.pieces(texts, chosen, words_at_once)])
        assert got == pytest.approx(np.array(want)[chosen], abs=1e-3)


def test_quality_density_by_hand():
    means, factors = np.array([[0.0, 1.0], [2.0, -1.0]]), np.array([[[1.0, 0.0], [0.5, 2.0]], [[0.7, 0.0], [-0.2, 1.5]]])
    covs = factors @ factors.transpose(0, 2, 1)
    priors = np.log([0.3, 0.7])
    model = QuadraticModel(means, np.linalg.inv(factors), np.linalg.slogdet(covs)[1], priors)
    x = np.random.default_rng(2).normal(size=(20, 2))
    logs = []
    for k in (0, 1):
        d = x - means[k]
        logs.append(priors[k] + np.log(np.exp(-0.5 * (d @ np.linalg.inv(covs[k]) * d).sum(axis=1)) / np.sqrt((2 * np.pi) ** 2 * np.linalg.det(covs[k]))))
    assert model.log_odds(x) == pytest.approx(logs[1] - logs[0])


def test_threshold_has_the_best_f1():
    scores, labels = np.array([0.9, 0.8, 0.4, 0.3, 0.1]), np.array([1, 1, 0, 1, 0])
    f1 = lambda t: 2 * (labels[scores >= t]).sum() / ((scores >= t).sum() + labels.sum())
    assert f1(best_threshold(scores, labels)) == max(f1(s) for s in scores)


def test_flags_held_out_and_odd_rows(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    got = entry.queries()["op4_toxicity"](spark, MIDDLE).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() > 0.94
    rows = [(None, None, None), (1, "", "en"), (1, "", "en"), (2, "you vile clod", "en"), (3, "fine day", "xx")]
    frame = spark.createDataFrame(rows, "item_id long, content string, lang string").selectExpr("*", "1 as score")
    marks = spark.createDataFrame([(2, 1), (3, 0), (1, None)], "item_id long, toxic int")
    out = flag_evidence(frame, marks, label="toxic")
    assert out.count() == 5 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in flag_evidence(frame, marks.limit(0), label="toxic").collect()} == {0.5}
    assert flag_evidence(frame.limit(0), marks, label="toxic").count() == 0


def test_vote_order_is_reject_first(spark):
    row = spark.range(1).selectExpr("10L as n_words", "5L as n_symbols", "0L as n_upper", "50L as word_chars")
    assert row.select(vote(RULES[0]).alias("v")).first().v == -1


def test_sample_passes_over_texts_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 200)
    rows = [(i, "en", "x" * (10 if i % 10 else 60 if i % 20 else 500), i % 2) for i in range(1, 41)]
    rows += [(i, "en", "x" * 500, i % 2) for i in range(100, 140)]
    frame = spark.createDataFrame(rows, "item_id long, lang string, content string, _label int")
    picked, _ = toxicity._sample(frame.drop("_label"), frame.select("item_id", "_label"))
    chars = {r[0]: len(r[2]) for r in rows}
    sizes = {label: sum(chars[r["item_id"]] for r in picked if r["_label"] == label) for label in (0, 1)}
    assert sizes[1] == 100 and 90 < sizes[0] <= 100


def test_all_reviewed_rows_are_learned_from(spark, monkeypatch):
    """Kinds of flagged text that the starting sample has not seen are learned, and a threshold is that of all rows left out."""
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    rng = np.random.default_rng(8)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(6_000):
        own = list(rng.choice(plain, 12))
        own[rng.integers(12)] = f"{rng.integers(20):02d}{'slur' if i % 2 else 'calm'}"  # no first letters in common
        rows.append((i, " ".join(own), "en" if i % 3 else None, i % 2))
    frame = spark.createDataFrame(rows, "item_id long, content string, lang string, toxic int")
    got = flag_evidence(frame, frame.select("item_id", "toxic"), label="toxic").join(frame.select("item_id", "toxic", "lang"), "item_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9


def test_thresholds_by_language_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(["en", "de", "xx", "", None][i % 5 if i % 50 else 2], float(np.round(rng.beta(0.4, 0.6), 3)), int(rng.random() < 0.3)) for i in range(3_000)]
    rows = [r for r in rows if r[0] != "xx" or rng.random() < 0.02]
    got = {r["_lang"]: r["_limit"] for r in toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, score double, _label int")).collect()}
    f1 = lambda own, t: 2 * sum(y for _, s, y in own if s >= t) / (sum(s >= t for _, s, _ in own) + sum(y for *_, y in own))
    assert set(got) == {"en", "de", None}
    for lang, limit in got.items():
        own = [r for r in rows if lang is None or r[0] == lang]
        assert f1(own, limit) == max(f1(own, s) for _, s, _ in own)
