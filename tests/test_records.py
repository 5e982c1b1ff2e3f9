import hashlib
import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitsignal.functions import text as tx
from pitsignal.operators import decisions as dec
from pitsignal.operators import ledger, ordering
from pitsignal.operators import policies as pol
from pitsignal.operators import selection as sel

GOOD = {"action": "continuation", "confidence": 0.7, "idiosyncratic_news_detected": False, "driver": "macro", "reason": "ok"}


def parse(spark, *replies):
    texts = [r if r is None or isinstance(r, str) else json.dumps(r) for r in replies]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    return dec.parse_decisions(df).orderBy("i").collect()


def test_valid_replies_and_the_news_veto(spark):
    good, veto = parse(spark, GOOD, GOOD | {"idiosyncratic_news_detected": True})
    assert (good.action, good.confidence, good.driver, good.failure_code) == ("continuation", 0.7, "macro", None)
    assert (veto.action, veto.driver, veto.confidence, veto.reason) == ("abstain", "company_specific", 0.7, "ok")


def test_everything_unreadable_fails_closed(spark):
    cases = {
        "non_text_response": [None],
        "malformed_json": ["{", "yes"],
        "invalid_response_shape": ["[1]", '"x"', {k: v for k, v in GOOD.items() if k != "reason"}, GOOD | {"more": 1}],
        "schema_validation": [GOOD | c for c in ({"confidence": 1.01}, {"confidence": "much"}, {"action": "buy"}, {"driver": "x"}, {"reason": ""}, {"reason": "r" * 601}, {"reason": 5}, {"idiosyncratic_news_detected": "maybe"})],
    }
    for code, replies in cases.items():
        for row in parse(spark, *replies):
            assert (row.failure_code, row.action, row.confidence, row.driver, row.idiosyncratic_news_detected, row.reason) == (code, "abstain", 0.0, "unclear", False, f"fail_closed:{code}")


def test_profile_of_repeats(spark):
    rows = [("s", "continuation", "macro", False, 0.5, "a"), ("s", "continuation", "macro", False, 0.7, "b"), ("s", "abstain", "unclear", False, 0.0, "fail_closed:malformed_json")]
    df = spark.createDataFrame(rows, "scenario string, action string, driver string, idiosyncratic_news_detected boolean, confidence double, reason string")
    row = dec.decision_profile(df, ["scenario"], expected_action="continuation").collect()[0]
    assert row.actions == {"abstain": 1, "continuation": 2} and row.idiosyncratic_news_detected == {"false": 3, "true": 0}
    assert row.action_consistency == pytest.approx(2 / 3) and row.fail_closed_count == 1 and row.unique_reason_count == 3
    assert row.expected_action_rate == pytest.approx(2 / 3) and row.expected_idiosyncratic_rate is None


def test_canonical_json_and_digests_equal_the_standard_library(spark):
    docs = [{"b": 1, "a": {"z": "é😀", "y": [1, 2.5, None, True]}}, {"k": 'quo"te\n'}, [3, {"c": 1, "b": 2}]]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    for row in df.select("i", tx.canonical_json(F.col("t")).alias("c"), tx.sha256_hex(tx.canonical_json(F.col("t"))).alias("h")).collect():
        want = json.dumps(docs[row.i], sort_keys=True, separators=(",", ":"))
        assert row.c == want and row.h == hashlib.sha256(want.encode()).hexdigest()


def test_redaction_reaches_any_depth(spark):
    doc = {"symbol": "S", "api_key": {"x": 1}, "nested": [{"access_token": "t", "safe": 1}], "Authorization": "b"}
    df = spark.createDataFrame([(json.dumps(doc),)], "t string")
    row = df.select(tx.redact_json(F.col("t")).alias("r"), tx.public_json(F.lit('{"a":{"secret":1,"v":1.239},"token":2}')).alias("p")).collect()[0]
    assert json.loads(row.r) == {"symbol": "S", "api_key": "[REDACTED]", "nested": [{"access_token": "[REDACTED]", "safe": 1}], "Authorization": "[REDACTED]"}
    assert row.p == '{"a":{"v":1.24}}'


def test_secret_scan(spark):
    filler = "word " * 50_000
    texts = ["API_KEY=your-key-here", "  API_KEY = 'abc123' # note", "x API_KEY=abc", "OTHER=1\nLLM_KEY=${VAR}", filler + "\nLLM_KEY=zzz", "sk-" + "a" * 24, "uses hunter2hunter2 here", "API_KEY=a\nAPI_KEY=b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", tx.secret_findings(F.col("t"), ["API_KEY", "LLM_KEY"], ["hunter2hunter2"]).alias("f")).collect()}
    key = "assigned:API_KEY"
    # a line with a trailing comment is no plain assignment
    assert got == {0: [], 1: [], 2: [], 3: [], 4: ["assigned:LLM_KEY"], 5: ["token_shape"], 6: ["value_in_use"], 7: [key]}


def test_context_digest_cuts_at_the_limit_and_keeps_order(spark):
    rows = [("c", i, f"item {i} é") for i in range(300)] + [("d", 0, "x" * 5000)]
    df = spark.createDataFrame(rows, "conv string, turn int, t string")
    got = {r.conv: r.digest for r in dec.context_digest(df.repartition(8), ["conv"], "turn", "t").collect()}
    assert got["c"] == json.dumps([f"item {i} é" for i in range(300)], separators=(",", ":"))[:1600]
    assert got["d"] == ('["' + "x" * 5000)[:1600]


def test_tool_digest_keeps_successful_calls_of_the_tool(spark):
    rows = [("e", 2, "news", '{"b": 1, "a": "é"}'), ("e", 1, "news", '{"z": 0}'), ("e", 3, "news", None), ("e", 4, "news", "{broken"), ("e", 5, "other", "{}"), ("f", 1, "news", None)]
    got = dec.tool_digest(spark.createDataFrame(rows, "episode_id string, call_no long, tool string, result_json string"), "news").collect()
    assert [(r.episode_id, r.digest) for r in got] == [("e", '[{"z":0},{"a":"\\u00e9","b":1}]')]


def test_legal_paths_are_clean_and_illegal_ones_are_flagged(spark):
    path = ["COLLECTING", "FEATURES_FROZEN", "OPENING_CONFIRMATION", "CANDIDATE_READY", "AI_REVIEWED", "RISK_APPROVED", "ORDER_SUBMITTED", "ORDER_FILLED", "MONITORING", "EXIT_SUBMITTED", "CLOSED"]
    rows = [("ok", i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]))]
    rows += [("bad", 0, "COLLECTING", "ORDER_FILLED"), ("bad", 1, "COLLECTING", "ABSTAINED"), ("bad", 2, "ABSTAINED", "COLLECTING")]
    df = spark.createDataFrame(rows, "episode_id string, transition_id long, from_state string, to_state string")
    got = {(r.episode_id, r.transition_id): (r.illegal_step, r.broken_chain, r.left_terminal) for r in ledger.audit_paths(df).collect()}
    assert all(got[("ok", i)] == (False, False, False) for i in range(10))
    assert got[("bad", 0)] == (True, False, False) and got[("bad", 1)] == (False, True, False) and got[("bad", 2)] == (True, False, True)


def test_hot_keys_split_into_ranges_give_the_same_order(spark):
    df = spark.range(0, 1000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("n"), (F.col("id") * 7).alias("v"))
    for width in (10, 10_000):
        rows = ordering.with_sequence(ordering.with_previous(df, ["k"], "n", "v", "prev", width=width), ["k"], "n", "seq", width=width).collect()
        for key in ("hot", "cold"):
            mine = sorted((r for r in rows if r.k == key), key=lambda r: r.n)
            assert [r.seq for r in mine] == list(range(1, len(mine) + 1))
            assert [r.prev for r in mine] == [None] + [r.v for r in mine[:-1]]


def test_insert_once_keeps_the_first_row_of_new_keys(spark):
    schema = "session_date date, underlying string, episode_id string, seq int"
    d = date(2026, 8, 31)
    old = spark.createDataFrame([(d, "A", "old", 0)], schema)
    new = spark.createDataFrame([(d, "A", "x", 1), (d, "B", "second", 3), (d, "B", "first", 2)], schema)
    assert [r.episode_id for r in ledger.insert_once(old, new, keys=["session_date", "underlying"], order="seq").collect()] == ["first"]


def test_updates_keep_a_known_broker_id(spark):
    orders = spark.createDataFrame([("c1", "b1", "new", "{}"), ("c2", None, "new", "{}")], "client_order_id string, broker_order_id string, status string, payload_json string")
    updates = spark.createDataFrame([("c1", None, "filled", "{1}", 2), ("c2", "b2", "open", "{}", 1), ("c2", None, "filled", "{2}", 2), ("zz", None, "x", "{}", 1)], "client_order_id string, broker_order_id string, status string, payload_json string, update_no int")
    got = {r.client_order_id: r for r in ledger.update_orders(orders, updates).collect()}
    assert (got["c1"].broker_order_id, got["c1"].status) == ("b1", "filled") and (got["c2"].broker_order_id, got["c2"].payload_json) == ("b2", "{2}")
    assert got["zz"].unknown and not got["c1"].unknown


def test_reconciliation_maps_states(spark):
    orders = spark.createDataFrame([(i,) for i in range(5)], "id int")
    broker = spark.createDataFrame([(0, "FILLED"), (1, "partially_filled"), (2, "expired"), (3, "rejected")], "id int, broker_status string")
    got = {r.id: (r.reconciled_status, r.next_state) for r in ledger.reconcile(orders, broker, key="id").collect()}
    assert got == {0: ("filled", "MONITORING"), 1: ("partially_filled", "ORDER_SUBMITTED"), 2: ("expired", "CLOSED"), 3: ("rejected", "CLOSED"), 4: ("indeterminate", "ORDER_SUBMITTED")}


def test_unresolved_sessions_block_later_ones_only(spark):
    t = datetime(2026, 8, 31)
    eps = spark.createDataFrame([("e1", date(2026, 8, 28), "A", "MONITORING", t, t), ("e2", date(2026, 8, 28), "B", "CLOSED", t, t)], "episode_id string, session_date date, underlying string, state string, created_at timestamp, updated_at timestamp")
    req = spark.createDataFrame([("A", date(2026, 8, 31)), ("A", date(2026, 8, 28)), ("B", date(2026, 8, 31))], "underlying string, session_date date")
    got = ledger.startable_sessions(req, eps, ledger.terminal_states()).collect()
    assert sorted((r.underlying, r.session_date.day) for r in got) == [("A", 28), ("B", 31)]
    with pytest.raises(ValueError):
        ledger.latest_episodes(eps, 0)


def test_votes_and_stability(spark):
    rows = [("e", r, m, "continuation" if m < 3 or r == 4 else "abstain", 1.0 * m) for r in range(5) for m in range(5)]
    rows += [("f", r, m, ["continuation", "reversion", "abstain"][m % 3], 2.0) for r in range(5) for m in range(5)]
    df = spark.createDataFrame(rows, "episode_id string, round int, model int, action string, latency double")
    got = {r.episode_id: r for r in pol.ensemble_votes(df).collect()}
    assert (got["e"].action, got["e"].stable, got["e"].latency) == ("continuation", True, 4.0) and (got["f"].action, got["f"].stable) == ("abstain", True)


def signals(spark, returns):
    rows = [("S", date(2026, 1, 1) + timedelta(days=i), 0.02, 0.01, "reversion", float(x)) for i, x in enumerate(returns)]
    return spark.createDataFrame(rows, "symbol string, session_date date, residual double, opening_return double, action string, continuation double")


def test_challengers_use_earlier_outcomes_only(spark):
    returns = [0.01, -0.02, 0.03, 0.04, -0.01, 0.02]
    prev = [r.previous_signal for r in pol.previous_signal(signals(spark, returns)).orderBy("session_date").collect()]
    assert prev == [None, -0.02, -0.03, 0.04, -0.01, -0.02]
    ewma = pol.ewma_choice(signals(spark, returns)).orderBy("session_date").collect()
    decay = 0.5 ** (1 / 3)
    assert [r.ewma_score is None for r in ewma] == [True] * 3 + [False] * 3
    assert ewma[3].ewma_score == pytest.approx(0.01 * decay**2 - 0.02 * decay + 0.03)
    gate = pol.regime_gate(signals(spark, returns), window=2).orderBy("session_date").collect()
    assert [r.regime_action for r in gate] == ["abstain", "abstain", "reversion", "abstain", "abstain", "abstain"]
    assert {r.guard_action for r in pol.opening_guard(signals(spark, returns)).collect()} == {"abstain"}


def test_selection_corrections_on_planted_policies(spark):
    rows = [("S", date(2026, 1, 1) + timedelta(days=i), 0.01 + 0.001 * (i % 3), -0.01 + 0.002 * (i % 2)) for i in range(36)]
    wide = spark.createDataFrame(rows, "symbol string, session_date date, good double, bad double")
    check = sel.reality_check(wide, ["symbol"], ("good", "bad"), ["session_date"], samples=100, seed=1, block=3).collect()[0]
    assert check.p_value == pytest.approx(1 / 101)
    long = wide.selectExpr("symbol", "session_date", "stack(2, 'good', good, 'bad', bad) as (policy, return)")
    over = sel.overfitting_probability(long, ["symbol"], order=["session_date"]).collect()[0]
    assert over.pbo == 0 and over.splits == 20
    sharpe = {r.policy: r for r in sel.deflated_sharpe(long, ["symbol"], trials=25).collect()}
    spread = np.std([r.sharpe for r in sharpe.values()], ddof=1)
    assert sharpe["good"].benchmark == pytest.approx(spread * sel.expected_max_factor(25)) and sharpe["good"].deflated_probability > sharpe["bad"].deflated_probability
    gates = spark.createDataFrame([("a", "x", True), ("a", "y", True), ("b", "x", True), ("b", "y", False)], "candidate string, gate string, passed boolean")
    done = {r.candidate: (r.promoted, r.failed_gates) for r in sel.promotion_gates(gates, ["candidate"]).collect()}
    assert done == {"a": (True, []), "b": (False, ["y"])}
