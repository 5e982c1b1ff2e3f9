"""A ledger that is written twice holds the same rows."""

from datetime import date, datetime, timedelta

import pytest

from pitsignal.operators.ledger_store import LedgerStore, into_ledger
from pitsignal.schemas import LEDGER
from pitsignal.session import scratch_path
from pitsignal.streaming.run import file_stream

T0 = datetime(2026, 8, 31, 13, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def episodes(spark, *rows):
    return spark.createDataFrame([(i, date(2026, 8, 31), u, "COLLECTING", at(m), at(m)) for i, u, m in rows], LEDGER["episodes"])


def orders(spark, *rows):
    return spark.createDataFrame([(i, "e1", c, b, s, "{}", at(i), at(i)) for i, c, b, s in rows], LEDGER["orders"])


@pytest.mark.parametrize("buckets", [1, 7])
def test_an_episode_is_created_once_per_session_and_underlying(spark, buckets):
    store = LedgerStore(spark, scratch_path(spark, "ledger"), buckets=buckets)
    assert store.read("episodes").count() == 0
    assert store.insert("episodes", episodes(spark, ("a", "COIN", 5), ("b", "COIN", 3), ("c", "MSTR", 1)), commit="1")
    assert store.insert("episodes", episodes(spark, ("d", "COIN", 0), ("e", "QQQ", 9)), commit="2")
    want = {("b", "COIN"), ("c", "MSTR"), ("e", "QQQ")}
    assert {(r.episode_id, r.underlying) for r in store.read("episodes").collect()} == want
    # the same commit again, and the same rows under another name
    assert not store.insert("episodes", episodes(spark, ("z", "ZZZ", 0)), commit="2")
    assert store.insert("episodes", episodes(spark, ("a", "COIN", 5), ("b", "COIN", 3), ("c", "MSTR", 1)), commit="3")
    again = LedgerStore(spark, store._path, buckets=buckets)
    assert {(r.episode_id, r.underlying) for r in again.read("episodes").collect()} == want and again.read("episodes").count() == 3
    assert store.insert("episodes", episodes(spark, ("a", "COIN", 5)).limit(0), commit="4") and store.committed("episodes", "4")


def test_orders_keep_their_identity_and_take_updates_once(spark):
    store = LedgerStore(spark, scratch_path(spark, "ledger"), buckets=3)
    store.insert("orders", orders(spark, (1, "c1", "b1", "accepted"), (2, "c2", None, "accepted"), (3, "c3", None, "new")), commit="0")
    store.insert("orders", orders(spark, (9, "c1", "b2", "accepted")), commit="1")
    schema = "client_order_id string, broker_order_id string, status string, payload_json string, updated_at timestamp, update_no int"
    first = spark.createDataFrame([("c1", None, "filled", '{"n":1}', at(50), 1), ("c2", "x2", "open", "{}", at(51), 1), ("nobody", "n", "open", "{}", at(51), 1)], schema)
    second = spark.createDataFrame([("c2", None, "filled", "{}", at(60), 2)], schema)
    assert store.update_orders(first, commit="u1") and store.update_orders(second, commit="u2")
    # an older batch that is repeated does not bring its status back
    assert not store.update_orders(first, commit="u1")
    got = {r.client_order_id: (r.order_id, r.broker_order_id, r.status, r.updated_at) for r in store.read("orders").collect()}
    assert got == {"c1": (1, "b1", "filled", at(50)), "c2": (2, "x2", "filled", at(60)), "c3": (3, None, "new", at(3))}


def test_a_repeated_micro_batch_leaves_the_ledger_as_it_is(spark):
    path = scratch_path(spark, "incoming")
    for k in range(3):
        rows = [(f"e{i}", f'{{"k": {k}}}', at(10 * k + i)) for i in range(k, k + 3)]
        spark.createDataFrame(rows, LEDGER["features"]).coalesce(1).write.mode("append").parquet(path)
    store = LedgerStore(spark, scratch_path(spark, "ledger"), buckets=4)
    for _ in range(2):
        # a lost checkpoint folder: the same batches come once more under the same names
        into_ledger(file_stream(spark, path, LEDGER["features"], max_files=1), store, "features", checkpoint=scratch_path(spark, "state")).awaitTermination()
        got = {r.episode_id: r.payload_json for r in store.read("features").collect()}
        assert got == {f"e{i}": f'{{"k": {max(0, i - 2)}}}' for i in range(5)}
        assert store.read("features").count() == 5


def test_an_insert_leaves_stored_files_alone(spark):
    store = LedgerStore(spark, scratch_path(spark, "ledger"), buckets=1)
    store.insert("episodes", episodes(spark, ("a", "COIN", 5), ("b", "MSTR", 1)), commit="1")
    before = set(store.read("episodes").inputFiles())
    store.insert("episodes", episodes(spark, ("c", "COIN", 7)), commit="2")
    assert set(store.read("episodes").inputFiles()) == before
    store.insert("episodes", episodes(spark, ("d", "COIN", 7), ("e", "QQQ", 2)), commit="3")
    assert before < set(store.read("episodes").inputFiles())
    assert {r.episode_id for r in store.read("episodes").collect()} == {"a", "b", "e"}
