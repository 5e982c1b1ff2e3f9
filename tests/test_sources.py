import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitsignal.schemas import BARS
from pitsignal.session import scratch_path
from pitsignal.sources import bars as src
from pitsignal.sources import chains

RAW = "symbol string, timestamp string, open string, high string, low string, close string, volume string"


def test_bars_are_typed_and_offsets_become_utc(spark):
    rows = [("A", "2026-08-28T09:25:00-04:00", "1", "2", "0.5", "1.5", "10"), ("A", "2026-08-28T13:26:00Z", "1", "NaN", "1", "1", "1")]
    got = sorted(src.normalize_bars(spark.createDataFrame(rows, RAW)).collect(), key=lambda r: r.ts)
    assert got[0].ts == datetime(2026, 8, 28, 13, 25) and got[0].volume == 10.0
    assert got[1].high is None


def test_an_empty_input_keeps_the_schema(spark):
    empty = src.normalize_bars(spark.createDataFrame([], RAW))
    assert empty.count() == 0 and [f.dataType for f in empty.schema] == [f.dataType for f in BARS]


def test_text_that_is_no_number_or_time_fails(spark):
    for bad in [("A", "2026-08-28T13:25:00Z", "x", "1", "1", "1", "1"), ("A", "yesterday", "1", "1", "1", "1", "1")]:
        with pytest.raises(Exception, match="bad bar|CAST_INVALID|cannot be"):
            src.normalize_bars(spark.createDataFrame([bad], RAW)).collect()


def test_equal_copies_collapse_and_conflicts_raise_or_are_set_aside(spark):
    t = datetime(2026, 8, 28, 13, 25)
    same = [("A", t, 1.0, 1.0, 1.0, 1.0, 1.0)] * 3
    clash = [("B", t, 1.0, 1.0, 1.0, 1.0, 1.0), ("B", t, 2.0, 2.0, 2.0, 2.0, 1.0)]
    assert src.collapse_duplicates(spark.createDataFrame(same, BARS)).count() == 1
    both = spark.createDataFrame(same + clash, BARS)
    with pytest.raises(Exception, match="conflicting duplicate bar"):
        src.collapse_duplicates(both).collect()
    for reader in (lambda d: d.count(), lambda d: d.select("ts", "close").collect()):
        with pytest.raises(Exception, match="conflicting duplicate bar"):
            reader(src.collapse_duplicates(both))
    assert [r.symbol for r in src.collapse_duplicates(both, strict=False).collect()] == ["A"]
    assert [(r.symbol, r.row_count, r.version_count) for r in src.conflicting_bars(both).collect()] == [("B", 2, 2)]


def test_payload_as_map_and_as_bare_array(spark):
    one = {"t": "2026-08-28T13:25:00Z", "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 7}
    mapped = spark.createDataFrame([(json.dumps({"bars": {"A": [one], "B": [one, one]}}),)], "payload string")
    assert sorted(r.symbol for r in src.flatten_bar_payload(mapped).collect()) == ["A", "B", "B"]
    bare = spark.createDataFrame([("C", json.dumps({"bars": [one]}))], "symbol string, payload string")
    row = src.flatten_bar_payload(bare, symbol="symbol").collect()[0]
    assert (row.symbol, row.close, row.ts) == ("C", 1.5, datetime(2026, 8, 28, 13, 25))


def test_cache_roundtrip_prunes_by_symbol(spark):
    rows = [(s, datetime(2026, 8, d, 13, 25), 1.0, 1.0, 1.0, 1.0, 1.0) for s in "AB" for d in (1, 2)]
    path = scratch_path(spark, "cache")
    src.write_bar_cache(spark.createDataFrame(rows, BARS), path, asset_class="stock")
    back = src.read_bar_cache(spark, path).where("symbol = 'A'")
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(symbol" in back._jdf.queryExecution().executedPlan().toString()


def test_a_month_of_one_symbol_is_many_files_that_a_time_filter_skips(spark):
    start = datetime(2026, 8, 1)
    rows = [("A", start + timedelta(minutes=i), 1.0, 1.0, 1.0, 1.0, float(i)) for i in range(4000)]
    path = scratch_path(spark, "cache")
    src.write_bar_cache(spark.createDataFrame(rows, BARS).repartition(5), path, asset_class="crypto", ranges=8)
    cached = src.read_bar_cache(spark, path)
    spans = sorted(tuple(r) for r in cached.groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("a", "b").collect())
    assert len(spans) >= 6 and all(one[1] < two[0] for one, two in zip(spans, spans[1:]))
    late = cached.where(F.col("ts") >= F.lit(start + timedelta(minutes=3900)))
    assert late.count() == 100 and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in late._jdf.queryExecution().executedPlan().toString()
    assert cached.count() == 4000


def test_snapshot_rules(spark):
    quote = {"t": "2026-08-31T13:59:00Z", "bp": 1.25, "ap": 1.35}
    snaps = {
        "ABC260918C00180000": {"latestQuote": quote, "greeks": {"delta": 0.55}},
        "ABC260918P00182500": {"latestQuote": quote},
        "ABC260918C00190000": {"greeks": {"delta": 0.2}},
        "ABC260918C00191000": {"latestQuote": {"t": "2026-08-31T13:59:00Z", "bp": 1.0}},
    }
    page = spark.createDataFrame([(json.dumps({"snapshots": snaps}),)], "payload string")
    got = {r.symbol: r for r in chains.flatten_snapshots(page).collect()}
    assert set(got) == {"ABC260918C00180000", "ABC260918P00182500"}
    assert got["ABC260918P00182500"].delta is None and str(got["ABC260918P00182500"].strike) == "182.5000"
    assert str(got["ABC260918C00180000"].ask) == "1.3500"


def test_bad_symbols_and_naive_quote_times_fail(spark):
    for symbol, stamp in [("NOPE", "2026-08-31T13:59:00Z"), ("ABC260918C00180000", "2026-08-31T13:59:00")]:
        page = {"snapshots": {symbol: {"latestQuote": {"t": stamp, "bp": 1, "ap": 2}}}}
        with pytest.raises(Exception, match="unsupported option symbol|timestamp without offset"):
            chains.flatten_snapshots(spark.createDataFrame([(json.dumps(page),)], "payload string")).collect()


def test_broken_pages_raise(spark):
    pages = spark.createDataFrame([("{broken",), ('{"bars": {}, "snapshots": {}}',)], "payload string")
    for flatten in (src.flatten_bar_payload, chains.flatten_snapshots):
        with pytest.raises(Exception, match="(?i)malformed"):
            flatten(pages).collect()
        assert flatten(pages.where("payload not like '{broken'")).count() == 0
