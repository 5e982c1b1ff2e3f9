"""Packing, token files, mixing and resharding: bounds, round trips and exact sums."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from pitsignal.llm.mixing import draw, mix_evidence, rake
from pitsignal.llm.packing import best_fit, pack, pack_evidence, swap_search
from pitsignal.llm.resharding import block_transfers, even_capacities, min_cost_flow, plan_shards, rewrite_shards
from pitsignal.llm.token_files import decode_block, encode_block, read_token_files, write_token_files
from pitsignal.llm.tokens import ChunkEncoder

SMALL = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "It's  two\t\ttabs \n end ", "nb sp  x", "<|endoftext|> in text", "\x00 \x1c y", "İstanbul é ﬁ", "x. y, Z.\n\nNew", "\U0001f600 ok!! ###a|b 12 3.5"]


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("path, spaces", [(WORDS, False), (BYTES, True)])
def test_chunk_encoder_equals_the_tokenizer(spark, path, spaces):
    tokenizer = Tokenizer.from_file(path)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for remembered in (0, 10**6):
        encoder = ChunkEncoder(path, spaces_count=spaces, remembered=remembered)
        for _ in range(2):
            got = encoder.encode(texts)
            assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids_of(tokenizer, t).tolist() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé .,'\n\t ́#1<|　"), max_size=30), max_size=6))
def test_chunk_encoder_on_any_text(texts):
    for path, spaces in ((WORDS, False), (BYTES, True)):
        tokenizer = _cached(path)
        got = ChunkEncoder.encode(_encoder(path, spaces), texts)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [ids_of(tokenizer, t).tolist() for t in texts]


_KEPT = {}


def _cached(path):
    return _KEPT.setdefault(path, Tokenizer.from_file(path)) if path not in _KEPT else _KEPT[path]


def _encoder(path, spaces):
    key = (path, spaces)
    if key not in _KEPT:
        _KEPT[key] = ChunkEncoder(path, spaces_count=spaces)
    return _KEPT[key]


def check_packing(rows, docs, capacity=2048):
    tokenizer = Tokenizer.from_file(WORDS)
    places = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r[0]].append(r)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in docs.items():
        ids = np.append(ids_of(tokenizer, text), 0).astype("<u4")
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            assert (r.start, r.length) == (r.piece * capacity, min(capacity, len(ids) - r.piece * capacity))
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return len(places), sum(r.length for r in rows)


def test_op6_places_every_token_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    used, total = check_packing(entry.queries()["op6_best_fit_packing"](spark, SMALL).collect(), docs)
    assert used <= -(-total // 2048) + 1


def test_packing_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 5000)]
    frame = spark.createDataFrame(rows, "item_id long, content string").selectExpr("*", "3 as piece", "4 as length")
    got = pack_evidence(frame, WORDS).collect()
    assert sorted((str(r.item_id), r.piece, r.length) for r in got) == [("1", 0, 1), ("1", 0, 1), ("2", 0, 2048), ("2", 1, 2048), ("2", 2, 905), ("None", 0, 1)]
    assert pack_evidence(frame.limit(0), WORDS).count() == 0


def test_swaps_empty_a_bin_that_best_fit_leaves():
    lengths = np.array([6, 5, 4, 3, 2])
    start = [[0, 2], [1, 3], [4]]  # 10 + 8 + 2
    assert len(swap_search(lengths, start, 10)) == 2
    stuck = [[0], [1, 4], [2, 3]]  # 6 + 7 + 7: only an exchange helps
    assert len(swap_search(lengths, stuck, 10)) == 2


def step_left(lengths, bins, capacity):
    """Whether a move or an exchange for one or two smaller pieces makes a fuller bin fuller, all tried."""
    fill = [sum(lengths[b]) for b in bins]
    for g, t in itertools.permutations(range(len(bins)), 2):
        if fill[g] <= fill[t] < capacity:
            backs = [0, *(lengths[j] for j in bins[t]), *(lengths[j] + lengths[k] for j, k in itertools.combinations(bins[t], 2))]
            if any(0 < lengths[i] - back <= capacity - fill[t] for i in bins[g] for back in backs):
                return True
    return False


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.randoms(use_true_random=False))
def test_swaps_go_on_until_no_step_helps(sizes, random):
    lengths = np.array(sizes, dtype=np.int64)
    start = [[i] for i in range(len(sizes))]
    random.shuffle(start)
    bins = swap_search(lengths, start, 50)
    assert sorted(itertools.chain(*bins)) == list(range(len(sizes))) and all(lengths[b].sum() <= 50 for b in bins)
    assert len(bins) <= -(-lengths.sum() // 50) or not step_left(lengths, bins, 50)


def test_swaps_have_no_cap_on_a_large_group():
    """Best fit alone needs 2,229 bins here, and 200,000 comparisons of bins empty three of them."""
    lengths = np.random.default_rng(0).integers(600, 761, 6000)
    bins = pack(lengths)
    assert sorted(itertools.chain(*bins)) == list(range(6000)) and max(lengths[b].sum() for b in bins) <= 2048
    assert len(bins) < 2100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_pack_keeps_pieces_and_never_gets_worse(sizes):
    lengths = np.array(sizes, dtype=np.int64)
    first, bins = best_fit(lengths, 30), pack(lengths, 30)
    assert sorted(itertools.chain(*bins)) == list(range(len(sizes)))
    assert all(lengths[b].sum() <= 30 for b in bins) and len(bins) <= len(first)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_block_round_trip(values):
    control, data = encode_block(np.array(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert decode_block(control, data, len(values)).tolist() == values


def test_op7_equals_whole_encoding(spark):
    tokenizer = Tokenizer.from_file(BYTES)
    at = 0
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = np.append(ids_of(tokenizer, r.text), 2).astype("<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in entry.queries()["op7_token_files"](spark, SMALL).collect()}
    assert got == want


def test_token_files_in_many_files(spark, tmp_path):
    rows = [(None, "null first"), (9, "nine"), (9, "nine"), (3, None), (5, ""), *((i, f"text {i} " * (i % 7)) for i in range(20, 60))]
    frame = spark.createDataFrame(rows, "item_id long, content string").selectExpr("*", "1 as file", "2 as ids").repartition(5)
    write_token_files(frame, str(tmp_path / "t"), BYTES, file_ids=100)
    got = sorted(read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.item_id for r in got] == [None, 3, 5, 9, 9, *range(20, 60)]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert spark.read.parquet(str(tmp_path / "t/blocks")).select("file").distinct().count() > 3
    write_token_files(frame.limit(0), str(tmp_path / "e"), BYTES)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_rake_meets_all_margins(spark):
    cells = [("a", "en", "x", 100), ("a", "de", "y", 50), ("b", "en", "y", 10), ("b", "de", "x", 40), (None, "en", "x", 5), (None, "de", "y", 0)]
    frame = spark.createDataFrame(cells, "tool string, lang string, driver string, tokens long")
    share = lambda pairs: spark.createDataFrame(pairs, "value string, share double")
    targets = {"tool": share([("a", 0.4), ("b", 0.5), (None, 0.1)]), "lang": share([("en", 1.0), ("de", 1.0)]), "driver": share([("x", 0.6), ("y", 0.4)])}
    got = rake(frame, targets, rounds=60).collect()
    total = lambda c, v: sum(r.weight for r in got if r[c] == v)
    assert sum(r.weight for r in got) == pytest.approx(1)
    assert [total("tool", v) for v in ("a", "b", None)] == pytest.approx([0.4, 0.5, 0.1], abs=1e-3)
    assert [total("lang", v) for v in ("en", "de")] == pytest.approx([0.5, 0.5], abs=1e-3)
    assert total("driver", "x") == pytest.approx(0.6, abs=1e-3)
    assert max(r.probability for r in got) == pytest.approx(1)


def test_mix_samples_at_the_probability(spark):
    rows = [(i, "w " * 10, "a" if i % 4 else "b") for i in range(4000)] + [(None, None, None), (5000, "", None)]
    frame = spark.createDataFrame(rows, "item_id long, content string, tool string").selectExpr("*", "1 as weight")
    even = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "value string, share double")
    got = mix_evidence(frame, {"tool": even}).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sampled").cast("int")).alias("s"))
    found = {r.tool: (r.n, r.s) for r in got.collect()}
    assert found["b"] == (1000, 1000) and found["a"][0] == 3000 and 900 < found["a"][1] < 1100 and found[None] == (2, 2)
    assert mix_evidence(frame.limit(0), {"tool": even}).count() == 0
    drawn = [r[0] for r in spark.range(2000).select(draw(F.col("id"), 3)).collect()]
    assert 0 <= min(drawn) and max(drawn) < 1 and np.mean(drawn) == pytest.approx(0.5, abs=0.03)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=4), st.integers(1, 4), st.randoms(use_true_random=False))
def test_flow_is_cheapest(supply, n, random):
    """Against brute force over unit assignments for unit costs: what cannot stay must move."""
    total = sum(supply)
    capacity = even_capacities(total, n)
    cost = {(i, j): int(i != j) for i in range(len(supply)) for j in range(n)}
    flow = min_cost_flow(supply, capacity, cost)
    assert all(sum(v for (i, _), v in flow.items() if i == k) == s for k, s in enumerate(supply))
    assert all(sum(v for (_, j), v in flow.items() if j == k) <= c for k, c in enumerate(capacity))
    stay = sum(min(s, c) for s, c in zip(supply, capacity))
    assert sum(v for (i, j), v in flow.items() if i != j) == total - stay


def test_flow_takes_the_cheaper_detour():
    cost = {(0, 0): 1, (0, 1): 2, (1, 0): 1, (1, 1): 5}
    assert min_cost_flow([4, 4], [4, 4], cost) == {(0, 1): 4, (1, 0): 4}
    with pytest.raises(ValueError):
        min_cost_flow([3], [2], {(0, 0): 0})


def test_op10_sizes_slots_and_texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = entry.queries()["op10_resharding"](spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in got)
    even = sum(sizes.values()) / 16
    assert all(abs(sizes[k] - even) <= 2 * largest for k in range(16))


def test_op10_returns_unaffected_shards_and_empty_tables(spark, tmp_path):
    """Old shard 3 has its new capacity to the byte, so it is not rewritten; its rows belong to the result."""
    named = {zlib.crc32(f"s{i}".encode()) % 12: f"s{i}" for i in range(200)}
    rows = [(i, "x" * 99, "en", named[3], 99) for i in range(20)]
    rows += [(100 + i, "y" * 99, "en", named[i % 2], 99) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "part/documents.parquet"))
    got = entry.queries()["op10_resharding"](spark, str(tmp_path / "part")).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert {r.shard for r in got if r.doc_id < 100} == {3}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(20)) for s in slots.values())
    docs.limit(0).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert entry.queries()["op10_resharding"](spark, str(tmp_path / "empty")).count() == 0


def test_resharding_moves_only_what_must(spark, tmp_path):
    rows = [(i, "x" * 9, 0) for i in range(300)] + [(1000 + i, "x" * 9, 1) for i in range(100)] + [(None, None, None), (5, None, 2), (5, None, 2)]
    frame = spark.createDataFrame(rows, "item_id long, content string, shard int").selectExpr("*", "1 as slot", "2 as size")
    got = plan_shards(frame, 4, block_bytes=200).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.new_shard] += r.size
        slots[r.new_shard].append(r.slot)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r.size for r in got if r.shard == 1 and r.new_shard != 1) <= 20
    moved = sum(e - b for i, j, b, e in block_transfers({0: 3001, 1: 1000, 2: 2}, 4) if i != j)
    assert moved == 3001 - 1001
    planned = plan_shards(frame.where("shard = 0"), 1)
    rewrite_shards(planned, str(tmp_path / "none"))
    assert spark.read.schema("item_id long").parquet(str(tmp_path / "none")).count() == 0
    assert plan_shards(frame.limit(0), 4).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clash = docs.selectExpr("*", "'c' as content", "'t' as tool", "1 as item_id", "2 as driver", "3 as weight")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "src1", 0)], docs.schema)
    docs = clash.unionByName(odd.selectExpr("*", "'c' as content", "'t' as tool", "1 as item_id", "2 as driver", "3 as weight")).union(clash.limit(3))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == columns, name
        assert {r.content for r in docs.select("content").distinct().collect()} <= {"c"}, name
    ids = [r.doc_id for r in docs.where("doc_id is not null").collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline_run_follows_its_stages(spark):
    """Brute force over the collected stages: rejects go, copies go, samples follow the draw."""
    got = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    assert got == {r.doc_id for r in docs.collect()}
    assert 0 < len(got) < 200
