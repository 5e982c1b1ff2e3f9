"""Tokenizer alignment against a plain pass over the tokens' bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from pitsignal.llm import alignment
from pitsignal.llm.alignment import PAIR, TwinEncoder, align_evidence, pair_counts, read_alignment, write_alignment

SMALL = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", " a b", "It's  two\t\ttabs \n end ", "nb\xa0sp　x", "<|endoftext|> in <s>text</s> <0x41>", "\x00 y", "ﬁ é İ", "a▁b", "▁",
       "x.\ny, Z.\n\nNew", "\U0001f600 ok!! ###a|b 12 3.5", "end\n", "a\nb\nc d", "same same same", "same same same"]


def literal():
    found = Tokenizer.from_file(BYTES)
    found.encode_special_tokens = True
    return found


TOKENIZER, MODEL = literal(), SentencePieceProcessor(model_file=PIECES)
NAMES = {i: t for t, i in TOKENIZER.get_vocab().items()}


def byte_of():
    from tokenizers.pre_tokenizers import ByteLevel

    table = {}
    for b in range(128):
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]
        table[shown] = b
    for point in list(range(128, 0x800)) + [0x800, 0x1000, 0x8000, 0xD000, 0xE000, 0xFFFF, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000]:
        for shown, b in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(point))[0][0], chr(point).encode()):
            table[shown] = b
    for point in range(0x800, 0x10000, 0x1000):
        if not 0xD800 <= point <= 0xDFFF:
            for shown, b in zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(point))[0][0], chr(point).encode()):
                table[shown] = b
    return table


BYTE_OF = byte_of()


def tokens(text):
    if not text:
        return [], []
    a = [(i, bytes(BYTE_OF[c] for c in NAMES[i])) for i in TOKENIZER.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in MODEL.encode(text):
        piece = MODEL.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if MODEL.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def plain(texts):
    groups, links = [], []
    for text in texts:
        a, b = tokens(text)
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, x in side:
                at += len(x)
                own.append(at)
            ends.append(own)
        cut, begin = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            stop = [own.index(end) + 1 for own in ends]
            cut.append(tuple([i for i, _ in side[x:y]] for side, x, y in zip((a, b), begin, stop)))
            begin = stop
        groups.append((a, b, cut))
        links.append([(x[-1], y[-1]) for x, y in cut])
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for (a, b, cut), own in zip(groups, links):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut)
        out.append((len(a), len(b), len(cut), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return out, count


def values(row):
    return (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256)


def test_op12_equals_a_plain_pass(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want, _ = plain([d.text for d in docs])
    got = {r.doc_id: values(r) for r in entry.queries()["op12_tokenizer_alignment"](spark, SMALL).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, want)}


def test_odd_rows_and_large_tables_of_counts(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i if i % 5 else None, t, 1, "x") for i, t in enumerate(ODD)], "item_id long, content string, row int, pairs string").repartition(4)
    want, count = plain(ODD)
    expected = sorted(repr((i if i % 5 else None, *w)) for i, w in enumerate(want))
    path = str(tmp_path / "pairs")
    write_alignment(frame, path, BYTES, PIECES)
    counts = pair_counts(spark, path)
    assert {(r.pair // PAIR, r.pair % PAIR): r.links for r in counts.collect()} == dict(count)
    for limit in (alignment.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
        assert sorted(repr((r.item_id, *values(r))) for r in read_alignment(spark, path, counts).collect()) == expected
    assert align_evidence(frame.limit(0), BYTES, PIECES, str(tmp_path / "none")).collect() == []


ENCODER = []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé .,'\n\t́#1<|▁"), max_size=30), max_size=6))
def test_chunks_give_the_ids_of_whole_texts(texts):
    ENCODER[:] = ENCODER or [TwinEncoder(BYTES, PIECES, remembered=40)]
    first, second = ENCODER[0].encode_both(texts)
    for text, a, b in zip(texts, first, second):
        assert list(memoryview(a).cast("H")) == (TOKENIZER.encode(" " + text, add_special_tokens=False).ids if text else [])
        assert list(memoryview(b).cast("H")) == MODEL.encode(text)
