"""Alignment of two tokenizers over evidence: where their tokens end together, and which ids meet there."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsignal.llm.tokens import _ODD, _RUNS, ChunkEncoder
from pitsignal.session import cut_lineage

REMEMBERED = 250_000  # chunks whose ids a worker keeps, for both vocabularies
PART_CHARS = 2_500_000  # characters aligned at once
BROADCAST_PAIRS = 1_500_000  # id pairs up to which their counts are sent to all workers
PAIR = 1 << 16  # a pair is A id * PAIR + B id
SPACE = "▁"

_ROW = (
    "row long, item_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>, "
    "part_pairs array<long>, part_times array<long>"
)


class TwinEncoder(ChunkEncoder):
    """Ids of a space and a text by a byte-level vocabulary (A), and of the text by a piece model (B).

    A piece never holds a space after another character, nor a line end, and A's chunks begin with
    one of them: both vocabularies cut a text at the same places, so a chunk seen before need not be
    encoded again by either. Texts with other white space or the piece model's space sign are
    encoded whole. Marks of special tokens in a text are plain text.
    """

    def __init__(self, bytes_path: str, pieces_path: str, remembered: int = REMEMBERED) -> None:
        super().__init__(bytes_path, spaces_count=True, remembered=remembered)
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._literal = Tokenizer.from_file(bytes_path)
        self._literal.encode_special_tokens = True
        self._model = SentencePieceProcessor(model_file=pieces_path)
        self._known_pieces: dict[str, bytes] = {}
        self.token_bytes = [_unmapped(t) for t in self._tokens()]
        self.piece_bytes = [self._piece(i) for i in range(self._model.get_piece_size())]

    def _tokens(self) -> list[str]:
        named = self._tokenizer.get_vocab()
        out = [""] * (max(named.values()) + 1)
        for token, i in named.items():
            out[i] = token
        return out

    def _piece(self, i: int) -> bytes:
        text = self._model.id_to_piece(i)
        if self._model.is_byte(i):
            return bytes([int(text[3:5], 16)])
        return text.replace(SPACE, " ").encode()

    def encode_both(self, texts: Sequence[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Little-endian 16-bit ids of each text by A and by B; null is empty."""
        first, second = [b""] * len(texts), [b""] * len(texts)
        chunked = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if text[0] in " \n" or text[-1] == " " or SPACE in text or any(map(text.__contains__, _RUNS)) or any(map(text.__contains__, _ODD)):
                first[i] = np.array(self._literal.encode(" " + text, add_special_tokens=False).ids, "<u2").tobytes()
                second[i] = np.array(self._model.encode(text), "<u2").tobytes()
            else:
                chunked.append(i)
        if chunked:
            for i, a, b in zip(chunked, *self._by_chunks([texts[i] for i in chunked])):
                first[i], second[i] = a, b
        return first, second

    def _by_chunks(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        numbered = cut.values.dictionary_encode()
        words = numbered.dictionary.to_pylist()
        begins = cut.offsets.to_numpy()
        fresh_ids = self._new_ids([w for w in words if w not in self._known])
        fresh_pieces = self._new_pieces([w for w in words if w not in self._known_pieces])
        found = []
        for known, fresh in ((self._known, fresh_ids), (self._known_pieces, fresh_pieces)):
            parts = pa.array([fresh[w] if w in fresh else known[w] for w in words], pa.large_binary()).take(numbered.indices)
            ends = np.frombuffer(parts.buffers()[1], dtype=np.int64)[begins].tolist()
            data = memoryview(parts.buffers()[2])
            found.append([bytes(data[a:b]) for a, b in zip(ends, ends[1:])])
            if len(known) < self._remembered:
                known.update(fresh)
        return found[0], found[1]

    def _new_ids(self, chunks: list[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if self._plain(c)]
        fresh = self._encode_new(plain, self._between_plain)
        fresh.update(self._encode_new([c for c in chunks if c not in fresh], self._between_marks))
        return fresh

    def _new_pieces(self, chunks: list[str]) -> dict[str, bytes]:
        # the model puts a space before a text: it belongs to a chunk unless a line end starts the chunk
        ids = self._model.encode(chunks) if chunks else []
        return {c: np.array(own[c[:1] == "\n" :], "<u2").tobytes() for c, own in zip(chunks, ids)}


def _unmapped(token: str) -> bytes:
    """Bytes of an entry of a byte-level vocabulary, which writes each byte as one printable character."""
    table = _byte_alphabet()
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


@cache
def _byte_alphabet() -> dict[str, int]:
    """The alphabet's rule: printable Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))})
    return table


class Aligner:
    """Turns texts into rows of counts, groups and linked pairs, by Arrow arrays over a whole part."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        self.encoder = TwinEncoder(bytes_path, pieces_path)
        self._a = pa.array(self.encoder.token_bytes, pa.binary())
        self._b = pa.array(self.encoder.piece_bytes, pa.binary())
        n_a, n_b = len(self._a), len(self._b)
        names = [f"{i}{end}" for end in ",|" for i in range(n_a)]
        names += [str(i) + end for end in (",", ";", "") for i in range(n_b)]
        self._names = pa.array(names, pa.large_binary())
        self._n_a, self._n_b = n_a, n_b

    def _lists(self, texts: Sequence[str | None]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids by A and by B of every text; none where the tokens' bytes are not those of a space and the text."""
        first, second = self.encoder.encode_both(texts)
        for i, text in enumerate(texts):
            if text:
                want = b" " + text.encode("utf-8", "surrogatepass")
                if not (_joined(self._a, first[i]) == want == _joined(self._b, second[i])):
                    first[i] = second[i] = b""
        return _list_array(first), _list_array(second)

    def rows(self, texts: Sequence[str | None]) -> dict[str, pa.Array]:
        a, b = self._lists(texts)
        n_texts = len(texts)
        flat_a, text_a, end_a = _ends(a, self._a)
        flat_b, text_b, end_b = _ends(b, self._b)
        left = pa.table({"text": text_a, "end": end_a, "at_a": pa.array(np.arange(len(flat_a)))})
        right = pa.table({"text": text_b, "end": end_b, "at_b": pa.array(np.arange(len(flat_b)))})
        met = left.join(right, ["text", "end"], join_type="inner", use_threads=False)
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[met["at_a"].to_numpy()] = True
        last_b[met["at_b"].to_numpy()] = True
        ids_a, ids_b = flat_a.to_numpy(), flat_b.to_numpy()
        # token ends ascend in both, so the nth link of a part is its nth closing A token and nth closing B token
        pair = ids_a[last_a].astype(np.int64) * PAIR + ids_b[last_b]
        owner = text_a.to_numpy()[last_a]
        counted = pa.table({"text": owner, "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
        whole = counted.group_by("pair", use_threads=False).aggregate([("count_all", "sum")])
        order = np.argsort(counted["text"].to_numpy(), kind="stable")
        bounds = pa.array(np.append(0, np.cumsum(np.bincount(counted["text"].to_numpy(), minlength=n_texts))), pa.int32())
        n_a, n_b = _sizes(a), _sizes(b)
        none = pa.array([0] + [len(whole)] * n_texts, pa.int32()) if n_texts else pa.array([0], pa.int32())
        return {
            "n_a": pa.array(n_a),
            "n_b": pa.array(n_b),
            "n_groups": pa.array(np.bincount(owner, minlength=n_texts).astype(np.int64)),
            "groups_sha256": pa.array(self._digests(ids_a, ids_b, last_a, last_b, n_a, n_b), pa.string()),
            "pairs": pa.ListArray.from_arrays(bounds, pa.array(counted["pair"].to_numpy()[order])),
            "times": pa.ListArray.from_arrays(bounds, pa.array(counted["count_all"].to_numpy()[order].astype(np.int32))),
            # the part's counts ride on its first row
            "part_pairs": pa.ListArray.from_arrays(none, whole["pair"].combine_chunks()),
            "part_times": pa.ListArray.from_arrays(none, whole["count_all_sum"].combine_chunks()),
        }

    def _digests(self, ids_a, ids_b, last_a, last_b, n_a, n_b) -> list[str]:
        """SHA-256 of each text's groups, `a1,a2|b1;a3|b2,b3`: every id is written with the sign after it."""
        final = np.zeros(len(ids_b), bool)
        final[np.cumsum(n_b)[n_b > 0] - 1] = True
        begin_b = np.append(0, np.flatnonzero(last_b) + 1)
        stop_a = np.flatnonzero(last_a) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + begin_b[group_a]] = ids_a + self._n_a * last_a
        order[np.arange(len(ids_b)) + stop_a[group_b]] = 2 * self._n_a + ids_b + self._n_b * (last_b.astype(np.int64) + final)
        written = self._names.take(pa.array(order))
        at = np.frombuffer(written.buffers()[1], np.int64)[np.append(0, np.cumsum(n_a + n_b))].tolist()
        data = memoryview(written.buffers()[2] or b"")
        return [hashlib.sha256(data[x:y]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]


def _joined(entries: pa.Array, ids: bytes) -> bytes:
    picked = entries.take(pa.array(np.frombuffer(ids, "<u2")))
    ends = np.frombuffer(picked.buffers()[1], np.int32)
    return bytes(memoryview(picked.buffers()[2] or b"")[ends[0] : ends[len(picked)]]) if len(picked) else b""


def _list_array(ids: list[bytes]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(x) // 2 for x in ids], dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u2").astype(np.int32)))


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _ends(lists: pa.ListArray, entries: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flat ids, the text each is of, and the byte offset in the text at which each ends."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.cast(pc.take(pc.binary_length(entries), flat), pa.int64()))
    before = np.append(0, total.to_numpy())[lists.offsets.to_numpy()[:-1]]
    return flat, parent, pc.subtract(total, pc.take(pa.array(before), parent))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One aligner per worker process and vocabularies."""
    key = (bytes_path, pieces_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= PART_CHARS):
            size += len(texts[upto] or "")
            upto += 1
        yield at, upto
        at = upto


def write_alignment(evidence: DataFrame, path: str, bytes_path: str, pieces_path: str) -> None:
    """One row per evidence item (item_id, content) below `path`: counts, digest of the groups, linked pairs.

    `pairs` holds the different (A id * 65536 + B id) that end together in the text, `times` how often.
    """
    kind = dict(evidence.dtypes)["item_id"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(bytes_path, pieces_path)
        for batch in batches:
            texts = batch["content"].to_pylist()
            for at, upto in _parts(texts):
                found = own.rows(texts[at:upto])
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].slice(at, upto - at), batch["item_id"].slice(at, upto - at), *found.values()], ["row", "item_id", *found]
                )

    numbered = evidence.select(F.monotonically_increasing_id().alias("row"), "item_id", "content")
    numbered.mapInArrow(align, _ROW.format(kind=kind)).write.parquet(path)


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """pair, links (how often its ids end together in all texts) and best (no A id meets the B id more often).

    The workers' counts of a part are merged; a vocabulary bounds the pairs of one B id.
    """
    parts = spark.read.parquet(path).select(F.explode(F.arrays_zip("part_pairs", "part_times")).alias("p"))
    counts = parts.groupBy(F.col("p.part_pairs").alias("pair")).agg(F.sum("p.part_times").alias("links"))
    highest = F.max("links").over(Window.partitionBy(F.col("pair") % PAIR))
    return counts.withColumn("best", F.col("links") == highest)


def read_alignment(spark: SparkSession, path: str, counts: DataFrame) -> DataFrame:
    """The rows of `path` with n_links, n_best and count_sum by the counts of all texts.

    The counts go to all workers while they are at most BROADCAST_PAIRS; beyond that the linked
    pairs are joined by shuffle, where the session's skew handling splits frequent pairs.
    """
    rows = spark.read.parquet(path)
    small = counts.count() <= BROADCAST_PAIRS
    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    joined = linked.join(F.broadcast(counts) if small else counts, "pair")
    sums = joined.groupBy("row").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("times")).alias("count_sum"),
    )
    none = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(
        "item_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256"
    )


def align_evidence(evidence: DataFrame, bytes_path: str, pieces_path: str, path: str) -> DataFrame:
    """How two tokenizers cut every evidence text, and how usual their linked ids are in all texts.

    Expects item_id and content. A is a byte-level vocabulary read with a space before the text, B a
    sentencepiece model, which puts one there itself; special tokens are not used. Byte offsets where
    tokens of both end cut the tokens into groups; the two that end there are linked. Returns item_id,
    n_a, n_b (tokens), n_groups, n_links, n_best (links whose ids meet as often as the B id meets any
    A id, ties included), count_sum (over the links, how often their ids are linked in all texts) and
    groups_sha256 (hex, of `a1,a2|b1;a3|b2,b3`), one row per evidence row. Files below `path` hold the
    linked pairs.

    Null or empty content, and a text that the tokens of A or B do not give back byte by byte (as
    with the sign U+2581), has no tokens: zeros and an empty digest. Repeated rows count each. An empty
    table gives an empty result. Other columns are ignored, whatever their name.

    Inside a task Arrow flattens the token lists, sums byte lengths per text, joins on (text, end)
    and counts the pairs of a part; Spark merges the parts' counts. A text is aligned whole, so
    memory follows the longest text, and else PART_CHARS.
    """
    write_alignment(evidence, path, bytes_path, pieces_path)
    spark = evidence.sparkSession
    return read_alignment(spark, path, cut_lineage(pair_counts(spark, path)))
