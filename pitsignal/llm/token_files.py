"""Token files of evidence: frequency-ranked ids, variable-length bytes, separate control bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitsignal.llm.runs import id_bounds, run_of
from pitsignal.llm.tokens import encoder
from pitsignal.session import scratch_path

END_ID = 2
REMEMBERED = 500_000  # chunks that a worker keeps; the ids of a batch need room beside them
BLOCK_IDS = 1 << 20  # ids of a block, at least one item
FILE_IDS = 1 << 22  # ids aimed at in a file
BROADCAST_BLOCKS = 100_000  # up to so many blocks (of 16 bytes) their offsets are broadcast, beyond that joined by shuffle

# fixed tables: the four 2-bit codes of a control byte as byte counts, and what a value of so many bytes keeps
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit values.

    A value takes one to four little-endian bytes; the counts of four values share a control byte,
    two bits each from the lowest on, and the last control byte is filled up with zeros.
    """
    values = np.ascontiguousarray(values, dtype="<u4")
    code = (values > 0xFF).astype(np.uint8)
    code += values > 0xFFFF
    code += values > 0xFFFFFF
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4) <= code[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_block(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The `count` values of a block; byte counts come from a table with a row per control byte."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out & _MASKS[lengths]


def tokenize(evidence: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """item_id and ids: the 16-bit token ids of the whole text and the end id."""
    kind = dict(evidence.dtypes)["item_id"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, spaces_count=True, remembered=REMEMBERED).encode
        end = np.uint16(end_id).tobytes()
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "ids": [x + end for x in encode(batch["content"].tolist())]})

    return evidence.select("item_id", "content").mapInPandas(build, f"item_id {kind}, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs; a task sends one row per id that it has seen."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["ids"]), dtype="<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen.astype(np.int32), "n": total[seen]})

    return tokens.select("ids").mapInPandas(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(evidence: DataFrame, path: str, vocabulary: str, *, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write the token ids of evidence items to `path`, in ascending item_id order over all files.

    Expects item_id and content; null content is empty (the end id alone), a null item_id comes
    first, repeated rows are all written. The folder holds two Parquet data sets: `ranks` (rank, id:
    ids by falling frequency, then by id) and `blocks` (file: a run of ids, block, items, counts, control, data: a
    run of items with the ranks of their ids in variable-length bytes). Parquet is the container, so
    that files can be in any store Spark reads and a lost task is written again.
    """
    spark = evidence.sparkSession
    kind = dict(evidence.dtypes)["item_id"]
    staged = scratch_path(spark, "tokens")
    tokenize(evidence, vocabulary, end_id).write.parquet(staged)
    tokens = spark.read.parquet(staged)
    # at most one row per id of the vocabulary
    counts = sorted(id_counts(tokens).collect(), key=lambda r: (-r["n"], r["id"]))
    spark.createDataFrame([(i, r["id"]) for i, r in enumerate(counts)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(1 << 16, dtype=np.uint32)
    rank[[r["id"] for r in counts]] = np.arange(len(counts))
    rows = tokens.count()
    files = max(1, -(-sum(r["n"] for r in counts) // file_ids))
    _, bounds = id_bounds(tokens.select("item_id"), max(1, -(-rows // files)))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: list = []
        parts: list[np.ndarray] = []
        size = number = 0
        file = None

        def block() -> pd.DataFrame:
            control, data = encode_block(rank[np.concatenate(parts)])
            row = (file, number, list(items), [len(p) for p in parts], control, data)
            return pd.DataFrame([row], columns=["file", "block", "items", "counts", "control", "data"])

        for batch in batches:
            named = batch["item_id"].astype(object).where(batch["item_id"].notna(), None)
            for item, run, ids in zip(named, batch["file"].tolist(), batch["ids"]):
                part = np.frombuffer(ids, dtype="<u2")
                if parts and (run != file or size + len(part) > BLOCK_IDS):
                    yield block()
                    items, parts, size, number = [], [], 0, number + 1
                file = run
                items.append(item)
                parts.append(part)
                size += len(part)
        if parts:
            yield block()

    filed = tokens.withColumn("file", run_of(F.col("item_id"), bounds).cast("int"))
    ordered = filed.repartition("file").sortWithinPartitions("file", "item_id", "ids")
    made = ordered.mapInPandas(blocks, f"file int, block int, items array<{kind}>, counts array<int>, control binary, data binary")
    made.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of the files of `write_token_files`: item_id, start (ids of all items before it), n_tokens, ids.

    `ids` is the little-endian 32-bit ids as bytes. Offsets come from the counts per block, summed
    within a file and over files; no task reads the whole.
    """
    written = spark.read.parquet(f"{path}/blocks")
    kind = dict(written.dtypes)["items"][len("array<") : -1]
    # at most one row per id of the vocabulary
    ids = np.zeros(1 << 16, dtype="<u4")
    for r in spark.read.parquet(f"{path}/ranks").collect():
        ids[r["rank"]] = r["id"]

    sizes = written.select("file", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = sizes.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_in_file"))
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.groupBy("file").agg(F.sum("n").alias("n"))
    of_file = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_of_file"))
    offsets = in_file.join(of_file, "file").select("file", "block", (F.col("_in_file") + F.col("_of_file")).alias("offset"))
    if written.count() <= BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                counts = np.asarray(row.counts, dtype=np.int64)
                values = ids[decode_block(row.control, row.data, int(counts.sum()))]
                ends = np.cumsum(counts)
                texts = [values[a:b].tobytes() for a, b in zip(ends - counts, ends)]
                yield pd.DataFrame({"item_id": list(row.items), "start": row.offset + ends - counts, "n_tokens": counts, "ids": texts})

    placed = written.join(offsets, ["file", "block"]).select("items", "counts", "control", "data", "offset")
    return placed.mapInPandas(decode, f"item_id {kind}, start long, n_tokens long, ids binary")
