"""The numbered operators on the test tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.llm import oracles
from pitsignal.llm.alignment import align_evidence
from pitsignal.llm.boilerplate import drop_boilerplate
from pitsignal.llm.fingerprints import fingerprint_evidence
from pitsignal.llm.merkle import folded, path_digest, record_digest, seal_evidence
from pitsignal.llm.mixing import mix_evidence, tempered_targets, token_cells
from pitsignal.llm.near_copies import near_copies
from pitsignal.llm.packing import pack_evidence
from pitsignal.llm.quality_model import grade_evidence
from pitsignal.llm.quality_rules import weigh_evidence
from pitsignal.llm.resharding import plan_shards, read_shards, rewrite_shards
from pitsignal.llm.set_links import link_evidence
from pitsignal.llm.token_files import read_token_files, write_token_files
from pitsignal.llm.topics import count_words, learn_topics, topic_of, with_counts
from pitsignal.llm.toxicity import flag_evidence
from pitsignal.session import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS, OLD_SHARDS = 16, 12
POWERS = oracles.POWERS


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_evidence(documents: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """Documents as recorded tool results.

    `carried` names columns to take along in one struct, where no name can clash.
    """
    along = [] if carried is None else [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("carried")]
    return documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), F.col("source").alias("tool"), "lang", *along)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_evidence(table(spark, sf_dir, "documents"))


def reviews(spark: SparkSession, sf_dir: str, folds: int = 0, held: int = 0) -> DataFrame:
    """Labels as reviews; with `folds` only those outside the held-out fold."""
    rows = table(spark, sf_dir, "labels")
    if folds:
        rows = rows.where(fold("doc_id", folds) != held)
    return rows.select(F.col("doc_id").alias("item_id"), F.col("quality").alias("success"), "toxic")


def fold(item: str, folds: int):
    return F.crc32(F.col(item).cast("string").cast("binary")) % folds


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules", oracles.QUALITY_RULES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weigh_evidence(evidence(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")
    return found.withColumn("posterior", F.round("posterior", 6))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grade_evidence(evidence(spark, sf_dir), reviews(spark, sf_dir, 3, 1), label="success")
    return graded.select(F.col("item_id").alias("doc_id"), F.coalesce(fold("item_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op3_line_dedup", oracles.LINE_DEDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(evidence(spark, sf_dir))
    return cleaned.select(
        F.col("item_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256")
    )


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flag_evidence(evidence(spark, sf_dir), reviews(spark, sf_dir, 5, 0), label="toxic")
    return flagged.select(
        F.col("item_id").alias("doc_id"), F.coalesce(fold("item_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "threshold", "flagged"
    )


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(evidence(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_evidence(evidence(spark, sf_dir), public_tokenizer("word_bpe_49k.json")).withColumnRenamed("item_id", "doc_id")


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(evidence(spark, sf_dir), path, public_tokenizer("byte_bpe_50k.json"))
    items = read_token_files(spark, path)
    return items.select(F.col("item_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_evidence(evidence(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")


@query("op9_mixing", oracles.MIXING)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir)
    # texts are read once: what follows needs their words by bin only
    counts = F.col("counts")
    rows = cut_lineage(with_counts(rows, "item_id", "tool", "lang"))
    weights = learn_topics(rows, counts=counts)
    rows = cut_lineage(rows.select("item_id", "tool", "lang", topic_of(counts, weights).alias("driver"), count_words(counts).alias("tokens")))
    cells = cut_lineage(token_cells(rows, tokens=F.col("tokens")))
    targets = {margin: tempered_targets(cells, margin, power) for margin, power in POWERS.items()}
    mixed = mix_evidence(rows, targets, cells=cells)
    return mixed.select(
        F.col("item_id").alias("doc_id"),
        F.col("tool").alias("source"),
        "lang",
        F.col("driver").alias("topic"),
        F.round("weight", 9).alias("weight"),
        F.round("probability", 9).alias("probability"),
        F.round("margin_error", 5).alias("margin_error"),
        "sampled",
    )


@query("op10_resharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).select("item_id", "content", F.coalesce(F.pmod(F.crc32("tool"), F.lit(OLD_SHARDS)), F.lit(0)).cast("int").alias("shard"))
    path = scratch_path(spark, "shards")
    planned = plan_shards(rows, SHARDS)
    _, unaffected = rewrite_shards(planned, path)
    return read_shards(planned, path, unaffected).select(
        F.col("item_id").alias("doc_id"),
        "size",
        F.crc32(F.coalesce("content", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_minhash_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_evidence(evidence(spark, sf_dir))
    kept = F.col("item_id").eqNullSafe(F.col("component_id")).alias("kept")
    return linked.select(F.col("item_id").alias("doc_id"), "n_shingles", "component_id", kept)


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
    return align_evidence(evidence(spark, sf_dir), first, second, scratch_path(spark, "alignment")).withColumnRenamed("item_id", "doc_id")


@query("op13_merkle_manifest", oracles.MERKLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = as_evidence(documents, carried=["n_chars"]).withColumn("n_chars", F.col("carried.n_chars"))
    altered = F.crc32(F.col("item_id").cast("string").cast("binary")) % 7 == 0
    names = ("item_id", "tool", "lang", "n_chars", "content")
    original, changed = (record_digest(*[F.col(c) + 1 if c == "n_chars" and plus else F.col(c) for c in names]) for plus in (False, True))
    rows = rows.withColumn("shown", F.when(altered, changed).otherwise(original))
    sealed = seal_evidence(rows, fields=names, by="lang", carried=["shown"])
    back = sealed.withColumn("folded_root", folded(F.col("path"), F.col("shown")))
    return back.select(
        F.col("item_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        path_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
