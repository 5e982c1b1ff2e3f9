"""A corpus from raw documents to packed sequences, in five stages of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.llm.boilerplate import drop_boilerplate
from pitsignal.llm.mixing import mix_evidence, tempered_targets, token_cells
from pitsignal.llm.packing import pack_evidence
from pitsignal.llm.quality_model import grade_evidence
from pitsignal.llm.queries import POWERS, as_evidence, public_tokenizer, reviews
from pitsignal.llm.set_links import link_evidence
from pitsignal.llm.topics import learn_topics, with_driver
from pitsignal.session import cut_lineage, scratch_path

# SQL has no word for the discriminant, the signatures or the packing
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality score, learned from all labels, is below 0.5.

    A row is judged by its own text: rows of one doc_id, or without one, are told apart by it.
    """
    named = as_evidence(docs).withColumn("item_id", F.struct("item_id", F.xxhash64("content").alias("text_key")))
    graded = grade_evidence(named, reviews(spark, sf_dir), label="success", reviewed="item_id.item_id")
    bad = graded.where("predicted = 0").select(F.col("item_id.item_id").alias("_bad"), F.col("item_id.text_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines by source; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    cleaned = drop_boilerplate(as_evidence(docs, carried=others))
    new = {"text": F.col("content"), "n_chars": F.length("content").cast("long")}
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"carried.`{c}`") for c in docs.columns])


def row_key(doc_id: str, text: str) -> Column:
    """A text for each row that differs where id or text do; rows sort by id, those without one last, then by text hash."""
    place = F.lpad((F.col(doc_id).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 21, "0")
    return F.concat(F.coalesce(place, F.lit("no id")), F.lit(" "), F.hex(F.xxhash64(text)), F.hex(F.crc32(F.coalesce(text, F.lit("")).cast("binary"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-copy component one row: that with the smallest doc_id, of equal ids by the text's hash.

    Near copies have a Jaccard similarity of 0.8 or more on five-word shingles. The vantage-point search
    over SimHash fingerprints and, for what lies beyond its radius, MinHash signatures give the
    candidates; the whole sets decide. Different texts of one doc_id are rows of their own, and rows
    without doc_id take part like any other. Documents without words are copies of one another.
    """
    rows = as_evidence(docs).withColumn("item_id", row_key("item_id", "content"))
    found = link_evidence(rows, shingle=5, percent=80, fingerprints_too=True, empty_linked=True)
    first = found.where(F.col("item_id") == F.col("component_id")).select(F.col("item_id").alias("_row")).distinct()
    keyed = docs.withColumn("_row", row_key("doc_id", "text"))
    return keyed.join(first, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics have their target token shares."""
    rows = as_evidence(docs, carried=[c for c in docs.columns if c != "text"])
    rows = with_driver(rows, learn_topics(rows))
    cells = cut_lineage(token_cells(rows))
    targets = {margin: tempered_targets(cells, margin, power) for margin, power in POWERS.items()}
    sampled = mix_evidence(rows, targets, cells=cells).where("sampled")
    return sampled.select(*[F.col("content").alias(c) if c == "text" else F.col(f"carried.`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences of 2048."""
    return pack_evidence(as_evidence(docs), public_tokenizer("word_bpe_49k.json")).withColumnRenamed("item_id", "doc_id")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("mixing", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
