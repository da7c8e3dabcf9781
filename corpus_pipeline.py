"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again.

quality classifier -> MinHash near-dedup -> benchmark decontamination -> secret scan -> byte-level BPE.
Every stage but the last returns the columns of documents; the last one returns the token ids.

Defined results: a document whose text is null or empty has no content and goes with the quality stage;
rows that repeat an id leave near-dedup as one row; texts of any length are read whole; a null `lang` or
`source` passes through; an empty table gives no rows, and without labels all documents with text stay;
columns beyond those of documents are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, near_dedup, quality, secret_scan
from tidemark.llm.cluster import Scratch, read, with_ids, without_ids
from tidemark.llm.queries import rank_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of a good grade is low; the model learns from `labels`."""
    model = quality.train(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.grade(docs, model).where("quality_kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of least id, of each group of near copies.

    Rows that share an id are one document: it stays if any of them is kept, with the row of least text.
    """
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    ids = Scratch(spark, "near-ids").save(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")), "ids")
    docs = without_ids(docs, ids.where("not kept").select("doc_id"), "doc_id")
    again = ids.where("kept and rows > 1").select("doc_id")
    if again.isEmpty():
        return docs.select(*COLUMNS)
    first = with_ids(docs, again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *COLUMNS[2:])).alias("r")).select("doc_id", "r.*")
    return without_ids(docs, again, "doc_id").select(*COLUMNS).unionByName(first.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of `benchmark`."""
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.where(F.size("contamination") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    masked = secret_scan.mask_secrets(docs, rank_path())
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and their number."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), rank_path())
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: A trained classifier and a tokenizer have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
