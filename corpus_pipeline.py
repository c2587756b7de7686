"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, personal data, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before it kept. All but
the last return the columns of documents; a stage that changes a text sets n_chars to its new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import lines, packing, pii, quality, resemblance
from lamina.llm.common import cut, discard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go. A null or empty text has no words and goes; rows that
    repeat a doc_id are judged one by one; without labels of both classes the base rules alone decide; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_rows(docs.select(COLUMNS), quality.train(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document or place holds are taken out. A document left without any word goes, unless it had none before.
    Of equal chunks the one with the smallest (doc_id, first line) stays, a null doc_id being last; a null text stays; an empty table stays empty."""
    left = lines.remove_chunks(docs.select(COLUMNS), "doc_id", "text")
    return _sized(left.where((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of five-word shingles 0.8 or more) the smallest doc_id stays.
    Texts without words, null ones too, are one group; rows that share a doc_id stay or go together; a null doc_id is never the smallest unless alone; an empty table stays empty."""
    return resemblance.deduplicate(docs.select(COLUMNS), "doc_id", "text")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. Null and empty texts and all rows stay; equal texts give equal results; an empty table stays empty."""
    return _sized(pii.redact(docs.select(COLUMNS), "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, batch, position, padding) of every document left. A null or empty text has length 0; equal lengths are
    numbered in a fixed order of their doc_ids; rows that repeat a doc_id each have a place; an empty table gives no rows."""
    return packing.pack_texts(docs, "doc_id", "text")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The classifier and the taggers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
            discard(before)
    return docs
