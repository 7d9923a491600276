"""The corpus pipeline: quality filter, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, with n_chars as of the text they return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, jaccard, line_dedup, packing, quality, simhash
from lakeloom.llm.common import few, own_dir, saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes altogether if benchmark passages cover at least this share of its words.
MOST_COVERED = 0.8


def _with_text(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: each row by its text, a null one as an empty one, rows without an id
    too. Without labels to learn from all rows have the same score; an empty table stays empty."""
    scored = quality.classify(docs.select(*COLUMNS), quality.training(docs), table(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 1).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents stay, if empty. Null texts stay null, rows without an id as they are,
    and rows that repeat an id are parts of one document."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _with_text(out, F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; documents without an id stay.

    Groups of near fingerprints of 5-word shingles come first, then, of what stays, groups of texts whose 5-word shingles
    have a Jaccard similarity of at least 0.8: no two of the documents that are left have that. Null and blank texts are one
    group, rows that repeat an id go or stay together, and an empty table stays empty.
    """
    marked = jaccard.hashed(docs, words_each=5)
    near = simhash.grouped(marked.select(F.col("id").alias("doc_id"), "fp"))
    gone = saved(near.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    more = jaccard.groups(docs, gone.withColumnRenamed("doc_id", "id"), marked=marked).select(F.col("node").alias("doc_id"))
    gone = few(saved(gone.unionByName(more)))
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; a document that is hardly anything else goes altogether. Null texts stay null; rows that repeat
    are each judged, alike; with an empty benchmark all stays."""
    out = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    out = out.where((F.col("n_hit") == 0) | (F.col("n_hit") < MOST_COVERED * F.col("n_words")))
    return _with_text(out, F.col("clean_text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bucket, batch and slot. Null and blank texts have no words; each row has a place of its own,
    also where ids repeat or are null."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier and XXH64 have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), own_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
