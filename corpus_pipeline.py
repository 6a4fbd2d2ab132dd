"""A corpus-cleaning pipeline of the operators in tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and reread as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, importance, lines, minhash, pieces
from tessera.llm._shared import keep, small, table

#: SQL cannot express the classifier or the sampling of segmentations.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; those without words go."""
    return importance.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that are left without words go."""
    out = lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.filter(F.length(F.btrim("text", F.lit(lines.SPACES))) > 0).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    others = small(minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of benchmark items."""
    hit = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).hits.select("doc_id")
    hit = small(hit, "contaminated")
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, sampled without replacement, with their inclusion scores."""
    found = pieces.sample_segmentations(docs, k=2)
    n_pieces = F.size("pieces").cast("long").alias("n_pieces")
    return found.select(F.col("key").alias("doc_id"), "sample", "pieces", n_pieces, "log_prob", "perturbed", "log_inclusion", "round_trip")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = keep(stage(spark, docs, sf_dir), name)
    return docs
