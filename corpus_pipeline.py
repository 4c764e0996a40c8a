"""From raw documents to packed training sequences: quality, near copies, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, packing, quality, simhash, substrings
from voxloom.llm.common import boxed, row_key, table, unboxed, written
from voxloom.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of operator 8; rows and columns are otherwise as they were.

    The verdict depends on the text alone, so it is joined by a key of id and text: repeated rows share it, and rows
    without an id have one. Null, empty and very short texts fail.
    """
    keyed = boxed(docs).withColumn("_key", row_key(F.col("_row.doc_id"), F.col("_row.text")))
    judged = quality.repetition_quality(keyed.select("_key", "_row.text"), id_col="_key").where("not kept")
    gone = written(judged.select(F.col("doc_id").alias("_gone")).distinct(), "rejected")
    return unboxed(keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 2; five-word shingles, similarity 0.8 or more)."""
    return simhash.near_duplicates_out(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a document with a smaller id has in the same 13-word window (operator 6)."""
    return substrings.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item (operator 3)."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens (operator 5)."""
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Shingle hashes, suffix arrays and packing have no SQL form; tests/llm runs the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
