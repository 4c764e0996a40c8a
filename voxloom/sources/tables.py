"""Readers and writers: raw recordings, fixed-schema tables, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import audio


def scan_recordings(spark: SparkSession, path: str, pattern: str = "*", metadata: bool = True) -> DataFrame:
    """Raw recordings below a folder or bucket (``file:``, ``s3a:``, ...): path, length, content and, on request, what they are.

    Spark lists and splits the files; nothing is read on the driver.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    if not metadata:
        return files
    return files.withColumns(
        {
            "container": audio.sniff(F.col("content")),
            "meta": audio.wav_metadata(F.col("content"), F.col("path")),
        }
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table in its declared column order (folder columns would come last)."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_table(df: DataFrame, path: str, schema: T.StructType, partition_by: str | None = "status", mode: str = "errorifexists") -> None:
    """Write in the fixed column order and types; ``status`` folders prune job and delivery scans."""
    have = set(df.columns)
    rows = df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
    writer = rows.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_transcripts(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines of (recording_id, page_no, transcript)."""
    pages.write.mode(mode).json(path)
