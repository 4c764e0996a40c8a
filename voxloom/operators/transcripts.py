"""Transcript outputs: text lines, nested JSON pages, prompts and payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.numbers import exact_round
from voxloom.operators import blocks
from voxloom.params import BLOCK_ROWS

PAGE_ROWS = 10_000
REC = ["recording_id"]

SUMMARY_TYPE = T.StructType(
    [
        T.StructField("supported", T.BooleanType()),
        T.StructField("total_overlap_seconds", T.DoubleType()),
        T.StructField("overlap_percentage", T.DoubleType()),
        T.StructField("interrupt_count", T.IntegerType()),
        T.StructField(
            "overlaps",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("speakers", T.ArrayType(T.StringType())),
                        T.StructField("start_time", T.DoubleType()),
                        T.StructField("end_time", T.DoubleType()),
                        T.StructField("duration", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


def transcript_line(speaker: Column, start: Column, end: Column, text: Column) -> Column:
    """``[00.00s - 00.00s] SPEAKER      : text``"""
    wide = F.when(F.length(speaker) < 12, F.rpad(speaker, 12, " ")).otherwise(speaker)
    times = F.format_string("[%05.2fs - %05.2fs]", exact_round(start), exact_round(end))
    return F.concat(times, F.lit(" "), wide, F.lit(" : "), text)


def transcript_pages(
    utterances: DataFrame, order: str = "utt_no", page_rows: int = PAGE_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per recording and page, the JSON array of {speaker, start, end, text}.

    A page holds at most ``page_rows`` utterances; a recording's pages in order are its whole transcript.
    """
    item = F.struct(
        F.col("speaker_id").alias("speaker"),
        F.col("start_time").alias("start"),
        F.col("end_time").alias("end"),
        "text",
    )
    pages = blocks.nest_pages(
        utterances.select(*REC, order, "speaker_id", "start_time", "end_time", "text"),
        REC,
        [order],
        blocks.block_of(order, block_rows),
        item,
        page_rows,
        "lines",
    )
    return pages.select(*REC, "page_no", F.to_json("lines").alias("transcript"))


# The instruction around the transcript.
PROMPT_HEAD = "Aşağıdaki konuşma dökümünde konuşmacı geçişlerini kontrol et:\n\n"
PROMPT_TAIL = "\n\nDüzeltilmiş konuşmacı bloklarını formatla."


def render_prompts(
    utterances: DataFrame, order: str = "utt_no", page_rows: int = PAGE_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Review prompt per recording and page: "speaker: text" lines inside a fixed instruction."""
    line = F.concat(F.col("speaker_id"), F.lit(": "), F.col("text"))
    pages = blocks.nest_pages(
        utterances.select(*REC, order, "speaker_id", "text"),
        REC,
        [order],
        blocks.block_of(order, block_rows),
        line,
        page_rows,
        "lines",
    )
    return pages.select(
        *REC, "page_no", F.concat(F.lit(PROMPT_HEAD), F.array_join("lines", "\n"), F.lit(PROMPT_TAIL)).alias("prompt")
    )


def ordinals(utterances: DataFrame, tie: Sequence[str], block_seconds: float = 600.0) -> DataFrame:
    """Adds ``utt_no``: 0-based place by start time, then the ``tie`` columns. Rows without a start come first."""
    block = F.coalesce(blocks.block_of("start_time", block_seconds), F.lit(-(1 << 62)).cast("long"))
    numbered = blocks.row_numbers(utterances, REC, ["start_time", *tie], block, "_no")
    return numbered.select(*utterances.columns, (F.col("_no") - 1).alias("utt_no"))


def record_pages(
    records: DataFrame,
    utterances: DataFrame,
    tie: Sequence[str],
    page_rows: int = PAGE_ROWS,
    block_seconds: float = 600.0,
) -> DataFrame:
    """Records with their utterances nested in order; one page unless a record
    has more than ``page_rows`` utterances. Records without any get an empty array."""
    item = F.struct("utterance_id", "speaker_id", "start_time", "end_time", "text")
    cols = ["recording_id", "utterance_id", "speaker_id", "start_time", "end_time", "text", *tie]
    pages = blocks.nest_pages(
        utterances.select(*dict.fromkeys(cols)),
        REC,
        ["start_time", *tie],
        blocks.block_of("start_time", block_seconds),
        item,
        page_rows,
        "utterances",
    )
    joined = records.join(pages, "recording_id", "left")
    empty = F.expr("cast(array() as array<struct<utterance_id:string,speaker_id:string,start_time:double,end_time:double,text:string>>)")
    return joined.withColumns(
        {
            "page_no": F.coalesce("page_no", F.lit(0).cast("long")),
            "utterances": F.coalesce("utterances", empty),
        }
    )


def _joined_text(pages: DataFrame, name: str, out: str) -> DataFrame:
    """Pages of arrays as the text of one JSON array's inside per recording; pages become text before they meet."""
    text = F.to_json(name, {"ignoreNullFields": "false"})
    part = F.struct("page_no", F.substring(text, F.lit(2), F.length(text) - 2).alias("t"))
    parts = pages.select("recording_id", part.alias("_p"))
    return parts.groupBy("recording_id").agg(F.array_join(F.sort_array(F.collect_list("_p"))["t"], ",").alias(out))


def completed_bodies(
    records: DataFrame,
    utterances: DataFrame,
    summaries: DataFrame,
    overlaps: DataFrame,
    tie: Sequence[str],
    page_rows: int = PAGE_ROWS,
    block_seconds: float = 600.0,
) -> DataFrame:
    """Notification bodies of finished jobs: (records' columns, ``payload``), one whole body per record.

    ``records`` need recording_id, job_id, file_name and language; ``summaries`` (``intervals.overlap_summary``) hold at
    most one row a recording, and ``overlaps`` are ``intervals.overlap_pages``. Without a summary it is null. Utterances
    are ordered by start, then ``tie``. They become text in pages, so that a body is put together from a few strings;
    the body is one string, as it is sent.
    """
    pages = blocks.nest_pages(
        utterances.select(*dict.fromkeys(["recording_id", "speaker_id", "start_time", "end_time", "text", *tie])),
        REC,
        ["start_time", *tie],
        blocks.block_of("start_time", block_seconds),
        F.struct("speaker_id", "start_time", "end_time", "text"),
        page_rows,
        "_items",
    )
    flat = [f for f in SUMMARY_TYPE if f.name != "overlaps"]
    known = summaries.select("recording_id", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in flat]).alias("_summary"))
    head = F.struct(F.col("job_id").cast("string").alias("job_id"), "file_name", F.lit("COMPLETED").alias("status"), "language")

    def opened(column: Column) -> Column:
        text = F.to_json(column, {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(1), F.length(text) - 1)

    inside = lambda c: F.coalesce(c, F.lit(""))
    summary = F.when(
        F.col("_summary").isNotNull(), F.concat(opened(F.col("_summary")), F.lit(',"overlaps":['), inside("_pairs"), F.lit("]}"))
    ).otherwise("null")
    body = F.concat(
        opened(head), F.lit(',"overlap_summary":'), summary, F.lit(',"utterances":['), inside("_said"), F.lit("]}")
    )
    rows = records
    for more in (known, _joined_text(pages, "_items", "_said"), _joined_text(overlaps, "overlaps", "_pairs")):
        rows = rows.join(more, "recording_id", "left")
    return rows.select(*records.columns, body.alias("payload"))


def failed_payload(attempts: Column, message: Column) -> Column:
    """Notification body of a job that failed for good."""
    body = F.struct(
        F.col("job_id").cast("string").alias("job_id"),
        "file_name",
        F.lit("FAILED").alias("status"),
        attempts.alias("attempts"),
        message.alias("error_message"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def summary_to_json(summary: Column) -> Column:
    return F.to_json(summary, {"ignoreNullFields": "false"})


def summary_from_json(text: Column) -> Column:
    """Parsed overlap summary; malformed text gives null."""
    parsed = F.from_json(text, SUMMARY_TYPE, {"mode": "PERMISSIVE"})
    return F.when(parsed["total_overlap_seconds"].isNotNull() | parsed["interrupt_count"].isNotNull(), parsed)
