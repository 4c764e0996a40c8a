"""From attributed words to utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.text import strip
from voxloom.operators import blocks
from voxloom.operators.intervals import attribute_words
from voxloom.params import BLOCK_ROWS, DEFAULTS, UNKNOWN_SPEAKER
from voxloom.session import cut

REC = ["recording_id"]


def smooth_speakers(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Absorb one-word speaker spikes, left to right.

    A word is a candidate when both neighbours agree and differ from it. Since
    a repaired word changes what its right neighbour sees, the 1st, 3rd, 5th...
    of consecutive candidates take the left neighbour's speaker.
    """

    def settled(p: Column, c: Column, n: Column) -> Column:
        return n.isNull() | (p["speaker_id"] != n["speaker_id"]) | (c["speaker_id"] == p["speaker_id"])

    runs = blocks.islands(words, REC, ["pos"], blocks.block_of("pos", block_rows), ["speaker_id"], settled)
    odd = ((F.col("idx") - F.col("island")) % 2) == 1
    return runs.select(
        *[c for c in words.columns if c != "speaker_id"],
        F.when(odd, F.col("prev.speaker_id")).otherwise(F.col("speaker_id")).alias("speaker_id"),
    )


def sessionise(
    words: DataFrame, max_silence: float = DEFAULTS.max_silence, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``utt_key``: place of the utterance's first word in the recording.

    A new utterance starts on a speaker change or after more than ``max_silence`` seconds.
    """

    def starts(p: Column, c: Column, n: Column) -> Column:
        return (c["speaker_id"] != p["speaker_id"]) | (c["start_time"] - p["end_time"] > max_silence)

    out = blocks.islands(
        words,
        REC,
        ["pos"],
        blocks.block_of("pos", block_rows),
        ["speaker_id", "start_time", "end_time"],
        starts,
    )
    return out.select(*words.columns, F.col("island").alias("utt_key"))


def build_utterances(words: DataFrame) -> DataFrame:
    """One row per ``utt_key``: start of the first word, end of the last, joined text."""
    rows = words.withColumn("_t", strip(F.col("word")))
    rows = rows.withColumn("_tok", F.when(F.col("_t") != "", F.struct("pos", F.col("_t").alias("t"))))
    out = rows.groupBy("recording_id", "utt_key").agg(
        F.count("_tok").alias("_n"),
        F.min_by("speaker_id", "pos").alias("speaker_id"),
        F.min_by("start_time", "pos").alias("start_time"),
        F.max_by("end_time", "pos").alias("end_time"),
        F.array_join(F.transform(F.sort_array(F.collect_list("_tok")), lambda x: x["t"]), " ").alias("text"),
    )
    return out.where("_n > 0").drop("_n")


def normalise_speakers(utterances: DataFrame, order: str = "utt_key", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rename speakers SPEAKER_00, SPEAKER_01... by first appearance; the unknown label stays."""
    rows = utterances.withColumn(blocks.BLK, blocks.block_of(order, block_rows))
    seen = (
        rows.where(F.col("speaker_id") != UNKNOWN_SPEAKER)
        .groupBy("recording_id", "speaker_id", blocks.BLK)
        .agg(F.min(order).alias("_first"))
        .withColumn("_first", F.min("_first").over(Window.partitionBy("recording_id", "speaker_id")))
        .withColumn("_rank", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("_first")))
        .select("recording_id", "speaker_id", blocks.BLK, F.format_string("SPEAKER_%02d", F.col("_rank") - 1).alias("_l"))
    )
    named = rows.join(seen, ["recording_id", "speaker_id", blocks.BLK], "left")
    return named.select(
        *[F.coalesce("_l", "speaker_id").alias(c) if c == "speaker_id" else F.col(c) for c in utterances.columns]
    )


def suppress_repeats(words: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Drop a word equal (stripped, lower case) to the two before it; ``pos`` must be dense."""
    near = blocks.halo(words, "pos", block_rows, before=2, after=0)
    w = blocks.halo_window(REC, "pos")
    token = F.lower(strip(F.col("word")))
    near = near.withColumn("_t", token)
    same = (F.col("_t") == F.lag("_t", 1).over(w)) & (F.col("_t") == F.lag("_t", 2).over(w))
    kept = near.withColumn("_drop", F.coalesce(same, F.lit(False)))
    return blocks.drop_halo(kept).where(~F.col("_drop")).drop("_t", "_drop")


def fuse(
    words: DataFrame,
    segments: DataFrame,
    max_silence: float = DEFAULTS.max_silence,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Words and speaker segments to utterances: (recording_id, utt_key, speaker_id, start_time, end_time, text)."""
    cols = ["recording_id", "pos", "word", "start_time", "end_time"]
    spoken = attribute_words(words.select(*cols), segments, block_rows=block_rows).select(*cols, "speaker_id")
    # Written tables are restart points when executors are lost, and keep each plan short.
    smooth = cut(smooth_speakers(spoken, block_rows), "smooth")
    built = cut(build_utterances(sessionise(smooth, max_silence, block_rows)), "utterances")
    return normalise_speakers(built, block_rows=block_rows).select(
        "recording_id", "utt_key", "speaker_id", "start_time", "end_time", "text"
    )
