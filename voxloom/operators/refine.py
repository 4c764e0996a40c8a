"""Clean, re-split and merge utterances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.functions.numbers import exact_round
from voxloom.operators import blocks
from voxloom.params import BLOCK_ROWS, DEFAULTS, Params
from voxloom.session import cut

REC = ["recording_id"]
ORDER = ["utt_no", "part", "sub"]
CONTENT = ["speaker_id", "start_time", "end_time", "text"]


def _rebuild(rows: DataFrame, pattern: str, rule, glue: str) -> DataFrame:
    """Apply a list rule to the pieces of ``_j`` where its lower-case form shows a repeat.

    The lower-case pieces are a column of their own: inside a rule's lambda the
    split would run again for every word.
    """
    rows = rows.withColumn("_l", F.lower("_j"))
    rows = rows.withColumn("_b", F.when(F.col("_l").rlike(pattern), F.split("_l", glue)))
    shorter = F.array_join(rule(F.split("_j", glue), F.col("_b")), glue)
    return rows.withColumn("_j", F.when(F.col("_b").isNotNull(), shorter).otherwise(F.col("_j")))


def clean_repetition(utterances: DataFrame) -> DataFrame:
    """Remove runs of three or more equal phrases, words and comma parts.

    White space collapses to single blanks and commas are re-spaced; a text of
    blanks only stays. Only texts in which a pattern finds a repeat are rebuilt
    word by word.
    """
    rows = utterances.withColumn("_w", T.words_of(F.col("text")))
    rows = rows.withColumn("_j", F.array_join("_w", " "))
    rows = _rebuild(rows, T.PHRASE_REPEATS, T.collapse_phrases, " ")
    rows = _rebuild(rows, T.WORD_REPEATS, T.drop_long_runs, " ")
    parts = F.array_join(F.array_remove(F.split("_j", " *, *"), ""), ", ")
    rows = rows.withColumn("_p", F.when(F.col("_j").contains(","), parts).otherwise(F.col("_j")))
    rows = rows.withColumn("_j", F.when(F.col("_p") == "", F.col("_j")).otherwise(F.col("_p")))
    rows = _rebuild(rows, T.PART_REPEATS, T.drop_long_runs, ", ")
    text = F.when(F.size("_w") == 0, F.col("text")).otherwise(F.col("_j"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(c) for c in utterances.columns])


def clean_text(utterances: DataFrame) -> DataFrame:
    rows = clean_repetition(utterances)
    return rows.withColumn("text", T.normalise_turkish(F.col("text")))


def _explode(rows: DataFrame, columns: Sequence[str], pieces: Column, name: str) -> DataFrame:
    keep = [c for c in columns if c not in CONTENT]
    out = rows.select(*keep, F.posexplode(pieces).alias(name, "_p"))
    return out.select(*keep, F.col(name).cast("long").alias(name), "_p.*")


def split_roles(utterances: DataFrame, triggers: Sequence[str], min_offset: int = DEFAULTS.trigger_min_offset) -> DataFrame:
    """Split before the first role trigger; the second part goes to the other speaker.

    Adds ``part``: 0, or 0 and 1. The time is shared by characters.
    """
    speaker, start, end = F.col("speaker_id"), F.col("start_time"), F.col("end_time")
    at = F.col("_at")
    # Column by column, so that no expression is repeated in the generated code.
    rows = utterances.withColumn("_s", T.strip(F.col("text"))).withColumn("_low", F.lower("_s"))
    rows = rows.withColumn("_at", T.trigger_place(F.col("_low"), triggers, min_offset))
    rows = rows.withColumns(
        {
            "_h": F.when(at > 0, T.strip(F.substring("_s", F.lit(1), at - 1))),
            "_t": F.when(at > 0, T.strip(F.substring("_s", at, F.length("_s")))),
        }
    )
    rows = rows.withColumn("_c", start + (end - start) * (F.length("_h") / F.length("_s")))
    rows = rows.withColumn("_c", exact_round(F.col("_c")))
    both = F.array(
        T.piece(speaker, start, F.col("_c"), F.col("_h")),
        T.piece(T.other_speaker(speaker), F.col("_c"), end, F.col("_t")),
    )
    whole = F.array(T.piece(speaker, start, end, F.col("text")))
    pieces = F.when((at > 0) & (F.col("_h") != "") & (F.col("_t") != ""), both).otherwise(whole)
    return _explode(rows, utterances.columns, pieces, "part")


def split_questions(utterances: DataFrame) -> DataFrame:
    """Split after question marks, speakers alternating; adds ``sub``.

    A piece lasts its share of the characters; the last ends with the utterance.
    """
    speaker, start, end = F.col("speaker_id"), F.col("start_time"), F.col("end_time")
    rows = utterances.withColumn("_s", T.strip(F.col("text")))
    rows = rows.withColumn("_q", F.when(F.col("_s").contains("?"), T.question_pieces(F.col("_s"))))
    rows = rows.withColumn("_q", F.when(F.size("_q") > 1, F.col("_q")))
    lengths = F.transform("_q", F.length)
    rows = rows.withColumn("_e", T.piece_ends(lengths, start, end - start, F.greatest(F.length("_s"), F.lit(1))))
    last = F.size("_q") - 1
    pieces = F.transform(
        "_q",
        lambda s, i: T.piece(
            F.when(i % 2 == 0, speaker).otherwise(T.other_speaker(speaker)),
            exact_round(F.get("_e", i)),
            F.when(i == last, end).otherwise(F.get("_e", i + 1)),
            s,
        ),
    )
    whole = F.array(T.piece(speaker, start, end, F.col("text")))
    return _explode(rows, utterances.columns, F.coalesce(pieces, whole), "sub")


def _join_texts(order: str) -> Column:
    """The raw text of a single row, else the stripped texts joined in order."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    joined = F.array_join(F.transform(texts, T.strip), " ")
    return F.when(F.count(F.lit(1)) == 1, F.get(texts, F.lit(0))).otherwise(joined)


def lock_greetings(
    utterances: DataFrame, order: Sequence[str] = ORDER, horizon: float = DEFAULTS.greeting_horizon, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Merge a recording's first utterances when all of them, and no later one
    up to the first start after ``horizon``, contain a greeting."""
    run = blocks.running(
        utterances,
        REC,
        order,
        blocks.block_of(order[0], block_rows),
        sums={"_n": F.lit(1), "_late": F.when(F.col("start_time") > horizon, 1).otherwise(0)},
    ).withColumn("_idx", F.col("_n") - 1)
    run = cut(run, "opening")
    hit = (F.col("_late") == 0) & T.has_any(F.lower("text"), T.GREETINGS)
    merges = (
        run.where(hit)
        .groupBy(*REC)
        .agg(F.count(F.lit(1)).alias("_k"), F.max("_idx").alias("_last"))
        .where((F.col("_k") >= 2) & (F.col("_last") == F.col("_k") - 1))
        .select(*REC, "_k")
    )
    rows = blocks.attach(run, merges, REC, blocks.block_of("_idx", block_rows))
    group = F.when(F.col("_idx") < F.col("_k"), F.lit(0)).otherwise(F.col("_idx"))
    firsts = [c for c in utterances.columns if c not in ("recording_id", "end_time", "text")]
    out = rows.groupBy(*REC, group.alias("_g")).agg(
        *[F.min_by(c, "_idx").alias(c) for c in firsts],
        F.max_by("end_time", "_idx").alias("end_time"),
        _join_texts("_idx").alias("text"),
    )
    return out.select(*utterances.columns)


def merge_short_gaps(
    utterances: DataFrame,
    order: Sequence[str] = ORDER,
    max_silence: float = DEFAULTS.max_silence,
    max_clause_gap: float = DEFAULTS.max_clause_gap,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Join an utterance to its predecessor of the same speaker over a short gap.

    The gap limit is ``max_silence``, or ``max_clause_gap`` when the predecessor
    does not end in punctuation. Blank texts are never joined. ``seq`` numbers
    the results by the place of their first utterance.
    """
    bare = T.strip(F.col("text"))
    rows = utterances.withColumns({"_blank": bare == "", "_open": ~bare.rlike("[.?!:;…]$")})

    def starts(p: Column, c: Column, n: Column) -> Column:
        gap = c["start_time"] - p["end_time"]
        close = (gap <= max_silence) | ((gap <= max_clause_gap) & p["_open"])
        return ~((c["speaker_id"] == p["speaker_id"]) & close & ~c["_blank"] & ~p["_blank"])

    cols = ["speaker_id", "start_time", "end_time", "_blank", "_open"]
    runs = blocks.islands(rows, REC, order, blocks.block_of(order[0], block_rows), cols, starts)
    return runs.groupBy(*REC, F.col("island").alias("seq")).agg(
        F.min_by("speaker_id", "idx").alias("speaker_id"),
        F.min_by("start_time", "idx").alias("start_time"),
        F.max_by("end_time", "idx").alias("end_time"),
        _join_texts("idx").alias("text"),
    )


def refine(utterances: DataFrame, params: Params = DEFAULTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Clean, split, anchor and merge: (recording_id, seq, speaker_id, start_time, end_time, text)."""
    rows = clean_text(utterances.select(*REC, "utt_no", *CONTENT))
    triggers = T.triggers_for(params.domain_mode, params.custom_triggers)
    if triggers:
        rows = split_roles(rows, triggers, params.trigger_min_offset)
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    rows = split_questions(rows) if params.split_on_questions else rows.withColumn("sub", F.lit(0).cast("long"))
    if params.domain_mode == "call_center":
        rows = lock_greetings(rows, ORDER, params.greeting_horizon, block_rows)
    return merge_short_gaps(rows, ORDER, params.max_silence, params.max_clause_gap, block_rows)
