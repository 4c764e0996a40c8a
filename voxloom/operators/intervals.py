"""Interval joins. Times are cut into bins so that every join has an equi-key
(recording, bin) that also splits long recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.numbers import exact_round
from voxloom.operators import blocks
from voxloom.params import BIN_SECONDS, BLOCK_ROWS, DEFAULTS, UNKNOWN_SPEAKER

BIN = "_bin"
NEAR_SECONDS = 1e-6
STEPS = 2.0**56  # a second, in sums of times by their binary values


def midpoint() -> Column:
    return (F.col("start_time") + F.col("end_time")) / 2.0


def word_times(words: DataFrame) -> DataFrame:
    """Adds midpoint and duration."""
    return words.withColumns({"midpoint": midpoint(), "duration": F.col("end_time") - F.col("start_time")})


def contains_timestamp(at: Column, start: Column, end: Column) -> Column:
    """Closed on both ends."""
    return at.between(start, end)


def bins(start: Column, end: Column, width: float) -> Column:
    """One row per bin; a row without times keeps a row, in no bin."""
    lo, hi = F.floor(start / width), F.floor(end / width)
    return F.explode_outer(F.sequence(lo, F.greatest(lo, hi)))


def attribute_words(
    words: DataFrame, segments: DataFrame, bin_seconds: float = BIN_SECONDS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Speaker of every word: first segment (list order) around the midpoint,
    else the one with the largest overlap (ties: earliest), else unknown.

    Adds ``speaker_id``, ``at_midpoint`` and ``by_overlap`` (nullable parts of it).
    """
    # A word and a segment that touch share a bin; a pair seen in two bins is harmless to min and max.
    w = words.withColumn(BIN, bins(F.col("start_time"), F.col("end_time"), bin_seconds))
    s = segments.select(
        F.col("recording_id").alias("_r"),
        F.struct("seg_no", "speaker_id", "start_time", "end_time").alias("_s"),
        bins(F.col("start_time"), F.col("end_time"), bin_seconds).alias("_b"),
    )
    on = (
        (F.col("recording_id") == F.col("_r"))
        & (F.col(BIN) == F.col("_b"))
        & (F.col("_s.start_time") <= F.col("end_time"))
        & (F.col("_s.end_time") >= F.col("start_time"))
    )
    shared = F.least("end_time", F.col("_s.end_time")) - F.greatest("start_time", F.col("_s.start_time"))
    inside = contains_timestamp(midpoint(), F.col("_s.start_time"), F.col("_s.end_time"))
    hits = (
        w.join(s, on, "left")
        .withColumns(
            {
                "_mid": F.when(inside, F.struct("_s.seg_no", "_s.speaker_id")),
                "_ovl": F.when(shared > 0, F.struct(shared.alias("len"), -F.col("_s.seg_no"), "_s.speaker_id")),
                blocks.BLK: blocks.block_of("pos", block_rows),
            }
        )
        .drop("_r", "_s", "_b", BIN)
        # The same partitioning serves the ordered operators that follow.
        .repartition("recording_id", blocks.BLK)
    )
    keys = ["recording_id", blocks.BLK, "pos"]
    out = hits.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in words.columns if c not in keys],
        F.min("_mid")["speaker_id"].alias("at_midpoint"),
        F.max("_ovl")["speaker_id"].alias("by_overlap"),
    )
    return out.withColumn(
        "speaker_id", F.coalesce("at_midpoint", "by_overlap", F.lit(UNKNOWN_SPEAKER))
    ).drop(blocks.BLK)


def vad_filter(
    words: DataFrame,
    speech: DataFrame,
    tolerance: float = DEFAULTS.vad_tolerance,
    bin_seconds: float = BIN_SECONDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Keep words whose midpoint lies within ``tolerance`` of a speech interval;
    recordings without intervals keep every word."""
    covered = speech.select("recording_id").distinct().withColumn("_has", F.lit(True))
    flagged = blocks.attach(words, covered, ["recording_id"], blocks.block_of("pos", block_rows))
    lo, hi = F.col("start_time") - tolerance, F.col("end_time") + tolerance
    near = speech.select(
        F.col("recording_id").alias("_r"), lo.alias("_lo"), hi.alias("_hi"), bins(lo, hi, bin_seconds).alias("_b")
    ).alias("iv")
    w = flagged.withColumns({"_mid": midpoint(), BIN: F.floor(midpoint() / bin_seconds)}).alias("w")
    inside = near.where(
        (F.col("iv._r") == F.col("w.recording_id").outer())
        & (F.col("iv._b") == F.col(f"w.{BIN}").outer())
        & F.col("w._mid").outer().between(F.col("iv._lo"), F.col("iv._hi"))
    ).exists()
    return w.where(F.col("_has").isNull() | inside).select(*words.columns)


def overlap_pairs(
    segments: DataFrame, floor_seconds: float = DEFAULTS.overlap_floor, bin_seconds: float = BIN_SECONDS
) -> DataFrame:
    """Pairs of segments of different speakers that overlap by more than the floor.

    ``overlap_seconds`` is unrounded; start, end and duration are rounded.
    Pairs come out in (start_i, start_j) order of ``i_start, i_seg, j_start, j_seg``.
    """
    cols = ["seg_no", "speaker_id", "start_time", "end_time"]
    i = segments.select(
        "recording_id", F.struct(*cols).alias("i"), bins(F.col("start_time"), F.col("end_time"), bin_seconds).alias(BIN)
    )
    # The later segment sits only in the bin where it starts, so a pair is found once.
    j = segments.select("recording_id", F.struct(*cols).alias("j"), F.floor(F.col("start_time") / bin_seconds).alias(BIN))
    later = (F.col("i.start_time") < F.col("j.start_time")) | (
        (F.col("i.start_time") == F.col("j.start_time")) & (F.col("i.seg_no") < F.col("j.seg_no"))
    )
    pairs = i.join(j, ["recording_id", BIN]).where(
        later & (F.col("j.start_time") < F.col("i.end_time")) & (F.col("i.speaker_id") != F.col("j.speaker_id"))
    )
    lo = F.greatest("i.start_time", "j.start_time")
    hi = F.least("i.end_time", "j.end_time")
    return pairs.where(hi - lo > floor_seconds).select(
        "recording_id",
        F.col("i.start_time").alias("i_start"),
        F.col("i.seg_no").alias("i_seg"),
        F.col("j.start_time").alias("j_start"),
        F.col("j.seg_no").alias("j_seg"),
        F.array_sort(F.array("i.speaker_id", "j.speaker_id")).alias("speakers"),
        exact_round(lo).alias("start_time"),
        exact_round(hi).alias("end_time"),
        exact_round(hi - lo).alias("duration"),
        (hi - lo).alias("overlap_seconds"),
    )


def effective_duration(recordings: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """Given duration if positive, else the last word's end, else the last segment's end."""
    w = words.groupBy("recording_id").agg(F.max("end_time").alias("_w"))
    s = segments.groupBy("recording_id").agg(F.max("end_time").alias("_s"))
    given = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    return (
        recordings.join(w, "recording_id", "left")
        .join(s, "recording_id", "left")
        .withColumn("effective_duration", F.coalesce(given, "_w", "_s", F.lit(0.0)))
        .drop("_w", "_s")
    )


def overlap_totals(
    segments: DataFrame, floor_seconds: float = DEFAULTS.overlap_floor, bin_seconds: float = BIN_SECONDS
) -> DataFrame:
    """Number of pairs that ``overlap_pairs`` would list and their summed seconds, per recording, without the pairs.

    A pair overlaps by more than the floor just when both of its segments, shortened by the floor at their ends, still
    overlap. A sweep over the starts and shortened ends keeps the number k of running segments: a start meets the k that
    run before it and takes its time off for each, an end gives its time for each pair it ends. Pairs of one speaker are
    counted by the same sweep per speaker and taken off. Rows are linear in the segments, however many of them overlap.
    Sums are of the binary values of the times (to 2 ** -56 seconds, up to 9e9) as whole numbers, so one pair's total is the
    double ``end - start`` and not that of its decimal digits, which may lie on the other side of a rounding limit.

    Subtracting the floor from an end may round differently than the pair's own test; distinct starts and shortened ends
    that lie within a millionth of a second are compared singly and the counts corrected.
    """
    floor = F.lit(float(floor_seconds))
    s, e = F.col("start_time"), F.col("end_time")
    # Everyone's sweep and the speaker's own; segments of at most the floor and rows without a speaker are in no pair.
    groups = F.array(
        F.struct(F.lit(1).alias("sign"), F.lit("").alias("who")),
        F.struct(F.lit(-1).alias("sign"), F.col("speaker_id").cast("string").alias("who")),
    )
    long = segments.where(F.col("recording_id").isNotNull() & F.col("speaker_id").isNotNull() & (e - s > floor)).select(
        "recording_id", s.alias("_s"), e.alias("_e"), F.greatest(e - floor, s).alias("_g"), F.inline(groups)
    )
    keys = ["recording_id", "sign", "who"]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    events = F.array(
        F.struct(F.col("_s").alias("at"), one.alias("starts"), none.alias("ends"), F.lit(None).cast("double").alias("end")),
        F.struct(F.col("_g").alias("at"), none.alias("starts"), one.alias("ends"), F.col("_e").cast("double").alias("end")),
    )
    points = (
        long.select(*keys, F.inline(events))
        .groupBy(*keys, "at")
        .agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.max("end").alias("end"))
    )
    swept = blocks.running(
        points,
        keys,
        ["at"],
        blocks.block_of("at", bin_seconds),
        sums={"k": F.col("starts") - F.col("ends")},
    )
    k, new = F.col("k"), F.col("starts")
    met = new * (k - new) + F.shiftright(new * (new - 1), 1)
    was = k - new + F.col("ends")
    gone_pairs = F.shiftright(was * (was - 1) - (k - new) * (k - new - 1), 1)
    times = lambda part, n: part.cast("decimal(18,0)") * n.cast("decimal(18,0)")

    def shared(end: Column, n_end: Column, start: Column, n_start: Column) -> list[Column]:
        """Whole seconds, and the rest in steps of 1 / STEPS, of ``n_end`` times ``end`` less ``n_start`` times ``start``."""
        bound = lambda c: F.greatest(F.least(c.cast("double"), F.lit(9e9)), F.lit(-9e9))
        whole = lambda c: F.floor(bound(c)).cast("long")
        rest = lambda c: ((bound(c) - F.floor(bound(c))) * F.lit(STEPS)).cast("long")
        return [
            F.coalesce(times(part(end), F.col("sign") * n_end), F.lit(0).cast("decimal(37,0)"))
            - times(part(start), F.col("sign") * n_start)
            for part in (whole, rest)
        ]

    width = F.lit(NEAR_SECONDS)
    gone = long.groupBy(*keys, "_e", "_g").agg(F.count(F.lit(1)).alias("_ng")).withColumn("_near", F.floor(F.col("_g") / width))
    begun = long.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_ns"))
    cell = F.floor(F.col("_s") / width)
    begun = begun.withColumn("_near", F.explode(F.sequence(cell - 1, cell + 1)))
    swept_off, really_off = F.col("_g") <= F.col("_s"), F.col("_e") - F.col("_s") <= floor
    wrong = gone.join(begun, [*keys, "_near"]).where(swept_off != really_off)
    amend = F.col("_ng") * F.col("_ns") * F.when(swept_off, 1).otherwise(-1)
    whole, rest = shared(F.col("end"), gone_pairs, F.col("at"), met)
    more, bits = shared(F.col("_e"), amend, F.col("_s"), amend)
    parts = swept.select("recording_id", (F.col("sign") * met).alias("_n"), whole.alias("_w"), rest.alias("_r")).unionByName(
        wrong.select("recording_id", (F.col("sign") * amend).alias("_n"), more.alias("_w"), bits.alias("_r"))
    )
    sums = parts.groupBy("recording_id").agg(F.sum("_n").alias("pairs"), F.sum("_w").alias("_w"), F.sum("_r").alias("_r"))
    # Both parts in steps, in one number before it becomes a double.
    steps = F.col("_w").cast("decimal(20,0)") * F.lit(int(STEPS)).cast("decimal(17,0)") + F.col("_r")
    return sums.where("pairs > 0").select("recording_id", "pairs", (steps.cast("double") / F.lit(STEPS)).alias("overlap_seconds"))


def overlap_summary(recordings: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals per recording; ``recordings`` needs ``effective_duration``, ``totals`` come from ``overlap_totals``.

    Fewer than two segments give zeros. The percentage uses the unrounded total.
    """
    sums = totals.select("recording_id", F.col("overlap_seconds").alias("_t"), F.col("pairs").cast("int").alias("_c"))
    total = F.coalesce("_t", F.lit(0.0))
    share = F.when(F.col("effective_duration") > 0, exact_round(total / F.col("effective_duration") * 100))
    return recordings.join(sums, "recording_id", "left").select(
        *recordings.columns,
        F.lit(False).alias("supported"),
        exact_round(total).alias("total_overlap_seconds"),
        F.coalesce(share, F.lit(0.0)).alias("overlap_percentage"),
        F.coalesce("_c", F.lit(0)).alias("interrupt_count"),
    )


def overlap_pages(pairs: DataFrame, page_rows: int = 1000, bin_seconds: float = BIN_SECONDS) -> DataFrame:
    """The pair list of each recording as arrays of bounded size."""
    item = F.struct("speakers", "start_time", "end_time", "duration")
    return blocks.nest_pages(
        pairs,
        ["recording_id"],
        ["i_start", "i_seg", "j_start", "j_seg"],
        blocks.block_of("i_start", bin_seconds),
        item,
        page_rows,
        "overlaps",
    )
