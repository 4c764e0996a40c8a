"""Signal operators over sample tables (recording_id, pos, value, sample_rate).

``pos`` is dense from 0. Frames and windows are groups of sample numbers, so
the work splits by (recording, frame) however long a recording is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.numbers import exact_round
from voxloom.operators import blocks
from voxloom.params import DEFAULTS
from voxloom.session import cut

REC = ["recording_id"]
FRAME_BLOCK = 4096


def downmix(samples: DataFrame) -> DataFrame:
    """Mean over channels."""
    return samples.groupBy(*REC, "pos", "sample_rate").agg(F.avg("value").alias("value"))


def linear_resample(samples: DataFrame, target_rate: int = 16000, block_rows: int = 65536) -> DataFrame:
    """Linear interpolation to ``target_rate``; each input sample makes the outputs that fall on it."""
    run = blocks.running(
        samples.select(*REC, "pos", "value", "sample_rate"),
        REC,
        ["pos"],
        blocks.block_of("pos", block_rows),
        nexts={"_next": F.col("value")},
        total_maxes={"_last": F.col("pos")},
    )
    ratio = F.col("sample_rate").cast("double") / float(target_rate)
    new_len = F.floor((F.col("_last") + 1) / ratio)
    lo = F.greatest(F.lit(0), F.floor(F.col("pos") / ratio) - 1)
    hi = F.ceil((F.col("pos") + 1) / ratio) + 1
    out = run.withColumn("_i", F.explode(F.sequence(lo, hi)))
    at = F.col("_i") * ratio
    frac = at - F.col("pos")
    value = F.when(F.col("_next").isNull(), F.col("value")).otherwise(
        F.col("value") * (1.0 - frac) + F.col("_next") * frac
    )
    mine = (F.floor(at) == F.col("pos")) & (F.col("_i") < new_len)
    resampled = out.where(mine).select(*REC, F.col("_i").alias("pos"), value.alias("value"))
    return resampled.withColumn("sample_rate", F.lit(target_rate))


def _frame_sums(samples: DataFrame, size: Column) -> DataFrame:
    """One row per frame, also for a cut-off last one: sum of squares and sample count."""
    return samples.groupBy(
        *REC, F.floor(F.col("pos") / size).alias("frame"), size.cast("long").alias("_size"), "sample_rate"
    ).agg(F.sum(F.col("value") * F.col("value")).alias("_e"), F.count(F.lit(1)).alias("_n"))


def _whole_frames(sums: DataFrame) -> DataFrame:
    energy = F.col("_e") / F.col("_size")
    return sums.where(F.col("_n") == F.col("_size")).select(
        *REC, "frame", energy.alias("energy"), F.sqrt(energy).alias("rms")
    )


def frame_energy(samples: DataFrame, frame_size: Column | int, threshold: float = 0.02) -> DataFrame:
    """Whole non-overlapping frames: mean square, RMS and ``loud`` (RMS at or above the threshold)."""
    n = F.lit(frame_size) if isinstance(frame_size, int) else frame_size
    return _whole_frames(_frame_sums(samples, n)).withColumn("loud", F.col("rms") >= threshold)


def seconds_to_samples(seconds: float) -> Column:
    return F.floor(F.lit(seconds) * F.col("sample_rate")).cast("long")


def sliding_energy(samples: DataFrame, window: int, step: int) -> DataFrame:
    """RMS of overlapping whole windows, from partial sums of non-overlapping panes."""
    pane = math.gcd(window, step)
    panes = samples.groupBy(*REC, F.floor(F.col("pos") / pane).alias("_p")).agg(
        F.sum(F.col("value") * F.col("value")).alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    begin = F.col("_p") * pane
    first = F.greatest(F.lit(0), F.ceil((begin - window + pane) / step))
    last = F.floor(begin / step)
    spread = panes.where(first <= last).withColumn("win_idx", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    wins = spread.groupBy(*REC, "win_idx").agg(F.sum("_e").alias("_e"), F.sum("_n").alias("_n"))
    return wins.where(F.col("_n") == window).select(*REC, "win_idx", F.sqrt(F.col("_e") / window).alias("energy"))


def snr_db(samples: DataFrame) -> DataFrame:
    """Signal-to-noise estimate per recording: loudest 30 % of 20 ms frames over the quietest 20 %."""
    # Samples are read once; everything else works on the frame table.
    sums = cut(_frame_sums(samples, seconds_to_samples(0.02)), "frames")
    size = sums.select(*REC).distinct()
    frames = _whole_frames(sums)
    top = lambda n: F.greatest(F.lit(1), F.floor(F.lit(0.3) * n))
    low = lambda n: F.greatest(F.lit(1), F.floor(F.lit(0.2) * n))
    at = blocks.select_ranks(frames, REC, "energy", {"loud": lambda n: n - top(n), "quiet": lambda n: low(n) - 1})
    n = F.col("n")
    stats = at.select(
        *REC, ((F.col("sum") - F.col("loud_below")) / top(n)).alias("_sig"), ((F.col("quiet_below") + F.col("quiet")) / low(n)).alias("_noise")
    )
    value = (
        F.when(F.col("_sig").isNull(), 30.0)
        .when(F.col("_noise") <= 1e-10, 40.0)
        .otherwise(10.0 * F.log10(F.greatest(F.col("_sig") / F.col("_noise"), F.lit(1e-5))))
    )
    return size.join(stats, "recording_id", "left").select(*REC, value.alias("snr_db"))


def denoise_gate(
    snr: DataFrame, enabled: bool = True, profile: str = DEFAULTS.profile, min_snr_db: float = DEFAULTS.min_snr_db
) -> DataFrame:
    """Adds ``denoise``: always outside the feedback profile, else only below the SNR limit (or when unmeasured)."""
    if not enabled:
        return snr.withColumn("denoise", F.lit(False))
    if profile != "feedback":
        return snr.withColumn("denoise", F.lit(True))
    return snr.withColumn("denoise", F.coalesce(F.col("snr_db") < min_snr_db, F.lit(True)))


def energy_thresholds(energies: DataFrame, value: str = "energy") -> DataFrame:
    """Speech, silence-skip and hold thresholds from interpolated percentiles of a recording's energies."""
    p = blocks.percentiles(energies, REC, value, {"p30": 0.30, "p05": 0.05, "p20": 0.20})
    return p.select(
        *REC,
        F.greatest(F.lit(1e-4), F.col("p30") * 1.5).alias("speech"),
        F.greatest(F.lit(1e-5), F.col("p05")).alias("skip"),
        F.col("p20").alias("hold"),
    )


def energy_vad(samples: DataFrame, min_silence_ms: int = 400, frame_ms: int = 30) -> DataFrame:
    """Speech intervals from frame energy.

    Speech frames less than ``min_silence_ms // frame_ms`` silent frames apart
    share an interval; it ends where its last speech frame starts, except that
    an interval still open at the end runs to the end of the recording.
    Recordings without any interval count as speech throughout.
    """
    n = F.floor(F.col("sample_rate") * frame_ms / 1000).cast("long")
    sums = cut(_frame_sums(samples, n), "frames")
    size = sums.groupBy(*REC).agg((F.sum("_n") / F.max("sample_rate")).alias("_dur"))
    frames = _whole_frames(sums).select(*REC, "frame", "rms")
    hush = max(1, min_silence_ms // frame_ms)
    limits = energy_thresholds(frames, "rms").select(*REC, "speech")
    counts = frames.groupBy(*REC).agg(F.count(F.lit(1)).alias("_frames"))
    facts = cut(limits.join(counts, "recording_id").join(size, "recording_id"), "facts")
    block = blocks.block_of("frame", FRAME_BLOCK)
    speech = blocks.attach(frames, facts, REC, block).where(F.col("rms") > F.col("speech"))
    runs = blocks.islands(
        speech.select(*REC, "frame", "_frames", "_dur"),
        REC,
        ["frame"],
        block,
        ["frame"],
        lambda p, c, n: c["frame"] - p["frame"] > hush,
    )
    chunks = runs.groupBy(*REC, "island").agg(
        F.min("frame").alias("_a"), F.max("frame").alias("_b"), F.max("_frames").alias("_frames"), F.max("_dur").alias("_dur")
    )
    still_open = F.col("_frames") - 1 - F.col("_b") < hush
    at = lambda c: exact_round(F.col(c) * frame_ms / 1000.0)
    found = chunks.select(
        *REC, at("_a").alias("start_time"), F.when(still_open, exact_round(F.col("_dur"))).otherwise(at("_b")).alias("end_time"), still_open.alias("_o")
    ).where(F.col("_o") | (F.col("end_time") > F.col("start_time")))
    found = cut(found.select(*REC, "start_time", "end_time"), "intervals")
    none = size.join(found.select(*REC).distinct(), "recording_id", "left_anti")
    whole = none.select(*REC, F.lit(0.0).alias("start_time"), exact_round(F.col("_dur")).alias("end_time"))
    return found.unionByName(whole)
