"""Public entry points over many recordings at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks, intervals, jobs, metrics, refine, utterances
from voxloom.operators import signal as sig
from voxloom.params import BLOCK_ROWS, DEFAULTS, FIRST_SPEAKER, Params
from voxloom.session import cut
from voxloom.sources import contracts


def diarise_gate(
    recordings: DataFrame,
    profile: str = DEFAULTS.profile,
    min_seconds: float = DEFAULTS.min_diarise_seconds,
) -> DataFrame:
    """Adds ``gate``: single, short or diarise, from num_speakers and duration_seconds."""
    short = F.lit(profile == "feedback") & (F.coalesce("duration_seconds", F.lit(0.0)) < min_seconds)
    return recordings.withColumn(
        "gate", F.when(F.col("num_speakers") == 1, "single").when(short, "short").otherwise("diarise")
    )


def single_speaker_segments(gated: DataFrame, unbounded: float = DEFAULTS.unbounded_duration) -> DataFrame:
    """One segment over the whole recording where a single speaker is announced."""
    end = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")).otherwise(unbounded)
    return gated.where("gate = 'single'").select(
        "recording_id",
        F.lit(0).cast("long").alias("seg_no"),
        F.lit(FIRST_SPEAKER).alias("speaker_id"),
        F.lit(0.0).alias("start_time"),
        end.alias("end_time"),
    )


class Analysis:
    """Utterances, and per recording the gate, duration and overlap totals; the pairs behind them.

    Each result is planned when it is first asked for: summaries alone neither attribute words nor write anything.
    """

    def __init__(
        self, gated: DataFrame, heard: DataFrame, used: DataFrame, filtered: bool, params: Params, block_rows: int
    ) -> None:
        self._gated, self._heard, self._used, self._filtered = gated, heard, used, filtered
        self._params, self._block_rows = params, block_rows

    @cached_property
    def utterances(self) -> DataFrame:
        heard = cut(self._heard, "heard") if self._filtered else self._heard
        fused = utterances.fuse(heard, self._used, self._params.max_silence, self._block_rows)
        return refine.refine(fused.withColumnRenamed("utt_key", "utt_no"), self._params, self._block_rows)

    @cached_property
    def summaries(self) -> DataFrame:
        timed = intervals.effective_duration(self._gated, self._heard, self._used)
        return intervals.overlap_summary(timed, intervals.overlap_totals(self._used, self._params.overlap_floor))

    @cached_property
    def pairs(self) -> DataFrame:
        return intervals.overlap_pairs(self._used, self._params.overlap_floor)


def analyse(
    recordings: DataFrame,
    words: DataFrame,
    segments: DataFrame,
    speech: DataFrame | None = None,
    params: Params = DEFAULTS,
    block_rows: int = BLOCK_ROWS,
) -> Analysis:
    """Model outputs to refined, speaker-attributed utterances and overlap summaries."""
    contracts.check_schema(words, contracts.WORDS)
    contracts.check_schema(segments, contracts.SEGMENTS)
    gated = diarise_gate(recordings, params.profile, params.min_diarise_seconds)
    cols = ["recording_id", "seg_no", "speaker_id", "start_time", "end_time"]
    real = blocks.attach(
        segments.select(*cols),
        gated.where("gate = 'diarise'"),
        ["recording_id"],
        blocks.block_of("seg_no", block_rows),
        "left_semi",
    )
    used = real.unionByName(single_speaker_segments(gated, params.unbounded_duration))
    heard = words.select("recording_id", "pos", "word", "start_time", "end_time")
    if speech is not None:
        heard = intervals.vad_filter(heard, speech, params.vad_tolerance, block_rows=block_rows)
    return Analysis(gated, heard, used, speech is not None, params, block_rows)


@dataclass(frozen=True)
class Signal:
    mono: DataFrame
    vad: DataFrame
    snr: DataFrame


def signal(samples: DataFrame, target_rate: int = 16000, params: Params = DEFAULTS) -> Signal:
    """Mix down, resample, measure noise, find speech."""
    mono = cut(sig.linear_resample(sig.downmix(samples), target_rate), "mono")
    snr = sig.denoise_gate(sig.snr_db(mono), True, params.profile, params.min_snr_db)
    return Signal(mono, sig.energy_vad(mono), snr)


@dataclass(frozen=True)
class Operations:
    repairs: DataFrame
    manifest: DataFrame
    expired: DataFrame
    deliveries: DataFrame
    counts: DataFrame
    kept: tuple[DataFrame, DataFrame, DataFrame] | None = None
    gauges: DataFrame | None = None
    histogram: DataFrame | None = None
    fallbacks: DataFrame | None = None


@dataclass(frozen=True)
class Queue:
    """State of the queue: consumer groups (lag, pending), messages (msg_id), the time in epoch seconds."""

    groups: DataFrame
    messages: DataFrame
    as_of_seconds: Column


def operate(
    job_table: DataFrame,
    deliveries: DataFrame,
    as_of: Column,
    url_safe: Column,
    params: Params = DEFAULTS,
    utterances: DataFrame | None = None,
    stages: DataFrame | None = None,
    skips: DataFrame | None = None,
    queue: Queue | None = None,
) -> Operations:
    """Housekeeping on one snapshot: repair stale jobs, list expired data, settle due deliveries, count everything.

    With ``utterances`` the expired records are removed with all that depends on them (``kept``: jobs, utterances,
    deliveries). ``stages`` (stage, seconds) give the duration histogram, ``skips`` the engine fallbacks, ``queue`` the
    gauges; each is also counted in ``counts`` (what, item, n).
    """
    repairs = jobs.sweep(job_table, as_of, None, params)
    manifest, expired = jobs.retention(
        job_table, as_of, params.audio_retention_hours, params.result_retention_days
    )
    due = deliveries.where((F.col("status") == "PENDING") & (F.col("next_attempt_at") <= as_of))
    if "outcome_text" not in due.columns:
        due = due.withColumn("outcome_text", F.lit(None).cast("string"))
    settled = jobs.delivery_step(due, as_of, url_safe, params.webhook_max_attempts)
    count = lambda df, what, by: df.groupBy(by.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(what).alias("what"), "item", "n"
    )
    named = lambda df, what, item, n: df.select(F.lit(what).alias("what"), item.alias("item"), F.col(n).cast("long").alias("n"))
    counts = [
        count(repairs, "repair", F.col("action")),
        count(manifest, "manifest", F.col("reason")),
        count(settled, "delivery", F.col("status")),
        metrics.status_counts({"jobs": job_table, "deliveries": deliveries}).select(
            F.col("tbl").alias("what"), F.col("status").alias("item"), "n"
        ),
    ]
    kept = gauges = histogram = fallbacks = None
    if utterances is not None:
        by_time = F.coalesce(blocks.block_of("start_time", 600.0), F.lit(-1).cast("long"))
        kept = jobs.cascade_delete(job_table, utterances, deliveries, expired, by_time, jobs.salt("delivery_id"))
        counts += [count(df, "kept", F.lit(name)) for df, name in zip(kept, ("jobs", "utterances", "deliveries"))]
    if stages is not None:
        histogram = metrics.stage_histogram(stages)
        counts.append(named(histogram, "stage", F.concat_ws(" ", "stage", "le"), "cumulative"))
    if skips is not None:
        fallbacks = metrics.fallback_counts(skips)
        counts.append(named(fallbacks, "fallback", F.concat_ws(" ", "from_engine", "to_engine", "reason"), "n"))
    if queue is not None:
        gauges = metrics.queue_gauges(queue.groups, queue.messages, job_table, queue.as_of_seconds, as_of)
        rows = F.array(*[F.struct(F.lit(g).alias("item"), F.col(g).cast("long").alias("n")) for g in gauges.columns])
        counts.append(named(gauges.select(F.inline(rows)), "gauge", F.col("item"), "n"))
    return Operations(repairs, manifest, expired, settled, blocks.union_all(counts), kept, gauges, histogram, fallbacks)
