"""Speaker segments from window embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks, cluster, diarise, signal
from voxloom.params import BLOCK_ROWS, DEFAULTS, FIRST_SPEAKER, Params
from voxloom.session import cut

REC = ["recording_id"]


def _whole(durations: DataFrame, windows: DataFrame) -> DataFrame:
    """Recordings too short for a window: one segment, one speaker."""
    none = durations.join(windows.select(*REC).distinct(), "recording_id", "left_anti")
    return none.select(
        *REC,
        F.lit(0).cast("long").alias("seg_no"),
        F.lit(FIRST_SPEAKER).alias("speaker_id"),
        F.lit(0.0).alias("start_time"),
        F.col("duration_seconds").alias("end_time"),
    )


def diarise_windows(
    windows: DataFrame,
    durations: DataFrame,
    n_speakers: int | None = None,
    params: Params = DEFAULTS,
    max_rows: int = cluster.MAX_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Windows (recording_id, win_idx, embedding, energy) to segments.

    The quietest windows are not clustered; they take a neighbour's label.
    """
    limits = cut(signal.energy_thresholds(windows).select(*REC, "skip"), "limits")
    rows = blocks.attach(windows, limits, REC, blocks.block_of("win_idx", block_rows))
    loud = rows.where(F.col("energy") >= F.col("skip"))
    labels = cluster.cluster_average_linkage(
        loud, n_speakers, params.distance_threshold, params.max_speakers, max_rows
    ).withColumnRenamed("label", "raw_label")
    labelled = cut(windows.select(*REC, "win_idx").join(labels, [*REC, "win_idx"], "left"), "labels")
    smooth = diarise.smooth_labels(cut(diarise.fill_labels(labelled, block_rows=block_rows), "filled"), block_rows=block_rows)
    segments = diarise.labels_to_segments(
        cut(smooth, "smooth"), durations, params.step_seconds, params.window_seconds / 2, block_rows=block_rows
    )
    return segments.unionByName(_whole(durations, windows))


def diarise_spectral(
    windows: DataFrame,
    durations: DataFrame,
    step_seconds: float = 0.25,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Two speakers from standardised features; speakers change only around quiet windows."""
    z = diarise.standardise(windows, block_rows)
    labels = cluster.cluster_bisect(z, block_rows=block_rows).withColumnRenamed("label", "raw_label")
    rows = cut(windows.select(*REC, "win_idx", "energy").join(labels, [*REC, "win_idx"]), "labels")
    gated = diarise.gate_transitions(rows, signal.energy_thresholds(rows), block_rows=block_rows)
    final = diarise.median_filter(cut(gated, "gated").select(*REC, "win_idx", "label"), block_rows=block_rows)
    segments = diarise.labels_to_segments(cut(final, "median"), durations, step_seconds, 0.0, block_rows=block_rows)
    return segments.unionByName(_whole(durations, windows))
