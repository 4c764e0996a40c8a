"""Operational metrics over job, delivery and timing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks

# Upper bounds of the stage-duration histogram, in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, float("inf"))


def bucket_label(bound: float) -> str:
    return "+Inf" if bound == float("inf") else str(bound)


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per status of each named table."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "status", "n")
        out = part if out is None else out.unionByName(part)
    return out


def stage_histogram(stages: DataFrame, buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """Cumulative counts per stage and bound, with the stage's sum and count."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    agg = stages.groupBy("stage").agg(*counts, F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = F.array(
        *[F.struct(F.lit(bucket_label(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(buckets)]
    )
    return agg.select("stage", "total", "n", F.inline(rows))


def fallback_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("from_engine", "to_engine", "reason").agg(F.count(F.lit(1)).alias("n"))


def queue_gauges(groups: DataFrame, messages: DataFrame, jobs: DataFrame, as_of_seconds: Column, as_of: Column) -> DataFrame:
    """One row: queue depth, pending jobs, age of the oldest message (0 for an empty stream).

    Depth is lag plus pending over consumer groups, or the stream length when there are none.
    Message ids start with their epoch milliseconds.
    """
    depth = F.coalesce("lag", F.lit(0)) + F.coalesce("pending", F.lit(0))
    ms = F.split_part("msg_id", F.lit("-"), F.lit(1)).try_cast("bigint")
    waiting = (F.col("status") == "PENDING") & (F.col("updated_at") < as_of)
    parts = [
        groups.agg(F.sum(depth).alias("a"), F.count(F.lit(1)).alias("b")).select(F.lit("group").alias("k"), "a", "b"),
        messages.agg(F.min(ms).alias("a"), F.count(F.lit(1)).alias("b")).select(F.lit("message").alias("k"), "a", "b"),
        jobs.agg(F.count_if(waiting).alias("a")).select(F.lit("job").alias("k"), "a", F.lit(None).cast("bigint").alias("b")),
    ]
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    one = blocks.union_all(parts).agg(
        of("group", "a").alias("depth"),
        of("group", "b").alias("groups"),
        of("message", "b").alias("length"),
        of("message", "a").alias("ms"),
        of("job", "a").alias("pending_jobs"),
    )
    return one.select(
        F.when(F.col("groups") > 0, F.col("depth")).otherwise(F.col("length")).alias("queue_depth"),
        "pending_jobs",
        F.greatest(F.lit(0.0), F.coalesce(as_of_seconds - F.col("ms") / 1000.0, F.lit(0.0))).alias("oldest_age_seconds"),
    )


def real_time_factors(runs: DataFrame, stage_columns: Sequence[str]) -> DataFrame:
    """Per (model, profile) with totals: stage sums, real-time factor and core-seconds per audio-second.

    Reads model, profile, threads, audio_seconds, total_seconds. Groups without audio are left out;
    total rows carry nulls in the grouping columns.
    """
    out = runs.rollup("model", "profile").agg(
        F.sum("audio_seconds").alias("audio_seconds"),
        *[F.sum(c).alias(c) for c in stage_columns],
        F.sum("total_seconds").alias("total_seconds"),
        F.sum(F.col("total_seconds") * F.col("threads")).alias("_core"),
        F.grouping_id().alias("level"),
    )
    return out.where("audio_seconds > 0").select(
        "model",
        "profile",
        "level",
        "audio_seconds",
        *stage_columns,
        "total_seconds",
        (F.col("total_seconds") / F.col("audio_seconds")).alias("rtf"),
        (F.col("_core") / F.col("audio_seconds")).alias("k"),
    )


def capacity_plan(
    factors: DataFrame,
    messages: int,
    message_seconds: Sequence[int],
    workers: Sequence[int],
    target_seconds: float,
    gb_per_worker: float = 1.5,
) -> DataFrame:
    """Cores, hours and memory per factor row over a grid of message lengths and worker counts."""
    grid = [(s, w) for s in message_seconds for w in workers]
    cells = F.array(*[F.struct(F.lit(s).alias("message_seconds"), F.lit(w).alias("workers")) for s, w in grid])
    audio = F.col("message_seconds") * messages
    return factors.select("*", F.inline(cells)).select(
        *[c for c in factors.columns if c not in ("message_seconds", "workers")],
        "message_seconds",
        "workers",
        audio.alias("total_audio"),
        (audio * F.col("k") / target_seconds).alias("cores_needed"),
        (audio * F.col("rtf") / F.col("workers") / 3600.0).alias("hours"),
        (F.col("workers") * gb_per_worker).alias("ram_gb"),
    )
