"""Structured Streaming forms of the queue and job operators.

Progress lives in the checkpoint, so a restarted query continues where it
stopped; sinks write each micro-batch to a folder of its own and replace that
folder when a batch is run again, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxloom.functions import guards
from voxloom.operators import jobs
from voxloom.params import DEFAULTS
from voxloom.session import cut, shared_dir
from voxloom.streaming.states import job_states  # noqa: F401

SALTS = 32
STORES_PER_CORE = 2
#: A batch writes its changes to the state, not the state's files; the two sides of a join share one store per partition.
STATE = {
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Files of one table in a folder as a stream; Kafka or another source gives the same columns."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def queue_entries(raw: DataFrame) -> DataFrame:
    """Typed queue entries: empty strings are nulls. Ids are strings of any form."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.select(
        blank("job_id").alias("job_id"),
        blank("file_name").alias("file_name"),
        blank("callback_url").alias("callback_url"),
        blank("num_speakers").try_cast("int").alias("num_speakers"),
    )


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
    trigger: str = "10 seconds",
) -> StreamingQuery:
    """Start the query. It has at most ``STORES_PER_CORE`` state partitions per core, as each costs a load and a commit in
    every batch whatever it holds; a checkpoint keeps the number and the form of the state that it began with."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    spark = stream.sparkSession
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STORES_PER_CORE * spark.sparkContext.defaultParallelism)
    settings = STATE | {"spark.sql.shuffle.partitions": str(stores)}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:  # the query copies the session's settings when it starts
        for key, value in settings.items():
            spark.conf.set(key, value)
        return writer.start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def batch_folder(out: str) -> Callable[[DataFrame, int], None]:
    """Sink: one folder per micro-batch, replaced when the batch is repeated."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return handle


def run_to_table(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Process what is available and return the written batches (with their ``batch`` number)."""
    out = shared_dir(spark, name)
    query = start(stream, batch_folder(out), shared_dir(spark, f"{name}-progress"), mode)
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Last written version of each key of an update-mode stream."""
    values = [c for c in batches.columns if c not in (*keys, "batch")]
    pick = [F.max_by(c, "batch").alias(c) for c in values]
    return batches.groupBy(*keys).agg(*pick)


def process_jobs(
    entries: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Run ``work`` once per job id, however often and in however many batches the queue delivers it.

    A batch writes its output, then its ids to the ledger (``out`` with "-ids" appended). A later batch leaves out the ids
    of the other batches in the ledger; a crash before a batch is committed, also between the two writes, redelivers it, and
    what it had written is replaced. Entries without an id can't be handled; they go to the dead letters, ``out`` with
    "-dead" appended. The ledger is scanned for the ids of the batch, never sorted or collected.
    """
    ledger, kind = f"{out}-ids", entries.schema["job_id"].dataType.simpleString()

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.where(F.col("job_id").isNull()).write.mode("overwrite").parquet(f"{out}-dead/batch={batch_id}")
        once = batch.where(F.col("job_id").isNotNull()).dropDuplicates(["job_id"])
        # Makes the folder known to the reader; a repeated batch starts without its own ids.
        spark.createDataFrame([], f"job_id {kind}").write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
        known = spark.read.schema(f"job_id {kind}, batch bigint").option("basePath", ledger).parquet(ledger).where(F.col("batch") != batch_id)
        seen = known.select("job_id").join(once.select("job_id"), "job_id", "left_semi").distinct()
        fresh = once.join(seen, "job_id", "left_anti")
        ids = cut(fresh.select("job_id"), "ids")
        work(once.join(ids, "job_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        ids.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return start(entries, handle, checkpoint, **options)


def route(outcomes: DataFrame, as_of: Column, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Acknowledged, dead-letter and republish sinks, fed by one pass over each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        routed = jobs.route_outcomes(batch, as_of)
        routed.write.mode("overwrite").partitionBy("route").parquet(f"{out}/batch={batch_id}")

    return start(outcomes, handle, checkpoint, **options)


def request_counts(
    requests: DataFrame,
    limit: int = DEFAULTS.rate_limit,
    period_seconds: int = DEFAULTS.rate_period_seconds,
    late: str = "10 minutes",
) -> DataFrame:
    """Requests per client and fixed period, and how many of them were over the limit."""
    counted = (
        requests.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{period_seconds} seconds").alias("w"), "client")
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    period = F.floor(F.unix_seconds("w.start") / period_seconds)
    rejected = F.greatest(F.lit(0).cast("long"), F.col("requests") - limit)
    return counted.select("client", period.alias("period"), "requests", rejected.alias("rejected"))


def dedupe(submissions: DataFrame, late: str = "1 day") -> DataFrame:
    """First submission per external id within the watermark; rows without one all pass.

    Copies of a popular id are first reduced within salts, then once more across them.
    """
    own = F.concat(F.lit("job:"), F.col("job_id").cast("string"))
    keyed = submissions.withWatermark("ts", late).withColumns(
        {
            "_key": F.coalesce(F.nullif(F.col("external_id"), F.lit("")), own),
            "_salt": F.pmod(F.xxhash64("job_id"), F.lit(SALTS)),
        }
    )
    some = keyed.dropDuplicatesWithinWatermark(["_key", "_salt"])
    return some.dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_salt")


def first_arrivals(submissions: DataFrame) -> DataFrame:
    """The submission that wins each external id, the earliest by (ts, job_id): external_id, job_id, ts, in update mode.

    A copy that arrives later but is earlier by its time takes over, and the row is emitted again, so the last row of an id
    (``latest``) is that of the batch rule whatever the order of arrival. Copies of a popular id are reduced before they are
    sent. Ids stay known, as they do in the table of jobs; submissions without one win for themselves and are not here.
    """
    named = submissions.where(F.coalesce("external_id", F.lit("")) != "")
    won = named.groupBy("external_id").agg(F.min(F.struct(F.col("ts").isNull().alias("no_time"), "ts", "job_id")).alias("won"))
    return won.select("external_id", F.col("won.job_id").alias("job_id"), F.col("won.ts").alias("ts"))


def status_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stage_counts(stages: DataFrame, buckets) -> DataFrame:
    """Running histogram: cumulative counts per stage as one array, with sum and count."""
    counts = F.array(*[F.count_if(F.col("seconds") <= b) for b in buckets])
    return stages.groupBy("stage").agg(
        counts.alias("cumulative"), F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("n")
    )


def delivery_results(attempts: DataFrame, as_of: Column, **policy) -> DataFrame:
    """Delivery state after each recorded attempt; ``ips`` are the host's addresses."""
    safe = guards.callback_allowed(F.col("url"), F.col("ips"), **policy)
    return jobs.delivery_step(attempts, as_of, safe)


def attempt_outcomes(attempts: DataFrame, outcomes: DataFrame, timeout: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Every attempt with the answer that came within ``timeout`` after it was sent, for ``delivery_step``.

    Attempts: delivery_id, attempts (tries before this one), sent_at and more columns; outcomes: delivery_id, attempts,
    answered_at, outcome_code, outcome_text. An attempt without an answer in time has a null code and the text "timeout"; of
    two streams it comes out once the watermarks, ``late`` behind each, have passed the last moment an answer could bear.
    Both sides are dealt by (delivery_id, attempts), so a delivery tried often is many keys, and the state holds only what
    is within the watermarks; rows without an id or a try meet nothing and don't move the watermark. Works the same on tables.
    """
    sent = attempts.withWatermark("sent_at", late)
    told = outcomes.select(
        F.col("delivery_id").alias("_d"), F.col("attempts").alias("_a"), "answered_at", "outcome_code", "outcome_text"
    ).withWatermark("answered_at", late)
    met = sent.join(
        told,
        (F.col("delivery_id") == F.col("_d"))
        & (F.col("attempts") == F.col("_a"))
        & (F.col("answered_at") >= F.col("sent_at"))
        & (F.col("answered_at") <= F.col("sent_at") + F.expr(f"INTERVAL {timeout}")),
        "left",
    )
    text = F.when(F.col("_d").isNull(), "timeout").otherwise(F.col("outcome_text"))
    return met.withColumn("outcome_text", text).drop("_d", "_a", "answered_at")
