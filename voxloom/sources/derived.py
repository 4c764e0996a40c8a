"""Speech-shaped tables derived from the sample tables, for queries and benchmarks.

The sample data has no audio, so words, segments, jobs and signals are built
from whole sample tables by fixed arithmetic. Times are integer milliseconds
divided by 1000. Tables that need a shuffle to build are written once per
session to the shared folder, as they would exist in production, and then
scanned like any other table.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.session import cut

TURN_BLOCK = 4096
SAMPLES_PER_RECORDING = 2000
SAMPLE_RATE = 1000


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(build):
    """Write the derived table on first use in a session, read it afterwards."""

    @wraps(build)
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _STAGED:
            _STAGED[key] = cut(build(spark, sf_dir), build.__name__)
        return _STAGED[key]

    return wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(col: Column, by: int) -> Column:
    return F.floor(col / by).cast("long")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation turn with the place of its first word in the recording."""
    conv = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("recording_id"),
        "turn",
        "role",
        F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "").alias("ws"),
    )
    size = F.size("ws").cast("long")
    run = blocks.running(
        conv, ["recording_id"], ["turn"], blocks.block_of("turn", TURN_BLOCK), sums={"upto": size}
    )
    return run.select("recording_id", "turn", "role", "ws", (F.col("upto") - size).alias("off"), size.alias("n"))


def _ms(pos: Column, turn: Column) -> Column:
    return pos * 400 + turn * 500 + div(pos, 23) * 2000


@staged
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 ms words every 400 ms, a longer pause per turn and every 23 words."""
    tok = _turns(spark, sf_dir).select("recording_id", "turn", "role", "off", F.posexplode("ws").alias("i", "word"))
    pos = F.col("off") + F.col("i")
    ms = _ms(pos, F.col("turn"))
    return tok.select(
        "recording_id",
        "turn",
        "role",
        "i",
        pos.alias("pos"),
        "word",
        (ms / 1e3).alias("start_time"),
        ((ms + 300) / 1e3).alias("end_time"),
    )


@staged
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One speaker segment per turn, late on odd turns and spilling over on every
    third; a one-word noise segment comes earlier in list order on even turns."""
    t = _turns(spark, sf_dir).where("n > 0")
    turn = F.col("turn")
    first, last = _ms(F.col("off"), turn), _ms(F.col("off") + F.col("n") - 1, turn)
    noise = _ms(F.col("off") + 5, turn)
    main = F.struct(
        (turn * 2 + 1).alias("seg_no"),
        F.concat(F.lit("SPK_"), "role").alias("speaker_id"),
        ((first + (turn % 2) * 450) / 1e3).alias("start_time"),
        ((last + 300 + F.when(turn % 3 == 2, 700).otherwise(0)) / 1e3).alias("end_time"),
    )
    spike = F.struct(
        (turn * 2).alias("seg_no"),
        F.lit("SPK_noise").alias("speaker_id"),
        (noise / 1e3).alias("start_time"),
        ((noise + 300) / 1e3).alias("end_time"),
    )
    both = F.when((turn % 2 == 0) & (F.col("n") > 5), F.array(main, spike)).otherwise(F.array(main))
    return t.select("recording_id", F.inline(both))


@staged
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech activity: one interval per 23 words, every fifth one missing."""
    return (
        words(spark, sf_dir)
        .groupBy("recording_id", div(F.col("pos"), 23).alias("blk"))
        .agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
        .where("blk % 5 <> 4")
    )


@staged
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; the duration is unknown for every fourth."""
    conv = table(spark, sf_dir, "conversations")
    rid = F.col("recording_id")
    return conv.groupBy(F.col("conv_id").alias("recording_id")).agg(F.count(F.lit(1)).alias("turns")).select(
        "recording_id",
        F.when(rid % 4 == 0, F.lit(0.0)).otherwise(F.col("turns") * 20.0 + 0.5).alias("duration_seconds"),
        (rid % 3 + 1).cast("int").alias("num_speakers"),
    )


@staged
def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns decorated with greetings, a role trigger, questions and repeats; 60 ms per character."""
    conv = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    hello = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") < 2), "çağrı merkezi hoş geldiniz ").otherwise("")
    tail = (
        F.when(kind == 1, " şikayetinizi not aldım ve devam ediyoruz")
        .when(kind == 2, " neden gecikti ? Bilmiyorum?? tamam.")
        .when(kind == 3, " evet evet evet evet, tamam,tamam, tamam , son")
        .when(kind == 4, ".")
        .otherwise("")
    )
    base = conv.select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").alias("utt_no"),
        F.concat(hello, F.col("text"), tail).alias("text"),
    )
    size = F.length("text").cast("long")
    run = blocks.running(
        base, ["recording_id"], ["utt_no"], blocks.block_of("utt_no", TURN_BLOCK), sums={"upto": size}
    )
    no = F.col("utt_no")
    begin = (F.col("upto") - size) * 60 + no * 400 + div(no, 3) * 3000
    return run.select(
        "recording_id",
        "utt_no",
        F.when(div(no, 2) % 2 == 0, "SPEAKER_00").otherwise("SPEAKER_01").alias("speaker_id"),
        (begin / 1e3).alias("start_time"),
        ((begin + size * 60) / 1e3).alias("end_time"),
        "text",
    )


def stored_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utterance table as stored: id, creation time, coarse start times that tie."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        F.col("conv_id").alias("recording_id"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("utterance_id"),
        F.concat(F.lit("SPK_"), "role").alias("speaker_id"),
        (div(F.col("turn"), 2) * 1500 / 1e3).alias("start_time"),
        (div(F.col("turn"), 2) * 1500 / 1e3 + 1.25).alias("end_time"),
        (F.col("turn") % 2).alias("created_no"),
        F.col("text"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    s = key.cast("string")
    ext = {0: ".wav", 1: ".MP3", 2: ".flac", 3: ".m4a", 4: ".ogg", 5: ".exe"}
    suffix = F.lit("")
    for k, v in ext.items():
        suffix = F.when(key % 7 == k, v).otherwise(suffix)
    status = F.col("o_orderstatus")
    host = F.concat(F.lit("https://h"), (F.col("o_custkey") % 20).cast("string"), F.lit(".example.com/cb"))
    return table(spark, sf_dir, "orders").select(
        key.alias("job_id"),
        F.when(key % 7 != 0, F.concat(F.lit("ext-"), (key % 5000).cast("string"))).alias("external_id"),
        F.concat(F.lit("disk://"), s, F.lit(".wav")).alias("storage_uri"),
        F.concat(F.lit("call_"), s, suffix).alias("file_name"),
        (F.floor("o_totalprice").cast("long") * 1000).alias("size_bytes"),
        (F.col("o_custkey") % 13).cast("int").alias("num_speakers"),
        F.when((status == "F") & (key % 10 == 0), "FAILED")
        .when(status == "F", "COMPLETED")
        .when(status == "O", "PENDING")
        .otherwise("PROCESSING")
        .alias("status"),
        (key % 4).cast("int").alias("attempts"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(key % 3 == 0, host).alias("callback_url"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_jobs(table(spark, sf_dir, "events"))


def events_as_jobs(events: DataFrame) -> DataFrame:
    """Job history from the event table or a stream of it."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("job_id"),
        "ts",
        "event_id",
        F.when(kind == "signup", "submit")
        .when(kind == "view", "claim")
        .when(kind == "click", "heartbeat")
        .when(kind == "purchase", "complete")
        .otherwise("fail")
        .alias("kind"),
        "value",
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "signup", "normalize")
        .when(kind == "view", "vad")
        .when(kind == "click", "stt")
        .when(kind == "purchase", "diarization")
        .otherwise("fusion")
        .alias("stage"),
        (F.col("value") / 10.0).alias("seconds"),
    )


@staged
def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery per order line, numbered within its job by ship date."""
    cols = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"]
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", *cols)
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    n = blocks.short_row_numbers(line, ["l_orderkey"], cols, div(day, 30), "no")
    host = F.concat(F.lit("https://h"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example.com/cb"))
    return n.select(
        (F.col("l_orderkey") * 1000 + F.col("no")).alias("delivery_id"),
        F.col("l_orderkey").alias("job_id"),
        host.alias("url"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).cast("int").alias("attempts"),
        F.col("l_shipdate").alias("next_attempt_at"),
        F.when(F.col("l_linestatus") == "O", "PENDING").otherwise("SUCCESS").alias("status"),
        F.when(F.col("l_returnflag") == "N", 200).otherwise(503).alias("outcome_code"),
    )


@staged
def window_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    n = blocks.row_numbers(emb, ["label"], ["vec_id"], div(F.col("vec_id"), 4096), "no")
    return n.select(
        F.col("label").cast("long").alias("recording_id"), (F.col("no") - 1).alias("win_idx"), "vec_id", "embedding"
    )


@staged
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    n = blocks.row_numbers(ev, ["user_id"], ["ts", "event_id"], day, "no")
    return n.select(
        F.col("user_id").alias("recording_id"),
        (F.col("no") - 1).alias("win_idx"),
        F.when(F.col("event_id") % 11 != 0, div(F.col("value"), 10) % 3).alias("raw_label"),
        (F.col("value") / 1e2).alias("energy"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle wave with quiet stretches: every event is one sample."""
    e = F.col("event_id")
    rec = div(e, SAMPLES_PER_RECORDING)
    pos = e % SAMPLES_PER_RECORDING
    loud = F.when(div(pos, 500) % 3 == 1, 1).otherwise(100)
    return table(spark, sf_dir, "events").select(
        rec.alias("recording_id"),
        pos.alias("pos"),
        F.lit(SAMPLE_RATE).alias("sample_rate"),
        (loud * ((e * 37 + rec * 11) % 201 - 100) / 1e4).alias("value"),
    )
