"""Registered queries: every operator on tables derived from the sample data."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import session
from voxloom.functions import audio, guards
from voxloom.functions import text as T
from voxloom.operators import blocks, diarise, intervals, jobs, metrics, refine, signal, utterances
from voxloom.operators import cluster, lifecycle, similar
from voxloom.operators import transcripts as X
from voxloom.params import Params
from voxloom.plans import diarise as diarise_plan
from voxloom.plans import jobs as jobs_plan
from voxloom.sources import contracts, tables
from voxloom.sources import derived as D
from voxloom.streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.apply(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


# --- words, speakers, utterances -------------------------------------------------


@query
def word_times(spark, sf):
    w = intervals.word_times(D.words(spark, sf))
    return w.select("recording_id", "pos", F.round("midpoint", 6).alias("midpoint"), F.round("duration", 6).alias("duration"))


@query
def speaker_at_midpoint(spark, sf):
    out = intervals.attribute_words(D.words(spark, sf), D.segments(spark, sf))
    return out.select("recording_id", "pos", F.col("at_midpoint").alias("speaker_id"))


@query
def max_overlap_speaker(spark, sf):
    out = intervals.attribute_words(D.words(spark, sf), D.segments(spark, sf))
    return out.where(F.col("at_midpoint").isNull()).select("recording_id", "pos", "speaker_id")


@query
def vad_filter(spark, sf):
    return intervals.vad_filter(D.words(spark, sf), D.intervals(spark, sf)).select("recording_id", "pos", "word")


@query
def overlap_pairs(spark, sf):
    p = intervals.overlap_pairs(D.segments(spark, sf))
    return p.select(
        "recording_id", "i_seg", "j_seg", F.array_join("speakers", "+").alias("speakers"), "start_time", "end_time", "duration"
    )


@query
def smooth_speakers(spark, sf):
    w = intervals.attribute_words(D.words(spark, sf), D.segments(spark, sf))
    return utterances.smooth_speakers(w.select("recording_id", "pos", "speaker_id"))


@query
def sessionise_words(spark, sf):
    w = D.words(spark, sf).withColumn("speaker_id", F.col("role"))
    out = utterances.sessionise(w.select("recording_id", "pos", "speaker_id", "start_time", "end_time"))
    return out.select("recording_id", "pos", "utt_key")


@query
def build_utterances(spark, sf):
    w = D.words(spark, sf).withColumn("utt_key", D.div(F.col("pos"), 23)).withColumn("speaker_id", F.lit("S"))
    return utterances.build_utterances(w).select("recording_id", "utt_key", "start_time", "end_time", "text")


@query
def normalise_speakers(spark, sf):
    s = D.segments(spark, sf).select("recording_id", F.col("seg_no").alias("utt_key"), "speaker_id")
    return utterances.normalise_speakers(s)


@query
def suppress_repeats(spark, sf):
    """Every word of a multiple-of-seven place is said four times before the filter."""
    w = D.words(spark, sf).select("recording_id", F.col("pos").alias("p"), "word")
    times = F.when(F.col("p") % 7 == 0, F.lit(4)).otherwise(F.lit(1))
    said = w.select("recording_id", "word", "p", F.explode(F.sequence(F.lit(1), times)).alias("k"))
    dense = blocks.row_numbers(said, ["recording_id"], ["p", "k"], blocks.block_of("p", 4096), "no")
    heard = dense.select("recording_id", (F.col("no") - 1).alias("pos"), "word")
    return utterances.suppress_repeats(heard)


@query
def fuse(spark, sf):
    return utterances.fuse(D.words(spark, sf), D.segments(spark, sf))


@query
def fusion_unattributed(spark, sf):
    """Recordings without speaker segments: everything is the unknown speaker."""
    none = D.segments(spark, sf).where(F.lit(False))
    return utterances.fuse(D.words(spark, sf), none)


# --- overlap and duration --------------------------------------------------------


def _durations(spark, sf):
    return intervals.effective_duration(D.recordings(spark, sf), D.words(spark, sf), D.segments(spark, sf))


@query
def effective_duration(spark, sf):
    return _durations(spark, sf).select("recording_id", "effective_duration")


@query
def overlap_summary(spark, sf):
    seg = D.segments(spark, sf)
    out = intervals.overlap_summary(_durations(spark, sf), intervals.overlap_totals(seg))
    return out.select("recording_id", "supported", "total_overlap_seconds", "overlap_percentage", "interrupt_count")


@query
def overlap_pages(spark, sf):
    pages = intervals.overlap_pages(intervals.overlap_pairs(D.segments(spark, sf)))
    return pages.select("recording_id", "page_no", F.to_json("overlaps").alias("overlaps"))


@query
def summary_json(spark, sf):
    """Summary to JSON and back; every fifth text is cut short and must come back null."""
    seg = D.segments(spark, sf)
    out = intervals.overlap_summary(_durations(spark, sf), intervals.overlap_totals(seg))
    text = X.summary_to_json(F.struct("supported", "total_overlap_seconds", "overlap_percentage", "interrupt_count"))
    broken = F.when(F.col("recording_id") % 5 == 0, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    back = X.summary_from_json(broken)
    return out.select(
        "recording_id",
        broken.alias("json"),
        back["total_overlap_seconds"].alias("total_overlap_seconds"),
        back["interrupt_count"].alias("interrupt_count"),
    )


@query
def diarise_gate(spark, sf):
    return jobs_plan.diarise_gate(_durations(spark, sf), "feedback", 45.0).select("recording_id", "gate")


@query
def single_speaker_segments(spark, sf):
    gated = jobs_plan.diarise_gate(D.recordings(spark, sf), "full")
    return jobs_plan.single_speaker_segments(gated)


@query
def validate_inputs(spark, sf):
    return contracts.check_rows(D.segments(spark, sf), contracts.SEGMENTS)


# --- text ------------------------------------------------------------------------


@query
def clean_repetition(spark, sf):
    """Steps 2 and 3 are checked by SQL; phrases are unit-tested."""
    return refine.clean_repetition(D.utterances(spark, sf).select("recording_id", "utt_no", "text"))


@query
def normalise_turkish(spark, sf):
    u = D.utterances(spark, sf)
    fused = F.concat("text", F.lit(" Cumagünü geldi , bir  beyni tüpçe akıcık arkadaşıar salısabahı !"))
    return u.select("recording_id", "utt_no", T.normalise_turkish(fused).alias("text"))


@query
def split_role_transition(spark, sf):
    u = refine.split_roles(D.utterances(spark, sf), T.triggers_for("call_center"))
    return u.select("recording_id", "utt_no", "part", "speaker_id", "start_time", "end_time", "text")


@query
def custom_triggers(spark, sf):
    u = refine.split_roles(D.utterances(spark, sf), T.triggers_for(None, {"agent_triggers": ["neden gecikti"], "customer_triggers": ["devam ediyoruz"]}))
    return u.select("recording_id", "utt_no", "part", "speaker_id", "text")


@query
def split_questions(spark, sf):
    u = refine.split_questions(D.utterances(spark, sf))
    return u.select("recording_id", "utt_no", "sub", "speaker_id", "start_time", "end_time", "text")


@query
def merge_short_gaps(spark, sf):
    return refine.merge_short_gaps(D.utterances(spark, sf), ["utt_no"])


@query
def lock_greetings(spark, sf):
    return refine.lock_greetings(D.utterances(spark, sf), ["utt_no"], horizon=90.0)


@query
def refine_general(spark, sf):
    return refine.refine(D.utterances(spark, sf))


@query
def refine_call_center(spark, sf):
    return refine.refine(D.utterances(spark, sf), Params(domain_mode="call_center", greeting_horizon=90.0))


@query
def analyse(spark, sf):
    return jobs_plan.analyse(
        D.recordings(spark, sf), D.words(spark, sf), D.segments(spark, sf), D.intervals(spark, sf)
    ).utterances


@query
def analyse_summaries(spark, sf):
    return jobs_plan.analyse(
        D.recordings(spark, sf), D.words(spark, sf), D.segments(spark, sf), D.intervals(spark, sf)
    ).summaries.select("recording_id", "gate", "effective_duration", "total_overlap_seconds", "overlap_percentage", "interrupt_count")


@query
def render_prompt(spark, sf):
    return X.render_prompts(D.utterances(spark, sf))


@query
def transcript_json(spark, sf):
    return X.transcript_pages(D.utterances(spark, sf))


@query
def transcript_lines(spark, sf):
    u = D.utterances(spark, sf)
    line = X.transcript_line(F.col("speaker_id"), F.col("start_time"), F.col("end_time"), F.col("text"))
    return u.select("recording_id", "utt_no", line.alias("line"))


# --- job tables --------------------------------------------------------------------

AS_OF = "1998-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-15 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _ips(key):
    part = lambda by, mod: (D.div(F.col(key), by) % mod).cast("string")
    first = F.concat_ws(".", part(1, 256), part(3, 256), part(7, 251), part(11, 241))
    second = F.concat_ws(".", part(5, 256), part(2, 256), F.lit("9"), F.lit("9"))
    return F.when(F.col(key) % 17 != 0, F.when(F.col(key) % 2 == 0, F.array(first)).otherwise(F.array(first, second)))


@query
def admission(spark, sf):
    j = D.jobs(spark, sf).withColumn("ips", _ips("job_id")).withColumn("content_ok", F.col("job_id") % 11 != 0)
    return jobs.admit(j, "ips", "content_ok").select("job_id", "reason", "code")


@query
def callback_policy(spark, sf):
    j = D.jobs(spark, sf)
    url = F.when(F.col("job_id") % 4 == 0, F.concat(F.lit("http://h1.example.com/"), F.col("job_id").cast("string"))).otherwise(F.col("callback_url"))
    ok = guards.callback_allowed(F.col("url"), F.col("ips"))
    return j.withColumn("url", url).withColumn("ips", _ips("job_id")).select("job_id", ok.alias("allowed"))


@query
def error_class(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("OSError", "ValueError", "PermanentJobError", "TransientJobError", "RuntimeError")])
    msgs = F.array(*[F.lit(m) for m in ("Header CORRUPT at 7", "disk full", "Desteklenmeyen codec", "timeout")])
    kind, msg = F.get(kinds, (F.col("job_id") % 5).cast("int")), F.get(msgs, (D.div(F.col("job_id"), 5) % 4).cast("int"))
    return D.jobs(spark, sf).select("job_id", guards.error_is_transient(kind, msg).alias("transient"))


@query
def error_sanitise(spark, sf):
    s = F.col("job_id").cast("string")
    msg = F.concat(F.lit("cannot open /srv/data/"), s, F.lit("/a.wav: or C:\\Users\\x\\"), s, F.lit(".wav now, see /tmp and a/b/c"))
    return D.jobs(spark, sf).select("job_id", guards.sanitise_error(F.lit("OSError"), msg).alias("message"))


@query
def storage_uri_parts(spark, sf):
    j = D.jobs(spark, sf)
    s = F.col("job_id").cast("string")
    uri = (
        F.when(F.col("job_id") % 5 == 0, F.concat(F.lit("s3://bucket"), (F.col("job_id") % 3).cast("string"), F.lit("/raw/"), s))
        .when(F.col("job_id") % 5 == 1, F.concat(F.lit("disk://../"), s))
        .otherwise(F.col("storage_uri"))
    )
    p = guards.uri_parts(F.col("uri"))
    return j.withColumn("uri", uri).select(
        "job_id", p["scheme"].alias("scheme"), p["bucket"].alias("bucket"), p["key"].alias("key"), p["safe"].alias("safe"),
        guards.safe_extension(F.col("file_name")).alias("ext"),
    )


@query
def idempotent_ingest(spark, sf):
    """Jobs of the even thousands are stored already; the others arrive."""
    j = D.jobs(spark, sf)
    old = D.div(F.col("job_id"), 1000) % 2 == 0
    out = jobs.ingest(j.where(~old), j.where(old))
    return out.select("job_id", "effective_id", "is_new")


def _record_split(spark, sf):
    j = D.jobs(spark, sf)
    return j, j.where(D.div(F.col("job_id"), 50) % 2 == 0)


@query
def backfill_records(spark, sf):
    j, target = _record_split(spark, sf)
    return jobs.backfill(j, target, D.stored_utterances(spark, sf), F.lit(0))[0].select("job_id", "status")


@query
def backfill_utterances(spark, sf):
    j, target = _record_split(spark, sf)
    u = D.stored_utterances(spark, sf)
    return jobs.backfill(j, target, u, blocks.block_of("start_time", 600.0))[1].select("recording_id", "utterance_id")


@query
def record_with_utterances(spark, sf):
    rec = D.jobs(spark, sf).select(F.col("job_id").alias("recording_id"), "status")
    pages = X.record_pages(rec, D.stored_utterances(spark, sf), ["created_no", "utterance_id"])
    ids = F.array_join(F.transform("utterances", lambda u: u["utterance_id"]), ",")
    return pages.select("recording_id", "status", "page_no", ids.alias("ids"))


def _cascade(spark, sf):
    j, u, d = D.jobs(spark, sf), D.stored_utterances(spark, sf), D.deliveries(spark, sf)
    gone = j.where((F.col("status") == "FAILED") | (F.col("job_id") % 9 == 0))
    return jobs.cascade_delete(j, u, d, gone, blocks.block_of("start_time", 600.0), jobs.salt("delivery_id"))


@query
def cascade_delete_jobs(spark, sf):
    return _cascade(spark, sf)[0].select("job_id", "status")


@query
def cascade_delete_utterances(spark, sf):
    return _cascade(spark, sf)[1].select("recording_id", "utterance_id")


@query
def cascade_delete_deliveries(spark, sf):
    return _cascade(spark, sf)[2].select("delivery_id", "job_id")


def _completions(spark, sf):
    j = D.jobs(spark, sf)
    started = F.when(F.col("job_id") % 6 != 0, F.col("updated_at"))
    state = j.withColumn("processing_started_at", started).withColumns(
        {"language": F.lit(None).cast("string"), "overlap_summary": F.lit(None).cast("string"), "error_message": F.lit("old")}
    )
    token = F.when(F.col("job_id") % 4 == 0, F.lit(None)).when(F.col("job_id") % 4 == 1, _at(AS_OF)).otherwise(F.col("updated_at"))
    res = j.select(
        (F.col("job_id") + F.when(F.col("job_id") % 13 == 0, 10**9).otherwise(0)).alias("job_id"),
        token.cast("timestamp_ntz").alias("token"),
        F.when(F.col("job_id") % 2 == 0, "tr").alias("language"),
        F.lit(None).cast("string").alias("overlap_summary"),
        F.concat(F.lit("p"), F.col("job_id").cast("string")).alias("payload"),
    )
    return state, jobs.completion_verdicts(state, res)


@query
def fenced_complete(spark, sf):
    return _completions(spark, sf)[1].select("job_id", "verdict")


@query
def fenced_complete_jobs(spark, sf):
    state, v = _completions(spark, sf)
    out = jobs.apply_completions(state, v, _at(AS_OF))
    return out.select("job_id", "status", "updated_at", "language", "error_message")


@query
def fenced_complete_outbox(spark, sf):
    state, v = _completions(spark, sf)
    return jobs.completion_outbox(state, v, _at(AS_OF))


@query
def fenced_complete_utterances(spark, sf):
    state, v = _completions(spark, sf)
    old = D.stored_utterances(spark, sf).select("recording_id", "utterance_id", "text", "start_time")
    new = old.withColumn("utterance_id", F.concat(F.lit("new-"), "utterance_id"))
    by = blocks.block_of("start_time", 600.0)
    return jobs.replace_utterances(old, v, new, by, by).select("recording_id", "utterance_id")


def _engines(spark, sf):
    """Three engines: each sees the segments of one speaker kind; some runs raise."""
    seg = D.segments(spark, sf)
    spk = F.col("speaker_id")
    engine = F.when(spk == "SPK_system", "alpha").when(spk == "SPK_noise", "beta").otherwise("gamma")
    tagged = seg.withColumn("engine", engine)
    rec = D.recordings(spark, sf)
    raised = rec.where("recording_id % 3 = 0").select("recording_id", F.lit("alpha").alias("engine")).unionByName(
        rec.where("recording_id % 7 = 0").select("recording_id", F.lit("beta").alias("engine"))
    )
    win, log = jobs.engine_fallback(rec, raised, tagged, ["alpha", "beta", "gamma"])
    return tagged, win, log


@query
def engine_fallback(spark, sf):
    return _engines(spark, sf)[1]


@query
def engine_fallback_segments(spark, sf):
    tagged, win, _ = _engines(spark, sf)
    return jobs.winning_segments(tagged, win, blocks.block_of("seg_no", 4096)).select("recording_id", "seg_no", "engine")


@query
def engine_skip_log(spark, sf):
    return _engines(spark, sf)[2]


@query
def fallback_counts(spark, sf):
    return metrics.fallback_counts(_engines(spark, sf)[2])


@query
def utterance_ordinals(spark, sf):
    u = D.stored_utterances(spark, sf).select("recording_id", "utterance_id", "start_time", "created_no")
    return X.ordinals(u, ["created_no", "utterance_id"]).select("recording_id", "utterance_id", "utt_no")


@query
def list_jobs(spark, sf):
    page = jobs.list_page(D.jobs(spark, sf), 20, 50).select(F.col("job_id").alias("recording_id"), "created_at")
    block = blocks.block_of("start_time", 600.0)
    listed = blocks.attach(D.stored_utterances(spark, sf), page.select("recording_id"), ["recording_id"], block, "left_semi")
    pages = X.record_pages(page, listed, ["created_no", "utterance_id"])
    return pages.groupBy("recording_id", "created_at").agg(F.sum(F.size("utterances")).cast("int").alias("n"))


@query
def due_deliveries(spark, sf):
    return jobs.due_deliveries(D.deliveries(spark, sf), _at(AS_OF)).select("delivery_id", "url", "next_attempt_at")


@query
def stale_jobs(spark, sf):
    return jobs.stale_jobs(D.jobs(spark, sf), "PROCESSING", _at(AS_OF), 1800).select("job_id", "updated_at")


@query
def expired_jobs(spark, sf):
    return jobs.expired_jobs(D.jobs(spark, sf), _at(AS_OF), ["COMPLETED", "FAILED"]).select("job_id", "status")


def _day(col):
    return F.datediff(F.col(col).cast("date"), F.lit("1970-01-01").cast("date"))


@query
def fifo_capacity(spark, sf):
    j = D.jobs(spark, sf).select("job_id", "created_at", "size_bytes")
    out = jobs.newest_within(j, ["created_at", "job_id"], 9000, 10**12)
    return out.select("job_id", "size_bytes")


@query
def stream_trim(spark, sf):
    e = D.job_events(spark, sf).select("event_id", "kind", "ts")
    return jobs.trim_stream(e, ["ts", "event_id"], _day("ts"), 6000).select("event_id", "kind")


def _edits(spark, sf):
    u = D.stored_utterances(spark, sf)
    j = D.jobs(spark, sf)
    c = D.table(spark, sf, "conversations").select("conv_id", "turn")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    uid = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + F.when(F.col("conv_id") % 7 == 0, 1).otherwise(0)).cast("string"))
    e = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("edit_no"),
        F.when(kind.isin(0, 2), "update").when(kind.isin(1, 3), "delete").otherwise("add").alias("op"),
        (F.col("conv_id") + F.when(kind == 5, 10**9).otherwise(0)).alias("recording_id"),
        F.when(kind.isin(0, 1), uid).when(kind.isin(4, 5), F.concat(F.lit("a"), uid)).alias("utterance_id"),
        F.when(kind.isin(2, 3), F.col("turn") + 1).alias("utt_index"),
        F.lit("EDITED").alias("speaker_id"),
        F.concat(F.lit("text "), F.col("turn").cast("string")).alias("text"),
        F.lit(1.0).alias("start_time"),
        F.lit(2.0).alias("end_time"),
        F.lit(0).cast("long").alias("created_no"),
    )
    resolved, _ = jobs.resolve_edits(u, e, ["created_no", "utterance_id"])
    return jobs.apply_edits(u, resolved, j, blocks.block_of("edit_no", 4096))


@query
def apply_edits(spark, sf):
    return _edits(spark, sf)[0].select("recording_id", "utterance_id", "speaker_id", "text")


@query
def apply_edits_not_found(spark, sf):
    return _edits(spark, sf)[1]


@query
def retention_manifest(spark, sf):
    return jobs.retention(D.jobs(spark, sf), _at(AS_OF))[0]


@query
def retention_records(spark, sf):
    return jobs.retention(D.jobs(spark, sf), _at(AS_OF), 24, 365)[1]


@query
def sweep(spark, sf):
    out = jobs.sweep(D.jobs(spark, sf), _at(AS_OF), 0)
    return out.select("job_id", "action", "new_status", "new_attempts", "dead_letter", "payload")


@query
def sweep_again(spark, sf):
    """Jobs after a sweep, and what a second one at the same time does to each: nothing."""
    swept = jobs.after_sweep(D.jobs(spark, sf), _at(AS_OF), 0)
    again = jobs.sweep(swept, _at(AS_OF), 0).select("job_id", "action")
    return swept.join(again, "job_id", "left").select("job_id", "status", "attempts", "updated_at", "action")


@query
def route_outcomes(spark, sf):
    j = D.jobs(spark, sf)
    result = F.when(F.col("status") == "PENDING", "RETRY").when(F.col("status") == "PROCESSING", "SKIPPED").otherwise(F.col("status"))
    return jobs.route_outcomes(j.withColumn("result", result), F.col("updated_at")).select("job_id", "route", "not_before")


@query
def reclaim_idle(spark, sf):
    e = D.job_events(spark, sf).withColumns(
        {"idle_ms": F.floor(F.col("value") * 10000).cast("long"), "delivery_count": (F.col("event_id") % 5).cast("int")}
    )
    return jobs.reclaim(e, "worker-1").select("event_id", "consumer", "action")


@query
def delivery_step(spark, sf):
    d = D.deliveries(spark, sf).withColumn("outcome_text", F.repeat(F.lit("busy "), (F.col("job_id") % 60).cast("int")))
    safe = F.col("job_id") % 19 != 0
    out = jobs.delivery_step(d, F.col("next_attempt_at"), safe)
    return out.select("delivery_id", "status", "attempts", "next_attempt_at", "error_message")


@query
def host_waves(spark, sf):
    d = D.deliveries(spark, sf).select("delivery_id", "url", "next_attempt_at")
    out = jobs.host_waves(d)
    return out.select("delivery_id", "host", "wave")


@query
def webhook_payload(spark, sf):
    j = D.jobs(spark, sf)
    text = X.failed_payload(F.col("attempts"), guards.sanitise_error(F.lit("OSError"), F.lit("lost /mnt/a/b.wav")))
    return j.select("job_id", text.alias("payload"))


@query
def webhook_payload_completed(spark, sf):
    u = D.stored_utterances(spark, sf)
    rec = D.jobs(spark, sf).select(F.col("job_id").alias("recording_id"), "job_id", "file_name", F.lit("tr").alias("language"))
    seg = D.segments(spark, sf)
    summaries = intervals.overlap_summary(_durations(spark, sf), intervals.overlap_totals(seg))
    pages = intervals.overlap_pages(intervals.overlap_pairs(seg))
    return X.completed_bodies(rec, u, summaries, pages, ["created_no", "utterance_id"]).select("job_id", "payload")


@query
def hmac_sign(spark, sf):
    body = F.concat(F.lit('{"job_id":"'), F.col("job_id").cast("string"), F.lit('"}'))
    ts = F.unix_seconds(F.col("next_attempt_at").cast("timestamp")).cast("string")
    return D.deliveries(spark, sf).select("delivery_id", guards.sign("whsec-test", ts, body).alias("signature"))


@query
def hmac_verify(spark, sf):
    """Every third signature is altered, every fifth is late, every seventh has a bad timestamp."""
    i = F.col("delivery_id")
    body = F.concat(F.lit("b"), i.cast("string"))
    ts = F.when(i % 7 == 0, "soon").when(i % 5 == 0, "1000").otherwise("2000")
    sig = F.concat(guards.sign("whsec-test", ts, body), F.when(i % 3 == 0, "0").otherwise(""))
    ok = guards.signature_valid("whsec-test", ts, body, sig, F.lit(2300))
    return D.deliveries(spark, sf).select("delivery_id", ok.alias("valid"))


@query
def backoff(spark, sf):
    return D.deliveries(spark, sf).select(
        "delivery_id",
        guards.webhook_backoff_seconds(F.col("attempts") + 1).alias("webhook_seconds"),
        guards.worker_backoff_seconds(F.col("attempts")).alias("worker_seconds"),
    )


@query
def client_key(spark, sf):
    i = F.col("event_id")
    key = F.when(i % 3 == 0, F.concat(F.lit(" key-"), i.cast("string"), F.lit(" "))).when(i % 3 == 1, "  ")
    ip = F.when(i % 2 == 0, F.concat(F.lit("10.0.0."), (i % 200).cast("string")))
    return D.job_events(spark, sf).select("event_id", guards.client_key(key, ip).alias("client"))


@query
def rate_limit(spark, sf):
    r = D.job_events(spark, sf).select("event_id", "ts", (F.col("job_id") % 5).alias("client"))
    return jobs.rate_limit(r, limit=5, period_seconds=3600).select("event_id", "client", "period", "request_no", "code", "retry_after")


# --- metrics -----------------------------------------------------------------------


@query
def status_counts(spark, sf):
    return metrics.status_counts({"jobs": D.jobs(spark, sf), "deliveries": D.deliveries(spark, sf)})


@query
def stage_histogram(spark, sf):
    h = metrics.stage_histogram(D.stages(spark, sf))
    return h.select("stage", "le", "cumulative", F.round("total", 4).alias("total"), "n")


def _queue(spark, sf):
    e = D.job_events(spark, sf)
    groups = e.groupBy("kind").agg(F.count(F.lit(1)).alias("lag"), F.count_if(F.col("value") > 50).alias("pending"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    msgs = e.select(F.concat(ms.cast("string"), F.lit("-0")).alias("msg_id"))
    return jobs_plan.Queue(groups, msgs, F.unix_seconds(F.lit(EVENTS_AS_OF + "+00:00").cast("timestamp")))


@query
def queue_gauges(spark, sf):
    q = _queue(spark, sf)
    out = metrics.queue_gauges(q.groups, q.messages, D.jobs(spark, sf), q.as_of_seconds, _at(AS_OF))
    return out.select("queue_depth", "pending_jobs", F.round("oldest_age_seconds", 3).alias("oldest_age_seconds"))


STAGES = ["decode_seconds", "vad_seconds", "stt_seconds"]


def _rtf(spark, sf):
    e = D.table(spark, sf, "events")
    v = F.col("value")
    runs = e.select(
        F.when(F.col("user_id") % 2 == 0, "small").otherwise("large").alias("model"),
        F.when(F.col("user_id") % 3 == 0, "feedback").otherwise("full").alias("profile"),
        F.lit(4).alias("threads"),
        (v * 10).alias("audio_seconds"),
        (v * 0.125).alias("decode_seconds"),
        (v * 0.25).alias("vad_seconds"),
        (v * 0.5).alias("stt_seconds"),
        (v * 0.875).alias("total_seconds"),
    )
    return metrics.real_time_factors(runs, STAGES)


@query
def rtf_k(spark, sf):
    num = ["audio_seconds", *STAGES, "total_seconds"]
    return _rtf(spark, sf).select("model", "profile", "level", *[F.round(c, 6).alias(c) for c in num], F.round("rtf", 6).alias("rtf"), F.round("k", 6).alias("k"))


@query
def capacity_plan(spark, sf):
    f = _rtf(spark, sf).where("level = 0").select("model", "profile", "rtf", "k")
    p = metrics.capacity_plan(f, 4000, [10, 30, 60], [1, 2, 4], 3600.0)
    return p.select("model", "profile", "message_seconds", "workers", "total_audio", F.round("cores_needed", 6).alias("cores_needed"), F.round("hours", 6).alias("hours"), "ram_gb")


@query
def operate(spark, sf):
    """Repairs, retention with its cascade, deliveries, durations, fallbacks and gauges of one snapshot, counted."""
    out = jobs_plan.operate(
        D.jobs(spark, sf),
        D.deliveries(spark, sf),
        _at(AS_OF),
        F.lit(True),
        utterances=D.stored_utterances(spark, sf),
        stages=D.stages(spark, sf),
        skips=_engines(spark, sf)[2],
        queue=_queue(spark, sf),
    )
    return out.counts


@query
def jobs_table(spark, sf):
    """The job table written in its fixed schema and read back; ``status`` folders leave the others unread."""
    path = session.shared_dir(spark, "jobs")
    tables.write_table(D.jobs(spark, sf), path, contracts.JOBS)
    back = tables.read_table(spark, path, contracts.JOBS).where("status = 'PENDING'")
    same = ["job_id", "external_id", "storage_uri", "file_name", "status", "callback_url", "attempts", "num_speakers", "language"]
    return back.select(*same, F.col("created_at").cast("timestamp_ntz").alias("created_at"))


# --- signal ------------------------------------------------------------------------


@query
def downmix(spark, sf):
    s = D.samples(spark, sf)
    pair = F.array(F.struct(F.lit(0).alias("channel"), F.col("value").alias("v")), F.struct(F.lit(1).alias("channel"), (F.col("value") / 2 + 0.01).alias("v")))
    two = s.select("recording_id", "pos", "sample_rate", F.inline(pair)).withColumnRenamed("v", "value")
    return signal.downmix(two).select("recording_id", "pos", F.round("value", 8).alias("value"))


@query
def frame_energy(spark, sf):
    f = signal.frame_energy(D.samples(spark, sf), 512, 0.5)
    return f.select("recording_id", "frame", F.round("energy", 8).alias("energy"), F.round("rms", 8).alias("rms"), "loud")


@query
def sliding_energy(spark, sf):
    e = signal.sliding_energy(D.samples(spark, sf), 120, 30)
    return e.select("recording_id", "win_idx", F.round("energy", 8).alias("energy"))


@query
def snr_db(spark, sf):
    return signal.snr_db(D.samples(spark, sf)).select("recording_id", F.round("snr_db", 5).alias("snr_db"))


@query
def denoise_gate(spark, sf):
    return signal.denoise_gate(signal.snr_db(D.samples(spark, sf)), profile="feedback", min_snr_db=38.0).select("recording_id", "denoise")


@query
def energy_threshold(spark, sf):
    t = signal.energy_thresholds(D.window_labels(spark, sf))
    return t.select("recording_id", *[F.round(c, 8).alias(c) for c in ("speech", "skip", "hold")])


@query
def energy_vad(spark, sf):
    return signal.energy_vad(D.samples(spark, sf))


@query
def linear_resample(spark, sf):
    r = signal.linear_resample(D.samples(spark, sf), 1600)
    return r.select("recording_id", "pos", F.round("value", 8).alias("value"))


@query
def signal_job(spark, sf):
    out = jobs_plan.signal(D.samples(spark, sf).withColumn("channel", F.lit(0)), 500)
    return out.vad


@query
def signal_job_noise(spark, sf):
    """Noise estimate and enhancement gate of the same job."""
    out = jobs_plan.signal(D.samples(spark, sf).withColumn("channel", F.lit(0)), 500, Params(profile="feedback", min_snr_db=38.0))
    return out.snr.select("recording_id", F.round("snr_db", 5).alias("snr_db"), "denoise")


# --- diarisation -------------------------------------------------------------------


@query
def pairwise_cosine(spark, sf):
    s = diarise.neighbour_similarity(D.window_embeddings(spark, sf))
    return s.select("recording_id", "win_idx", F.round("similarity", 6).alias("similarity"))


@query
def similar_windows(spark, sf):
    s = similar.similar_windows(D.window_embeddings(spark, sf), tile_rows=16)
    return s.select("recording_id", "win_idx", "rank", "other_idx", F.round("similarity", 6).alias("similarity"))


@query
def standardise(spark, sf):
    z = diarise.standardise(D.window_embeddings(spark, sf))
    return z.select("recording_id", "win_idx", F.posexplode("embedding").alias("f", "v")).select("recording_id", "win_idx", "f", (F.round("v", 5) + 0.0).alias("v"))


@query
def label_ffill(spark, sf):
    return diarise.fill_labels(D.window_labels(spark, sf)).select("recording_id", "win_idx", "label")


def _filled(spark, sf):
    return diarise.fill_labels(D.window_labels(spark, sf)).select("recording_id", "win_idx", "label", "energy")


@query
def majority_vote(spark, sf):
    return diarise.majority_vote(_filled(spark, sf)).select("recording_id", "win_idx", "label")


@query
def median_labels(spark, sf):
    return diarise.median_filter(_filled(spark, sf)).select("recording_id", "win_idx", "label")


@query
def smooth_labels(spark, sf):
    """Even recordings keep two labels, so both filters run."""
    w = _filled(spark, sf)
    two = F.when(F.col("recording_id") % 2 == 0, F.col("label") % 2).otherwise(F.col("label"))
    return diarise.smooth_labels(w.withColumn("label", two)).select("recording_id", "win_idx", "label")


@query
def gated_transition(spark, sf):
    w = _filled(spark, sf).withColumnRenamed("label", "raw_label")
    out = diarise.gate_transitions(w, signal.energy_thresholds(w))
    return out.select("recording_id", "win_idx", "label")


@query
def labels_to_segments(spark, sf):
    w = _filled(spark, sf)
    d = w.groupBy("recording_id").agg(((F.max("win_idx") + 1) * 0.3 + 1.2).alias("duration_seconds"))
    out = diarise.labels_to_segments(w, d, 0.3, 0.6)
    return out.select("recording_id", "seg_no", "speaker_id", F.round("start_time", 6).alias("start_time"), F.round("end_time", 6).alias("end_time"))


# --- containers --------------------------------------------------------------------


def _wav(spark, sf):
    """A WAV header per event; every fourth blob is some other container or text."""
    e = D.table(spark, sf, "events")
    i = F.col("event_id")

    def le(value, n):
        h = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
        return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))])

    rate, ch, data = F.lit(8000) + i % 7 * 1000, i % 2 + 1, (i % 5000) * 4
    txt = lambda s: F.lit(s.encode().hex())
    head = F.concat(
        txt("RIFF"), le(data + 36, 4), txt("WAVEfmt "), le(F.lit(16), 4), le(F.lit(1), 2), le(ch, 2), le(rate, 4),
        le(rate * ch * 2, 4), le(ch * 2, 2), le(F.lit(16), 2), txt("LIST"), le(F.lit(4), 4), txt("INFO"), txt("data"), le(data, 4),
    )
    others = F.array(txt("ID3xxxxxxxxxxx"), txt("fLaCxxxxxxxxxx"), txt("OggSxxxxxxxxxx"), txt("0000ftypM4A xx"), txt("<html></html>x"), txt("RIFF"), F.lit("fff3") )
    other = F.get(others, (D.div(i, 4) % 7).cast("int"))
    return e.select("event_id", F.unhex(F.when(i % 4 == 3, other).otherwise(head)).alias("content"), F.concat(F.lit("/x/f"), i.cast("string"), F.lit(".mp3")).alias("path"))


@query
def audio_sniff(spark, sf):
    return _wav(spark, sf).select("event_id", audio.sniff(F.col("content")).alias("container"))


@query
def wav_metadata(spark, sf):
    return _wav(spark, sf).select("event_id", audio.wav_metadata(F.col("content"), F.col("path")).alias("m")).select(
        "event_id", "m.channels", "m.sample_rate", "m.frames", F.round("m.duration_sec", 6).alias("duration_sec"), "m.format", "m.file_size_bytes"
    )


# --- clustering --------------------------------------------------------------------


def _embedded(spark, sf):
    """Embedding windows with an energy per window."""
    w = D.window_embeddings(spark, sf)
    return w.withColumn("energy", (F.col("vec_id") * 37 % 101 + 1) / 100.0)


def _embedded_durations(spark, sf):
    w = D.window_embeddings(spark, sf)
    return w.groupBy("recording_id").agg(((F.max("win_idx") + 1) * 0.3 + 0.9).alias("duration_seconds"))


@query
def cluster_bisect(spark, sf):
    return cluster.cluster_bisect(D.window_embeddings(spark, sf))


@query
def cluster_average_linkage(spark, sf):
    return cluster.cluster_average_linkage(D.window_embeddings(spark, sf))


@query
def diarise_windows(spark, sf):
    return diarise_plan.diarise_windows(_embedded(spark, sf), _embedded_durations(spark, sf))


@query
def diarise_spectral(spark, sf):
    return diarise_plan.diarise_spectral(_embedded(spark, sf), _embedded_durations(spark, sf))


# --- job history and streams -------------------------------------------------------


def _history(events):
    """Job events with tokens unchecked; large fail values are permanent errors."""
    return events.select(
        "job_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "kind",
        F.lit(None).cast("timestamp").alias("token"),
        (F.col("value") > 150).alias("permanent"),
    )


@query
def job_states(spark, sf):
    return lifecycle.job_states(_history(D.job_events(spark, sf)), stale_seconds=36_000)


def _event_stream(spark, sf):
    schema = D.table(spark, sf, "events").schema
    return D.events_as_jobs(streams.file_stream(spark, sf, "events.parquet", schema))


@query
def stream_job_states(spark, sf):
    out = streams.job_states(_history(_event_stream(spark, sf)), stale_seconds=36_000)
    last = streams.latest(streams.run_to_table(out, spark, "states", "update"), ["job_id"])
    return last.select("job_id", "status", "attempts", "token_us", "updated_us")


@query
def stream_job_states_late(spark, sf):
    """Events arrive in six batches, each up to four days later than another that is older; ids are UUID-like strings."""
    folder = session.shared_dir(spark, "arrivals")
    uuid = F.regexp_replace(F.md5(F.col("job_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    history = _history(D.job_events(spark, sf)).withColumn("job_id", uuid)
    arrival = F.floor((F.dayofmonth("ts") + F.pmod(F.xxhash64("event_id"), F.lit(5))) / 6)
    staged = session.cut(history.withColumn("arrival", arrival), "arrivals")
    for k in range(6):  # files are taken in the order of their times
        staged.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.parquet(f"{folder}/part{k}")
    events = spark.readStream.schema(history.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = streams.job_states(events, stale_seconds=36_000, late="11 days")
    last = streams.latest(streams.run_to_table(out, spark, "states", "update"), ["job_id"])
    return last.select("job_id", "status", "attempts", "token_us", "updated_us")


@query
def stream_rate_limit(spark, sf):
    r = _event_stream(spark, sf).select((F.col("job_id") % 5).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    counts = streams.request_counts(r, limit=5, period_seconds=3600, late="30 days")
    return streams.latest(streams.run_to_table(counts, spark, "rates", "update"), ["client", "period"])


@query
def stream_dedupe(spark, sf):
    e = _event_stream(spark, sf)
    sub = e.select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("ext-"), F.col("job_id").cast("string"))).alias("external_id"))
    kept = streams.run_to_table(streams.dedupe(sub, "60 days"), spark, "dedupe")
    return kept.groupBy("external_id").agg(F.count(F.lit(1)).alias("n"))


def _out_of_order(spark, rows, key, parts=4, last=None):
    """``rows`` as a stream of ``parts`` files in an order that has nothing to do with their times, then ``last`` twice:
    the watermark it raises holds from the batch after it."""
    folder = session.shared_dir(spark, "arrivals")
    staged = session.cut(rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))), "arrivals")
    for k in range(parts):
        staged.where(F.col("_part") == k).drop("_part").coalesce(1).write.parquet(f"{folder}/part{k}")
    for k in (parts, parts + 1) if last is not None else ():
        last.coalesce(1).write.parquet(f"{folder}/part{k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@query
def stream_first_arrival(spark, sf):
    """Which job won each external id, with arrivals out of order."""
    e = D.job_events(spark, sf)
    sub = e.select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("ext-"), F.col("job_id").cast("string"))).alias("external_id"))
    won = streams.run_to_table(streams.first_arrivals(_out_of_order(spark, sub, "job_id")), spark, "first", "update")
    return streams.latest(won, ["external_id"]).select("external_id", "job_id", F.unix_micros("ts").alias("ts_us"))


@query
def stream_jobs_once(spark, sf):
    """Jobs of all events: an id that comes again in a later batch is worked once, by the first batch that has it."""
    e = D.job_events(spark, sf)
    raw = e.select(F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("job_id"), F.lit("a.wav").alias("file_name"), F.lit("").alias("callback_url"), F.lit("2").alias("num_speakers"), "event_id")
    entries = streams.queue_entries(_out_of_order(spark, raw, "event_id").drop("event_id"))
    out = session.shared_dir(spark, "once")
    streams.process_jobs(entries, lambda b: b, out, session.shared_dir(spark, "once-progress")).awaitTermination()
    return spark.read.option("basePath", out).parquet(out).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_status_counts(spark, sf):
    changes = _event_stream(spark, sf).select(F.col("kind").alias("status"))
    return streams.latest(streams.run_to_table(streams.status_counts(changes), spark, "status", "update"), ["status"])


@query
def stream_stage_histogram(spark, sf):
    st = _event_stream(spark, sf).select(F.col("kind").alias("stage"), (F.col("value") / 10.0).alias("seconds"))
    h = streams.latest(streams.run_to_table(streams.stage_counts(st, metrics.BUCKETS), spark, "stages", "update"), ["stage"])
    return h.select("stage", F.posexplode("cumulative").alias("bucket", "cumulative"), "n")


@query
def stream_delivery_results(spark, sf):
    e = _event_stream(spark, sf)
    i = F.col("event_id")
    tries = e.select(
        i.alias("delivery_id"),
        F.lit("https://h.example.com/cb").alias("url"),
        (i % 6).cast("int").alias("attempts"),
        F.when(i % 3 == 0, 200).otherwise(500).alias("outcome_code"),
        F.lit("x").alias("outcome_text"),
        F.col("ts").alias("next_attempt_at"),
        F.array(F.when(i % 10 == 0, "10.0.0.1").otherwise("93.184.216.34")).alias("ips"),
    )
    out = streams.run_to_table(streams.delivery_results(tries, F.col("next_attempt_at")), spark, "deliveries")
    return out.select("delivery_id", "status", "attempts", "next_attempt_at")


def _attempt_tables(spark, sf):
    """An attempt per event and the answers to most of them: every seventh has none, every eleventh one that is too late."""
    e = D.job_events(spark, sf)
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    url = F.concat(F.lit("https://h"), (i % 9).cast("string"), F.lit(".example.com/cb"))
    sent = e.select(i.alias("delivery_id"), (i % 6).cast("int").alias("attempts"), url.alias("url"), ts.alias("sent_at"), ts.alias("next_attempt_at"))
    answered = e.where(i % 7 != 0).select(
        i.alias("delivery_id"),
        (i % 6).cast("int").alias("attempts"),
        F.timestamp_add("SECOND", F.when(i % 11 == 0, 6).otherwise(i % 5).cast("int"), ts).alias("answered_at"),
        F.when(i % 3 == 0, 200).otherwise(503).alias("outcome_code"),
        F.lit("busy").alias("outcome_text"),
    )
    return sent, answered


@query
def delivery_attempts(spark, sf):
    """Attempts met with their answers in batch."""
    met = streams.attempt_outcomes(*_attempt_tables(spark, sf))
    out = jobs.delivery_step(met, F.col("next_attempt_at"), F.lit(True))
    return out.select("delivery_id", "status", "attempts", "next_attempt_at", "error_message")


@query
def stream_delivery_attempts(spark, sf):
    """The same from two streams out of order; a last attempt and answer far ahead let the watermark pass all others."""
    sent, answered = _attempt_tables(spark, sf)
    # The last ones have an id and a try: the join's filter on these would otherwise hide them from the watermark.
    def ahead(df, at):
        key = [F.lit(-1).cast(df.schema[c].dataType).alias(c) for c in ("delivery_id", "attempts")]
        return df.limit(0).unionByName(df.agg(*key, F.timestamp_add("DAY", F.lit(400), F.max(at)).alias(at)), allowMissingColumns=True)

    two = [_out_of_order(spark, df, "delivery_id", last=ahead(df, at)) for df, at in ((sent, "sent_at"), (answered, "answered_at"))]
    stepped = jobs.delivery_step(streams.attempt_outcomes(*two, late="200 days"), F.col("next_attempt_at"), F.lit(True))
    out = streams.run_to_table(stepped, spark, "attempts").where("delivery_id >= 0")
    return out.select("delivery_id", "status", "attempts", "next_attempt_at", "error_message")


@query
def stream_route_outcomes(spark, sf):
    e = _event_stream(spark, sf)
    kind = F.col("kind")
    done = e.select("event_id", (F.col("event_id") % 7).alias("attempts"), F.when(kind == "complete", "COMPLETED").when(kind == "fail", "FAILED").when(kind == "claim", "RETRY").otherwise("SKIPPED").alias("result"))
    out = session.shared_dir(spark, "routes")
    q = streams.route(done, _at(EVENTS_AS_OF), out, session.shared_dir(spark, "routes-progress"))
    q.awaitTermination()
    return spark.read.option("basePath", out).parquet(out).select("event_id", "route", "not_before")


@query
def stream_jobs(spark, sf):
    """Every job of the event stream handled once."""
    e = _event_stream(spark, sf)
    raw = e.select(F.col("event_id").cast("string").alias("job_id"), F.when(F.col("event_id") % 2 == 0, "a.wav").otherwise("").alias("file_name"), F.lit("").alias("callback_url"), (F.col("event_id") % 4).cast("string").alias("num_speakers"))
    out = session.shared_dir(spark, "handled")
    q = streams.process_jobs(streams.queue_entries(raw), lambda b: b.withColumn("gate", F.when(F.col("num_speakers") == 1, "single").otherwise("diarise")), out, session.shared_dir(spark, "handled-progress"))
    q.awaitTermination()
    return spark.read.option("basePath", out).parquet(out).select(F.col("job_id").cast("long").alias("job_id"), "file_name", "gate")
