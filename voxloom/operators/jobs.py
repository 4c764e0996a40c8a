"""Job tables: admission, ingest, completion, edits, retention, repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import guards
from voxloom.operators import blocks
from voxloom.params import COMPLETED, DEFAULTS, FAILED, PENDING, PROCESSING, Params
from voxloom.operators.transcripts import failed_payload, ordinals
from voxloom.session import cut

SALTS = 64


def salt(col: str) -> Column:
    """Block column for keys without an order."""
    return F.pmod(F.xxhash64(col), F.lit(SALTS))


def seconds(n: Column | int | float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(n))


def before(as_of: Column, n_seconds: float) -> Column:
    return as_of - seconds(float(n_seconds))


def admit(requests: DataFrame, resolved_ips: str, content_ok: str, **policy) -> DataFrame:
    """Adds ``reason`` (null when accepted) and ``code``."""
    ok = guards.callback_allowed(F.col("callback_url"), F.col(resolved_ips), **policy)
    out = requests.withColumn("reason", guards.reject_reason(ok, F.col(content_ok)))
    return out.withColumn("code", guards.reject_code(F.col("reason")))


def ingest(incoming: DataFrame, existing: DataFrame, arrival: str = "created_at") -> DataFrame:
    """One job per external id: adds ``effective_id`` and ``is_new``.

    An existing job wins, else the first arrival (ties: smallest id). Rows
    without an external id always make a job of their own.
    """
    ext = F.nullif(F.col("external_id"), F.lit(""))
    stored = existing.select(ext.alias("_e"), F.lit(0).alias("_r"), F.col(arrival).alias("_t"), F.col("job_id").alias("_j"))
    fresh = incoming.select(ext.alias("_e"), F.lit(1).alias("_r"), F.col(arrival).alias("_t"), F.col("job_id").alias("_j"))
    winners = (
        stored.unionByName(fresh)
        .where(F.col("_e").isNotNull())
        .groupBy("_e")
        .agg(F.min(F.struct("_r", "_t", "_j")).alias("_w"))
        .select("_e", F.col("_w._j").alias("_win"), (F.col("_w._r") == 1).alias("_new"))
    )
    rows = blocks.attach(incoming.withColumn("_e", ext), winners, ["_e"], salt("job_id"))
    return rows.select(
        *incoming.columns,
        F.coalesce("_win", "job_id").alias("effective_id"),
        (F.col("_e").isNull() | (F.col("_new") & (F.col("_win") == F.col("job_id")))).alias("is_new"),
    )


def backfill(
    source: DataFrame, target: DataFrame, source_utterances: DataFrame, block: Column
) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is absent in the target, and their utterances."""
    new = source.join(target.select("job_id"), "job_id", "left_anti")
    ids = new.select(F.col("job_id").alias("recording_id"))
    return new, blocks.attach(source_utterances, ids, ["recording_id"], block, "left_semi")


def cascade_delete(
    jobs: DataFrame, utterances: DataFrame, deliveries: DataFrame, ids: DataFrame, utterance_block: Column, delivery_block: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the given jobs and everything that depends on them."""
    gone = ids.select("job_id").distinct()
    rec = gone.select(F.col("job_id").alias("recording_id"))
    return (
        jobs.join(gone, "job_id", "left_anti"),
        blocks.attach(utterances, rec, ["recording_id"], utterance_block, "left_anti"),
        blocks.attach(deliveries, gone, ["job_id"], delivery_block, "left_anti"),
    )


def completion_verdicts(jobs: DataFrame, results: DataFrame, arrival: Sequence[Column | str] = ()) -> DataFrame:
    """Adds ``verdict`` to results (job_id, token, ...): applied, already_done, stale or missing.

    Of several results that could be applied to one job the first by ``arrival`` (then by all columns) is; the
    others find it done.

    A result counts only while its job is PROCESSING under the same claim
    token; a null token on either side is not checked. The results of a job are dealt by their content: the first of
    each share is a candidate, the least candidate wins, so no job's results meet in one task.
    """
    state = jobs.select("job_id", F.col("status").alias("_s"), F.col("processing_started_at").alias("_p"))
    same = F.col("token").isNull() | F.col("_p").isNull() | (F.col("token") == F.col("_p"))
    verdict = (
        F.when(F.col("_s").isNull(), "missing")
        .when((F.col("_s") == COMPLETED) & same, "already_done")
        .when((F.col("_s") == PROCESSING) & same, "applied")
        .otherwise("stale")
    )
    judged = results.join(state, "job_id", "left").withColumn("verdict", verdict).drop("_s", "_p")
    order = [*arrival, *[c for c, kind in results.dtypes if not kind.startswith("map")]]
    judged = judged.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    nth = F.row_number().over(Window.partitionBy("job_id", "verdict", "_share").orderBy(*order))
    applied = F.col("verdict") == "applied"
    placed = judged.withColumn("_nth", nth)
    won = placed.where(applied & (F.col("_nth") == 1)).groupBy("job_id").agg(F.min_by("_share", F.struct(*order)).alias("_share"))
    late = applied & (F.col("_won").isNull() | (F.col("_nth") > 1))
    out = placed.join(won.withColumn("_won", F.lit(True)), ["job_id", "_share"], "left")
    return out.withColumn("verdict", F.when(late, "already_done").otherwise(F.col("verdict"))).select(*results.columns, "verdict")


def apply_completions(jobs: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """Jobs after the applied results: COMPLETED, error cleared, language and summary set when given."""
    done = verdicts.where("verdict = 'applied'").select(
        "job_id",
        F.lit(True).alias("_done"),
        F.col("language").alias("_lang"),
        F.col("overlap_summary").alias("_sum"),
    )
    hit = F.col("_done").isNotNull()
    new = {
        "status": F.when(hit, COMPLETED).otherwise(F.col("status")),
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
        "error_message": F.when(~hit, F.col("error_message")),
        "language": F.coalesce(F.nullif("_lang", F.lit("")), "language"),
        "overlap_summary": F.coalesce("_sum", "overlap_summary"),
    }
    rows = jobs.join(done, "job_id", "left")
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def replace_utterances(
    utterances: DataFrame, verdicts: DataFrame, new_utterances: DataFrame, old_block: Column, new_block: Column
) -> DataFrame:
    """Utterances with those of applied jobs replaced."""
    ids = verdicts.where("verdict = 'applied'").select(F.col("job_id").alias("recording_id"))
    kept = blocks.attach(utterances, ids, ["recording_id"], old_block, "left_anti")
    fresh = blocks.attach(new_utterances, ids, ["recording_id"], new_block, "left_semi")
    return kept.unionByName(fresh)


def completion_outbox(jobs: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """One pending delivery per applied result whose job has a callback and whose result a payload."""
    done = verdicts.where("verdict = 'applied' and payload is not null and payload <> ''").select("job_id", "payload")
    return jobs.where("callback_url is not null and callback_url <> ''").join(done, "job_id").select(
        "job_id",
        F.col("callback_url").alias("url"),
        "payload",
        F.lit(0).alias("attempts"),
        as_of.alias("next_attempt_at"),
        F.lit(PENDING).alias("status"),
    )


def list_page(jobs: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """Newest jobs first; at most 100 per page."""
    return jobs.orderBy(F.desc("created_at"), "job_id").offset(skip).limit(min(limit, 100))


def due_deliveries(deliveries: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    due = deliveries.where((F.col("status") == PENDING) & (F.col("next_attempt_at") <= as_of))
    return due.orderBy("next_attempt_at", "delivery_id").limit(limit)


def stale_jobs(jobs: DataFrame, status: str, as_of: Column, stale_seconds: int, limit: int | None = 50) -> DataFrame:
    rows = jobs.where((F.col("status") == status) & (F.col("updated_at") < before(as_of, stale_seconds)))
    return rows if limit is None else rows.orderBy("updated_at", "job_id").limit(limit)


def expired_jobs(jobs: DataFrame, cutoff: Column, statuses: list[str] | None = None, limit: int | None = 100) -> DataFrame:
    rows = jobs.where(F.col("created_at") < cutoff)
    if statuses:
        rows = rows.where(F.col("status").isin(statuses))
    return rows if limit is None else rows.orderBy("created_at", "job_id").limit(limit)


def newest_within(items: DataFrame, order: list[str], max_items: int, max_bytes: int) -> DataFrame:
    """First-in-first-out store: the newest rows (largest ``order``) that fit both caps."""
    run = blocks.range_running(items, [], order, {"_n": F.lit(1).cast("long"), "_b": F.col("size_bytes")}, descending=True)
    return run.where((F.col("_n") <= max_items) & (F.col("_b") <= max_bytes)).select(*items.columns)


def trim_stream(entries: DataFrame, order: list[str], block: Column, max_len: int = DEFAULTS.stream_maxlen) -> DataFrame:
    run = blocks.running(entries, [], [F.desc(o) for o in order], -block, sums={"_n": F.lit(1).cast("long")})
    return run.where(F.col("_n") <= max_len).select(*entries.columns)


def resolve_edits(utterances: DataFrame, edits: DataFrame, tie: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds ``target_id`` to edits given by place or by id; also returns the numbered utterances.

    Edits: edit_no, op (update, delete, add), recording_id, utterance_id, utt_index, speaker_id, text, start_time, end_time.
    """
    numbered = ordinals(utterances, tie)
    place = numbered.select("recording_id", F.col("utt_no").alias("utt_index"), F.col("utterance_id").alias("_by_place"))
    named = edits.join(place, ["recording_id", "utt_index"], "left")
    target = F.when(F.col("op") == "add", F.col("utterance_id")).otherwise(F.coalesce("utterance_id", "_by_place"))
    return cut(named.withColumn("target_id", target).drop("_by_place"), "edits"), numbered


def apply_edits(
    utterances: DataFrame, resolved: DataFrame, jobs: DataFrame, edit_block: Column
) -> tuple[DataFrame, DataFrame]:
    """Edited utterances and the edits that found nothing.

    Places are those before the batch. Updates set speaker and text; the last
    one wins; a deleted utterance stays deleted. An added utterance needs its job.
    """
    keys = ["recording_id", "target_id"]
    changes = (
        resolved.where("op in ('update', 'delete') and target_id is not null")
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("op") == "delete", 1).otherwise(0)).alias("_del"),
            F.max(F.when(F.col("op") == "update", F.struct("edit_no", "speaker_id", "text"))).alias("_up"),
        )
        .withColumnRenamed("target_id", "utterance_id")
    )
    rows = utterances.join(changes, ["recording_id", "utterance_id"], "left").where("coalesce(_del, 0) = 0")
    changed = {
        "speaker_id": F.coalesce("_up.speaker_id", "speaker_id"),
        "text": F.when(F.col("_up").isNotNull(), F.col("_up.text")).otherwise(F.col("text")),
    }
    kept = rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in utterances.columns])
    adds = resolved.where("op = 'add'")
    known = jobs.select(F.col("job_id").alias("recording_id"))
    added = blocks.attach(adds, known, ["recording_id"], edit_block, "left_semi")
    typed = added.select(*[F.col(c) if c in adds.columns else F.lit(None).alias(c) for c in utterances.columns])
    lost_adds = blocks.attach(adds, known, ["recording_id"], edit_block, "left_anti")
    ids = utterances.select("recording_id", F.col("utterance_id").alias("target_id"))
    lost = resolved.where("op <> 'add'").join(ids, keys, "left_anti")
    return kept.unionByName(typed), lost.select("edit_no", "op").unionByName(lost_adds.select("edit_no", "op"))


def retention(
    jobs: DataFrame,
    as_of: Column,
    audio_hours: int = DEFAULTS.audio_retention_hours,
    result_days: int = DEFAULTS.result_retention_days,
) -> tuple[DataFrame, DataFrame]:
    """(manifest of storage URIs to delete with the reason, ids of records to delete). Zero or less switches a rule off."""
    nothing = jobs.where(F.lit(False))
    audio = (
        expired_jobs(jobs, before(as_of, audio_hours * 3600), [COMPLETED, FAILED], None) if audio_hours > 0 else nothing
    )
    old = expired_jobs(jobs, before(as_of, result_days * 86400), None, None) if result_days > 0 else nothing
    uri = F.col("storage_uri").isNotNull() & (F.col("storage_uri") != "")
    manifest = (
        audio.select("job_id", "storage_uri", F.lit("audio").alias("reason"))
        .unionByName(old.select("job_id", "storage_uri", F.lit("record").alias("reason")))
        .where(uri)
    )
    return manifest, old.select("job_id")


def _judged(jobs: DataFrame, as_of: Column, consumer_lag: int | None, params: Params) -> DataFrame:
    """All jobs with the repair that a sweep at ``as_of`` gives them (null: none)."""
    idle = F.col("updated_at")
    pending = (F.col("status") == PENDING) & (idle < before(as_of, params.stale_pending_seconds))
    if consumer_lag is not None and consumer_lag > 0:
        pending = F.lit(False)
    processing = (F.col("status") == PROCESSING) & (idle < before(as_of, params.stale_processing_seconds))
    tries = F.coalesce("attempts", F.lit(0))
    action = (
        F.when(pending, "republish")
        .when(processing & (tries < params.max_attempts), "reset_republish")
        .when(processing, "fail")
    )
    message = F.lit(f"Job processing timed out after {params.stale_processing_seconds}s (stale processing)")
    failed = F.col("action") == "fail"
    return jobs.withColumn("action", action).withColumns(
        {
            "new_status": F.when(failed, FAILED).otherwise(PENDING),
            "new_attempts": F.when(failed, tries + 1).otherwise(tries),
            "_message": F.when(failed, message),
            "dead_letter": failed,
        }
    )


def sweep(jobs: DataFrame, as_of: Column, consumer_lag: int | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Stale jobs with their repair: ``action`` (republish, reset_republish, fail), new status, attempts and time, payload.

    A repaired job counts as touched at ``as_of``, so the next sweep leaves it alone until it is stale again. A job that
    failed notifies its callback, if it has one that isn't blank.
    """
    out = _judged(jobs, as_of, consumer_lag, params).where(F.col("action").isNotNull())
    notify = (F.col("action") == "fail") & (F.trim(F.coalesce("callback_url", F.lit(""))) != "")
    payload = F.when(notify, failed_payload(F.col("new_attempts"), F.col("_message")))
    return out.withColumns({"error_message": F.col("_message"), "updated_at": as_of, "payload": payload}).drop("_message")


def after_sweep(jobs: DataFrame, as_of: Column, consumer_lag: int | None = None, params: Params = DEFAULTS) -> DataFrame:
    """``jobs`` as a sweep leaves them; jobs without a repair are unchanged."""
    hit = F.col("action").isNotNull()
    new = {"status": F.col("new_status"), "attempts": F.col("new_attempts"), "updated_at": as_of, "error_message": F.coalesce("_message", "error_message")}
    judged = _judged(jobs, as_of, consumer_lag, params)
    return judged.select(*[F.when(hit, new[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in jobs.columns])


def route_outcomes(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``route`` (ack, dead_letter, republish) and ``not_before`` for worker outcomes."""
    result = F.col("result")
    return outcomes.withColumns(
        {
            "route": F.when(result == "FAILED", "dead_letter").when(result == "RETRY", "republish").otherwise("ack"),
            "not_before": F.when(
                result == "RETRY", as_of + seconds(guards.worker_backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
            ),
        }
    )


def reclaim(
    pending: DataFrame,
    claimer: str,
    min_idle_ms: int = DEFAULTS.claim_idle_ms,
    max_deliveries: int = DEFAULTS.max_attempts,
) -> DataFrame:
    """Pending stream entries idle long enough go to ``claimer``; too often delivered ones are poison."""
    taken = pending.where(F.col("idle_ms") >= min_idle_ms)
    poison = F.col("delivery_count") >= max_deliveries
    return taken.withColumns(
        {"consumer": F.lit(claimer), "action": F.when(poison, "fail_dead_letter").otherwise("process")}
    )


def delivery_step(
    deliveries: DataFrame, as_of: Column, url_safe: Column, max_attempts: int = DEFAULTS.webhook_max_attempts
) -> DataFrame:
    """State after one attempt; reads attempts, outcome_code, outcome_text (nullable), url, next_attempt_at.

    An attempt without an outcome code raised or timed out; its text is the message.
    """
    tries = F.col("attempts") + 1
    success = F.coalesce(F.col("outcome_code").between(200, 299), F.lit(False))
    dead = tries >= max_attempts
    unsafe = F.concat(F.lit("SSRF Protection: Invalid or unsafe webhook URL '"), "url", F.lit("'"))
    said = F.substring(F.coalesce("outcome_text", F.lit("")), 1, 200)
    answer = F.concat(F.lit("HTTP "), F.col("outcome_code").cast("string"), F.lit(": "), said)
    failure = F.coalesce(answer, F.nullif("outcome_text", F.lit("")))
    later = as_of + seconds(guards.webhook_backoff_seconds(tries).cast("decimal(18,6)"))
    new = {
        "status": F.when(~url_safe, "DEAD").when(success, "SUCCESS").when(dead, "DEAD").otherwise(PENDING),
        "error_message": F.when(~url_safe, unsafe).when(~success, failure),
        "next_attempt_at": F.when(url_safe & ~success & ~dead, later).otherwise(F.col("next_attempt_at")),
        "attempts": tries,
    }
    return deliveries.select(*[c for c in deliveries.columns if c not in new], *[e.alias(n) for n, e in new.items()])


def host_waves(deliveries: DataFrame, per_host: int = DEFAULTS.host_concurrency) -> DataFrame:
    """Adds ``host`` and ``wave``: deliveries of a wave may run at once without exceeding ``per_host``.

    A host's deliveries are numbered by (next_attempt_at, delivery_id), also when a burst of them is due in one second.
    """
    host = F.coalesce(F.nullif(guards.url_netloc(F.col("url")), F.lit("")), F.lit("default"))
    numbered = blocks.range_running(
        deliveries.withColumn("host", host), ["host"], ["next_attempt_at", "delivery_id"], {"_no": F.lit(1).cast("long")}
    )
    return numbered.withColumn("wave", F.floor((F.col("_no") - 1) / per_host)).drop("_no")


def rate_limit(
    requests: DataFrame,
    limit: int = DEFAULTS.rate_limit,
    period_seconds: int = DEFAULTS.rate_period_seconds,
    slices: int = 64,
) -> DataFrame:
    """Verdict per request: counted within (client, fixed period) by arrival.

    Adds ``period`` (epoch period number), ``request_no``, ``code`` and ``retry_after``.
    A period is counted in time slices, so a client's burst is never one task.
    Requests without a client are counted together, as a client of their own.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = period_seconds * 1_000_000
    who = F.coalesce(F.concat(F.lit("="), F.col("client").cast("string")), F.lit(""))
    rows = requests.withColumns({"period": F.floor(micros / width), "_who": who})
    run = blocks.row_numbers(
        rows, ["_who", "period"], ["ts", "event_id"], F.floor((micros % width) / (width / slices)), "request_no"
    )
    over = F.col("request_no") > limit
    return run.drop("_who").withColumns(
        {"code": F.when(over, 429).otherwise(202), "retry_after": F.when(over, F.lit(60))}
    )


def engine_fallback(recordings: DataFrame, runs: DataFrame, segments: DataFrame, engines: list[str]) -> tuple[DataFrame, DataFrame]:
    """First engine in order with at least one segment, per recording.

    ``runs`` lists raised attempts: (recording_id, engine). ``segments`` are
    tagged by engine. Returns (winner per recording, skip log with reason and next engine).
    """
    place = F.array_position(F.array(*[F.lit(e) for e in engines]), F.col("engine")) - 1
    raised = runs.select("recording_id", place.alias("p")).distinct()
    found = segments.select("recording_id", place.alias("p")).distinct()
    good = found.where(F.col("p") >= 0).join(raised, ["recording_id", "p"], "left_anti")
    best = good.groupBy("recording_id").agg(F.min("p").alias("_w"))
    names = F.array(*[F.lit(e) for e in engines], F.lit("None"))
    winners = recordings.select("recording_id").join(best, "recording_id", "left")
    tried = winners.select("recording_id", "_w", F.explode(F.sequence(F.lit(0), F.lit(len(engines) - 1))).alias("p")).where(
        F.col("_w").isNull() | (F.col("p") < F.col("_w"))
    )
    log = tried.join(raised.withColumn("_x", F.lit(True)), ["recording_id", "p"], "left").select(
        "recording_id",
        F.get(names, F.col("p")).alias("from_engine"),
        F.get(names, F.col("p") + 1).alias("to_engine"),
        F.when(F.col("_x"), "exception").otherwise("empty_result").alias("reason"),
    )
    return winners.select("recording_id", F.get(names, F.col("_w").cast("int")).alias("engine")), log


def winning_segments(segments: DataFrame, winners: DataFrame, block: Column) -> DataFrame:
    """Segments of the engine that won each recording."""
    keys = ["recording_id", "engine"]
    return blocks.attach(segments, winners.where("engine is not null"), keys, block, "left_semi")
