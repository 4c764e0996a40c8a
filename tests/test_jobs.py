import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxloom.operators import blocks, intervals, jobs, metrics, transcripts
from voxloom.sources import contracts, tables

NOW = datetime(2024, 5, 1, 12)
JOBS = "job_id bigint, external_id string, file_name string, storage_uri string, status string, attempts int, created_at timestamp_ntz, updated_at timestamp_ntz, callback_url string"


def at(**kw):
    return NOW - timedelta(**kw)


def now():
    return F.lit(str(NOW)).cast("timestamp_ntz")


def make(spark, rows):
    return spark.createDataFrame(rows, JOBS)


def test_ingest(spark):
    row = lambda i, ext, h: (i, ext, "a.wav", "u", "PENDING", 0, at(hours=h), at(hours=h), None)
    old = make(spark, [row(1, "x", 9)])
    new = make(spark, [row(2, "x", 5), row(3, "y", 4), row(4, "y", 3), row(5, None, 2), row(6, None, 2), row(7, "", 1)])
    got = {r.job_id: (r.effective_id, r.is_new) for r in jobs.ingest(new, old).collect()}
    assert got == {2: (1, False), 3: (3, True), 4: (3, False), 5: (5, True), 6: (6, True), 7: (7, True)}


def test_fencing(spark):
    a, b = at(hours=2), at(hours=1)
    state = spark.createDataFrame([(1, "PROCESSING", b), (2, "PROCESSING", None), (3, "COMPLETED", a), (4, "PENDING", None)], "job_id bigint, status string, processing_started_at timestamp_ntz")
    results = spark.createDataFrame([(1, a), (1, b), (1, None), (2, a), (3, a), (3, b), (4, None), (9, a)], "job_id bigint, token timestamp_ntz")
    got = sorted((r.job_id, str(r.token), r.verdict) for r in jobs.completion_verdicts(state, results).collect())
    assert got == sorted([
        (1, str(a), "stale"), (1, str(b), "already_done"), (1, "None", "applied"), (2, str(a), "applied"), (3, str(a), "already_done"),
        (3, str(b), "stale"), (4, "None", "stale"), (9, str(a), "missing")])


def test_retention(spark):
    row = lambda i, status, h: (i, None, "a", f"disk://{i}", status, 0, at(hours=h), at(hours=h), None)
    df = make(spark, [row(1, "COMPLETED", 48), row(2, "COMPLETED", 1), row(3, "PENDING", 48), row(4, "PENDING", 24 * 40)])
    manifest, gone = jobs.retention(df, now())
    assert {(r.job_id, r.reason) for r in manifest.collect()} == {(1, "audio"), (4, "record")}
    assert [r.job_id for r in gone.collect()] == [4]
    manifest, gone = jobs.retention(df, now(), 0, 0)
    assert manifest.count() == 0 and gone.count() == 0


def test_sweep(spark):
    row = lambda i, status, tries, s, url: (i, None, "f.wav", "u", status, tries, at(seconds=s), at(seconds=s), url)
    df = make(spark, [row(1, "PENDING", 0, 400, None), row(2, "PENDING", 0, 200, None), row(3, "PROCESSING", 1, 2000, None),
                      row(4, "PROCESSING", 3, 2000, "https://x"), row(5, "PROCESSING", 3, 100, None), row(6, "COMPLETED", 0, 9999, None)])
    got = {r.job_id: (r.action, r.new_status, r.new_attempts) for r in jobs.sweep(df, now(), 0).collect()}
    assert got == {1: ("republish", "PENDING", 0), 3: ("reset_republish", "PENDING", 1), 4: ("fail", "FAILED", 4)}
    assert 1 not in {r.job_id for r in jobs.sweep(df, now(), 5).collect()}
    payload = jobs.sweep(df, now()).where("job_id = 4").first().payload
    assert payload == '{"job_id":"4","file_name":"f.wav","status":"FAILED","attempts":4,"error_message":"Job processing timed out after 1800s (stale processing)"}'


def test_delivery_dies_at_the_last_attempt(spark):
    df = spark.createDataFrame([(1, "https://h/x", 0, 500, "no"), (2, "https://h/x", 0, 204, None), (3, "https://h/x", 4, 500, "z" * 300)], "delivery_id bigint, url string, attempts int, outcome_code int, outcome_text string").withColumn("next_attempt_at", now())
    got = {r.delivery_id: r for r in jobs.delivery_step(df, now(), F.lit(True)).collect()}
    assert (got[1].status, got[1].attempts, got[1].next_attempt_at) == ("PENDING", 1, NOW + timedelta(seconds=5))
    assert (got[2].status, got[2].error_message) == ("SUCCESS", None)
    assert (got[3].status, len(got[3].error_message)) == ("DEAD", len("HTTP 500: ") + 200)
    assert jobs.delivery_step(df, now(), F.lit(True), max_attempts=1).where("delivery_id = 1").first().status == "DEAD"
    assert jobs.delivery_step(df, now(), F.lit(False)).where("delivery_id = 2").first().status == "DEAD"


def test_rows_without_client_or_start_stay(spark):
    requests = spark.sql("select id as event_id, timestamp'2024-01-01' as ts, if(id % 2 = 0, null, 'a') as client from range(6)")
    got = {r.event_id: (r.client, r.request_no, r.code) for r in jobs.rate_limit(requests, 2).collect()}
    assert got == {i: (None if i % 2 == 0 else "a", i // 2 + 1, 429 if i >= 4 else 202) for i in range(6)}
    utterances = spark.createDataFrame([(1, 5.0, 1), (1, None, 2), (1, None, 3), (1, -700.0, 4)], "recording_id bigint, start_time double, seq int")
    got = {r.seq: r.utt_no for r in transcripts.ordinals(utterances, ["seq"]).collect()}
    assert got == {2: 0, 3: 1, 4: 2, 1: 3}


def test_rate_limit_counts_bursts_in_order(spark):
    base = datetime(2024, 1, 1)
    rows = [(i, "c", base + timedelta(milliseconds=700 * i)) for i in range(120)] + [(500, "d", base)]
    df = spark.createDataFrame(rows, "event_id bigint, client string, ts timestamp_ntz")
    got = {r.event_id: (r.request_no, r.code, r.retry_after) for r in jobs.rate_limit(df, 30).collect()}
    for i in range(120):
        n = i - (86 if i >= 86 else 0) + 1
        assert got[i] == (n, 429 if n > 30 else 202, 60 if n > 30 else None)
    assert got[500] == (1, 202, None)


def test_store_caps(spark):
    rows = [(i, at(minutes=100 - i), size) for i, size in enumerate([5, 1, 1, 9, 2, 2])]
    df = spark.createDataFrame(rows, "job_id bigint, created_at timestamp_ntz, size_bytes bigint")
    block = blocks.block_of("job_id", 2)
    ids = lambda n, b: sorted(r.job_id for r in jobs.newest_within(df, ["job_id"], n, b).collect())
    assert ids(3, 100) == [3, 4, 5]
    assert ids(10, 13) == [3, 4, 5]
    assert ids(10, 12) == [4, 5]
    assert sorted(r.job_id for r in jobs.trim_stream(df, ["job_id"], block, 4).collect()) == [2, 3, 4, 5]


def test_engine_fallback(spark):
    rec = spark.createDataFrame([(1,), (2,), (3,)], "recording_id bigint")
    segs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "recording_id bigint, engine string")
    raised = spark.createDataFrame([(1, "a"), (2, "b")], "recording_id bigint, engine string")
    win, log = jobs.engine_fallback(rec, raised, segs, ["a", "b", "c"])
    assert {r.recording_id: r.engine for r in win.collect()} == {1: "b", 2: "c", 3: None}
    assert {tuple(r) for r in log.collect()} == {
        (1, "a", "b", "exception"), (2, "a", "b", "empty_result"), (2, "b", "c", "exception"),
        (3, "a", "b", "empty_result"), (3, "b", "c", "empty_result"), (3, "c", "None", "empty_result")}
    assert metrics.fallback_counts(log).where("from_engine = 'a' and reason = 'empty_result'").first().n == 2


def test_table_round_trip(spark, tmp_path):
    df = make(spark, [(1, "x", "a.wav", "u", "PENDING", 0, at(hours=1), at(hours=1), None), (2, None, "b.wav", "u", "FAILED", 3, at(hours=1), at(hours=1), None)])
    tables.write_table(df, str(tmp_path / "jobs"), contracts.JOBS)
    back = tables.read_table(spark, str(tmp_path / "jobs"), contracts.JOBS)
    assert back.schema == contracts.JOBS
    pending = back.where("status = 'PENDING'")
    assert [r.job_id for r in pending.collect()] == [1]
    assert "PartitionFilters: [isnotnull(status" in pending._jdf.queryExecution().executedPlan().toString()


def test_tables_and_contracts_with_string_ids(spark, tmp_path):
    uuid = "0b1e6f0c-6f0e-4a57-9d3b-0a6a4c1f2d3e"
    schema = contracts.with_string_ids(contracts.JOBS)
    tables.write_table(spark.createDataFrame([(uuid, "PENDING")], "job_id string, status string"), str(tmp_path / "named"), schema)
    assert [(r.job_id, r.status) for r in tables.read_table(spark, str(tmp_path / "named"), schema).collect()] == [(uuid, "PENDING")]
    segs = spark.createDataFrame([(uuid, 0, "A", 0.0, 1.0)], "recording_id string, seg_no bigint, speaker_id string, start_time double, end_time double")
    assert contracts.check_rows(segs, contracts.SEGMENTS).first().n == 1
    with pytest.raises(TypeError):
        contracts.check_schema(segs.withColumn("seg_no", F.lit("x")), contracts.SEGMENTS)


def test_contracts(spark):
    good = spark.createDataFrame([(1, 0, "A", 0.0, 1.0), (1, 1, None, 2.0, 1.0)], "recording_id bigint, seg_no int, speaker_id string, start_time double, end_time double")
    row = contracts.check_rows(good, contracts.SEGMENTS).first()
    assert (row.n, row.null_keys, row.reversed) == (2, 1, 1)
    with pytest.raises(TypeError):
        contracts.check_schema(good.drop("speaker_id"), contracts.SEGMENTS)
    with pytest.raises(TypeError):
        contracts.check_schema(good.withColumn("start_time", F.lit("x")), contracts.SEGMENTS)


def test_second_result_of_a_job_finds_it_done(spark):
    job_rows = spark.createDataFrame([(1, "PROCESSING", None)], "job_id bigint, status string, processing_started_at timestamp")
    results = spark.createDataFrame([(1, None, "a", 2), (1, None, "b", 1), (2, None, "c", 3)], "job_id bigint, token timestamp, payload string, at int")
    got = {r.payload: r.verdict for r in jobs.completion_verdicts(job_rows, results, ["at"]).collect()}
    assert got == {"b": "applied", "a": "already_done", "c": "missing"}


def test_equal_results_of_a_job_are_applied_once(spark):
    """A job with many results, some of them equal in every column, is completed by one row, the least."""
    job_rows = spark.createDataFrame([(1, "PROCESSING", None)], "job_id bigint, status string, processing_started_at timestamp")
    results = spark.range(2000).selectExpr("1L job_id", "cast(null as timestamp) token", "concat('p', id div 4) payload", "if(id < 8, null, int(id div 8)) at")
    out = jobs.completion_verdicts(job_rows, results, ["at"])
    assert out.columns == ["job_id", "token", "payload", "at", "verdict"]
    got = out.groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"applied": 1, "already_done": 1999}
    won = out.where("verdict = 'applied'").first()
    assert (won["at"], won.payload) == (None, "p0")


def test_bodies_are_whole_whatever_the_pages(spark):
    """A body holds all utterances in order, its summary and pairs; a record without any has none of them."""
    rec = spark.createDataFrame([(1, 1, 'a"b.wav', "tr"), (2, 2, None, None)], "recording_id bigint, job_id bigint, file_name string, language string")
    said = [(1, f"u{i:02}", "S", None if i == 7 else float(i // 3), 30.0, f'say "{i}"\n') for i in range(25)]
    u = spark.createDataFrame(said, "recording_id bigint, utterance_id string, speaker_id string, start_time double, end_time double, text string")
    segs = spark.createDataFrame([(1, i, "AB"[i % 2], float(i), i + 1.5) for i in range(9)], "recording_id bigint, seg_no bigint, speaker_id string, start_time double, end_time double")
    known = intervals.overlap_summary(rec.where("job_id = 1").withColumn("effective_duration", F.lit(20.0)), intervals.overlap_totals(segs))
    pairs = intervals.overlap_pairs(segs)
    for rows in (4, 10_000):
        pages = intervals.overlap_pages(pairs, rows)
        out = transcripts.completed_bodies(rec, u, known, pages, ["utterance_id"], rows)
        got = {r.job_id: json.loads(r.payload) for r in out.collect()}
        assert [x["text"] for x in got[1]["utterances"]] == [x[5] for x in sorted(said, key=lambda x: (x[3] is not None, x[3] or 0, x[1]))]
        assert (got[1]["file_name"], got[1]["language"], got[1]["status"]) == ('a"b.wav', "tr", "COMPLETED")
        s = got[1]["overlap_summary"]
        assert (s["total_overlap_seconds"], s["interrupt_count"], s["overlap_percentage"]) == (4.0, 8, 20.0)
        assert [x["start_time"] for x in s["overlaps"]] == [float(i) for i in range(1, 9)]
        assert got[2] == {"job_id": "2", "file_name": None, "status": "COMPLETED", "language": None, "overlap_summary": None, "utterances": []}
