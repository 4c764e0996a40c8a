import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from test_lifecycle import SCHEMA, brute, history
from voxloom.operators import lifecycle
from voxloom.streaming import jobs as S

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def drop(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    from pyspark.sql.types import _parse_datatype_string

    return spark.readStream.schema(_parse_datatype_string(schema)).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_job_states_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for job in range(25) for r in history(rng, job, rng.randint(1, 25))]
    rows.sort(key=lambda r: (r[1], r[2]))
    third = len(rows) // 3
    for i in range(3):
        drop(spark, tmp_path / "in", rows[i * third : None if i == 2 else (i + 1) * third], SCHEMA, f"part{i}")
    out = S.job_states(stream(spark, tmp_path / "in", SCHEMA), late="365 days")
    last = S.latest(S.run_to_table(out, spark, "t-states", "update"), ["job_id"])
    got = {r.job_id: (r.status, r.attempts, r.token_us, r.updated_us) for r in last.collect()}
    assert got == brute(rows)
    batch = lifecycle.job_states(spark.createDataFrame(rows, SCHEMA))
    assert got == {r.job_id: (r.status, r.attempts, r.token_us, r.updated_us) for r in batch.collect()}


def test_late_events_take_their_place(spark, tmp_path):
    """Shuffled within the watermark, with string ids: the result is that of the ordered history; nothing is settled early."""
    rng = random.Random(8)
    rows = [(f"job-{r[0]}", *r[1:]) for job in range(12) for r in history(rng, job, rng.randint(5, 30))]
    schema = SCHEMA.replace("job_id bigint", "job_id string")
    span = max(r[1] for r in rows) - min(r[1] for r in rows)
    jitter = span / 6
    arrival = sorted(rows, key=lambda r: r[1] + jitter * rng.random())
    size = -(-len(rows) // 8)
    for i in range(8):
        drop(spark, tmp_path / "in", arrival[i * size : (i + 1) * size], schema, f"part{i}")
    late = f"{int(jitter.total_seconds() * 1.1) + 1} seconds"
    out = S.run_to_table(S.job_states(stream(spark, tmp_path / "in", schema), late=late), spark, "t-late", "update")
    got = {r.job_id: (r.status, r.attempts, r.token_us, r.updated_us) for r in S.latest(out, ["job_id"]).collect()}
    assert got == brute(rows)


def test_stale_timer_reports_lapsed_claims(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    first = [(1, at(0), 1, "submit", None, False), (1, at(1), 2, "claim", None, False)]
    later = [(2, at(9000), 3, "submit", None, False)]
    last = [(3, at(9001), 4, "submit", None, False)]
    for i, rows in enumerate((first, later, last)):
        drop(spark, tmp_path / "in", rows, SCHEMA, f"part{i}")
    out = S.job_states(stream(spark, tmp_path / "in", SCHEMA), stale_seconds=1800, late="10 seconds", watch_stale=True)
    got = S.run_to_table(out, spark, "t-stale", "update").where("action is not null").collect()
    assert [(r.job_id, r.action) for r in got] == [(1, "reset_republish")]


ENTRY = "job_id string, file_name string, callback_url string, num_speakers string"


def test_restart_handles_every_job_once(spark, tmp_path):
    """A crash in the middle redelivers the batch; finished batches are not repeated."""
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    for i in range(4):
        drop(spark, folder, [(str(100 * i + k), "f.wav", "", "2") for k in range(50)], ENTRY, f"part{i}")
    calls = {"n": 0}

    def flaky(batch):
        calls["n"] += 1
        if calls["n"] == 3:
            raise RuntimeError("lost")
        return batch

    entries = lambda: S.queue_entries(stream(spark, folder, ENTRY))
    with pytest.raises(Exception):
        S.process_jobs(entries(), flaky, out, progress).awaitTermination()
    S.process_jobs(entries(), flaky, out, progress).awaitTermination()
    S.process_jobs(entries(), flaky, out, progress).awaitTermination()
    done = [r.job_id for r in spark.read.parquet(out).collect()]
    assert len(done) == len(set(done)) == 200
    assert spark.read.parquet(out).where("callback_url is not null").count() == 0


def test_ids_of_any_form_and_dead_letters(spark, tmp_path):
    """No entry is lost: string ids are handled, entries without one are dead letters."""
    ids = ["3f2b8c1e-0b7a-4d43-9c1d-5a1f0e6b7a11", "17", "job a", "", None, "17"]
    drop(spark, tmp_path / "in", [(i, "f.wav", f"u{k}", "2") for k, i in enumerate(ids)], ENTRY, "part0")
    out = str(tmp_path / "out")
    S.process_jobs(S.queue_entries(stream(spark, tmp_path / "in", ENTRY)), lambda b: b, out, str(tmp_path / "progress")).awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == sorted({i for i in ids if i})
    assert sorted(r.callback_url for r in spark.read.parquet(f"{out}-dead").collect()) == ["u3", "u4"]


def test_an_id_that_returns_is_worked_once(spark, tmp_path):
    """Three batches later, and after a crash between the output and the ledger of a batch."""
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    batches = [["a", "b"], ["c"], ["d", "b"], ["a", "c", "e"], ["e", "f"]]
    for i, ids in enumerate(batches):
        drop(spark, folder, [(k, f"f{i}.wav", "", "2") for k in ids], ENTRY, f"part{i}")
    calls, real = {"n": 0}, S.cut

    def crash(df, name):
        """The third batch's ids are lost once, after its output could be written."""
        found = real(df, name)
        calls["n"] += 1
        if calls["n"] == 3:
            found.join(found, "job_id").write.mode("overwrite").parquet(f"{out}/batch=2")
            raise RuntimeError("lost")
        return found

    entries = lambda: S.queue_entries(stream(spark, folder, ENTRY))
    S.cut = crash
    try:
        with pytest.raises(Exception):
            S.process_jobs(entries(), lambda b: b, out, progress).awaitTermination()
    finally:
        S.cut = real
    S.process_jobs(entries(), lambda b: b, out, progress).awaitTermination()
    got = sorted((r.job_id, r.file_name) for r in spark.read.parquet(out).collect())
    assert got == [("a", "f0.wav"), ("b", "f0.wav"), ("c", "f1.wav"), ("d", "f2.wav"), ("e", "f3.wav"), ("f", "f4.wav")]


def test_first_arrivals(spark, tmp_path):
    schema = "job_id bigint, external_id string, ts timestamp"
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "x", "y", "z"]), None if i % 17 == 0 else T0 + timedelta(seconds=rng.randint(0, 40))) for i in range(120)]
    for i in range(3):
        drop(spark, tmp_path / "in", rows[i * 40 : (i + 1) * 40], schema, f"part{i}")
    won = S.latest(S.run_to_table(S.first_arrivals(stream(spark, tmp_path / "in", schema)), spark, "t-first", "update"), ["external_id"])
    want = {k: min((t is None, t or T0, j) for j, e, t in rows if e == k)[2] for k in "xyz"}
    assert {r.external_id: r.job_id for r in won.collect()} == want


def test_dedupe(spark, tmp_path):
    schema = "job_id bigint, external_id string, ts timestamp"
    rows = [(i, None if i % 5 == 0 else ("hot" if i % 2 else f"e{i % 7}"), T0 + timedelta(seconds=i)) for i in range(300)]
    for i in range(3):
        drop(spark, tmp_path / "in", rows[i * 100 : (i + 1) * 100], schema, f"part{i}")
    got = S.run_to_table(S.dedupe(stream(spark, tmp_path / "in", schema)), spark, "t-dedupe").collect()
    ids = [r.external_id for r in got]
    assert ids.count(None) == 60 and ids.count("hot") == 1
    assert len([i for i in ids if i]) == len({i for i in ids if i}) == len({r[1] for r in rows if r[1]})


def test_rate_counts(spark, tmp_path):
    schema = "client string, ts timestamp"
    rows = [("a", T0 + timedelta(seconds=i)) for i in range(90)]
    drop(spark, tmp_path / "in", rows, schema, "part0")
    counts = S.request_counts(stream(spark, tmp_path / "in", schema), limit=30)
    got = S.latest(S.run_to_table(counts, spark, "t-rates", "update"), ["client", "period"]).orderBy("period").collect()
    assert [(r.requests, r.rejected) for r in got] == [(60, 30), (30, 0)]


def test_routes(spark, tmp_path):
    schema = "job_id bigint, result string, attempts int"
    rows = [(1, "COMPLETED", 1), (2, "FAILED", 3), (3, "RETRY", 2), (4, "SKIPPED", 0)]
    drop(spark, tmp_path / "in", rows, schema, "part0")
    out = str(tmp_path / "out")
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    S.route(stream(spark, tmp_path / "in", schema), as_of, out, str(tmp_path / "progress")).awaitTermination()
    got = {r.job_id: (r.route, r.not_before) for r in spark.read.option("basePath", out).parquet(out).collect()}
    assert got == {1: ("ack", None), 2: ("dead_letter", None), 3: ("republish", datetime(2024, 1, 1, 0, 0, 2)), 4: ("ack", None)}


def test_attempts_meet_answers_as_in_batch(spark, tmp_path):
    """Answers in time, too late, before the attempt, for another try and missing; both streams out of order."""
    ts = lambda s: T0 + timedelta(seconds=s)
    sent = [("a", 0, ts(0)), ("a", 1, ts(20)), ("b", 0, ts(1)), ("c", 0, ts(2)), ("d", 3, ts(500)), (None, 0, ts(3))]
    told = [("a", 0, ts(5), 200, None), ("a", 1, ts(26), 200, None), ("b", 0, ts(0), 200, None), ("c", 1, ts(3), 200, None), ("d", 3, ts(501), 503, "busy"), (None, 0, ts(3), 200, None)]
    kinds = "delivery_id string, attempts int, sent_at timestamp", "delivery_id string, attempts int, answered_at timestamp, outcome_code int, outcome_text string"
    want = {("a", 0, 200, None), ("a", 1, None, "timeout"), ("b", 0, None, "timeout"), ("c", 0, None, "timeout"), ("d", 3, 503, "busy"), (None, 0, None, "timeout")}
    pick = lambda df: {(r.delivery_id, r.attempts, r.outcome_code, r.outcome_text) for r in df.collect()}
    assert pick(S.attempt_outcomes(*(spark.createDataFrame(r, k) for r, k in zip((sent, told), kinds)))) == want
    end = [("z", 0, ts(90000))], [("z", 0, ts(90000), 200, None)]
    for name, rows, kind, last in zip(("sent", "told"), (sent, told), kinds, end):
        for k, part in enumerate((rows[3:], rows[:3], last, last)):
            drop(spark, tmp_path / name, part, kind, f"part{k}")
    met = S.attempt_outcomes(*(stream(spark, tmp_path / n, k) for n, k in zip(("sent", "told"), kinds)), late="1 hour")
    assert pick(S.run_to_table(met, spark, "t-attempts").where("delivery_id <> 'z' or delivery_id is null")) == want


def test_state_partitions_follow_the_cores(spark, tmp_path):
    """A store for each of many shuffle partitions, or four in a join, cost every batch its time; the session keeps its settings."""
    kinds = "delivery_id long, attempts int, sent_at timestamp", "delivery_id long, attempts int, answered_at timestamp, outcome_code int, outcome_text string"
    drop(spark, tmp_path / "sent", [(1, 0, T0)], kinds[0], "part0")
    drop(spark, tmp_path / "told", [(1, 0, T0, 200, None)], kinds[1], "part0")
    met = S.attempt_outcomes(*(stream(spark, tmp_path / n, k) for n, k in zip(("sent", "told"), kinds)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        query = S.start(met, S.batch_folder(str(tmp_path / "out")), str(tmp_path / "progress"))
        query.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
        assert all(spark.conf.get(key, None) != value for key, value in S.STATE.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    state = query.lastProgress["stateOperators"][0]
    most = S.STORES_PER_CORE * spark.sparkContext.defaultParallelism
    assert state["numShufflePartitions"] <= most and state["numStateStoreInstances"] <= most
