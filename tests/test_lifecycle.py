import random
from datetime import datetime, timedelta, timezone

from voxloom.operators import lifecycle as L

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "job_id bigint, ts timestamp, event_id bigint, kind string, token timestamp, permanent boolean"


def us(t):
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def brute(rows, stale=1800, max_attempts=3):
    out = {}
    for job, ts, _, kind, token, perm in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = out.get(job, L.State())
        out[job] = L.fold(s, kind, us(ts), us(token) if token else None, bool(perm), stale * 1_000_000, max_attempts)
    return {k: (s.status, s.attempts, s.token, s.updated) for k, s in out.items() if s.status}


def batch(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.job_id: (r.status, r.attempts, r.token_us, r.updated_us) for r in L.job_states(df, **kw).collect()}


def history(rng, job, n, tokens=True):
    rows, claims, at = [], [], 0
    for i in range(n):
        at += rng.choice([1, 60, 600, 1500, 1900, 4000])
        kind = rng.choice(["submit"] + ["claim"] * 4 + ["heartbeat"] * 4 + ["complete"] * (i > n * 0.6) + ["fail"])
        ts = T0 + timedelta(seconds=at)
        token = None
        if kind == "claim":
            claims.append(ts)
        elif tokens and claims and rng.random() < 0.7:
            token = rng.choice(claims[-3:]) if rng.random() < 0.95 else T0
        rows.append((job, ts, job * 1000 + i, kind, token if kind != "submit" else None, rng.random() < 0.05))
    return rows


def test_batch_equals_fold(spark):
    rng = random.Random(7)
    rows = []
    for job in range(150):
        rows += history(rng, job, rng.randint(1, 40), tokens=job % 3 != 0)
    assert batch(spark, rows) == brute(rows)
    assert batch(spark, rows, block_rows=3, stale_seconds=700, max_attempts=2) == brute(rows, 700, 2)


def test_fencing(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        (1, at(0), 1, "submit", None, False),
        (1, at(10), 2, "claim", None, False),
        (1, at(5000), 3, "claim", None, False),
        (1, at(5010), 4, "complete", at(10), False),
        (1, at(5020), 5, "fail", at(10), False),
    ]
    assert batch(spark, rows)[1][:2] == ("PROCESSING", 0)
    rows.append((1, at(5030), 6, "complete", at(5000), False))
    assert batch(spark, rows)[1][:2] == ("COMPLETED", 0)


def test_retries_until_failed(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(1, at(0), 0, "submit", None, False), (2, at(0), 0, "submit", None, False)]
    for i in range(3):
        rows += [(1, at(10 + 20 * i), 2 * i + 1, "claim", None, False), (1, at(20 + 20 * i), 2 * i + 2, "fail", None, False)]
        got = batch(spark, rows)[1]
        assert got[:2] == ("FAILED" if i == 2 else "PENDING", i + 1)
    rows += [(2, at(10), 1, "claim", None, False), (2, at(20), 2, "fail", None, True)]
    assert batch(spark, rows)[2][:2] == ("FAILED", 1)
