"""Job state from its event history.

``fold`` is the rule for one event; the stream keeps it as state per job. The
batch form reaches the same state without folding a job's events in one task:
what follows an accepted claim depends on that claim alone, so every claim is
linked to its successor with ordered lookups, chains of takeovers are followed
by pointer doubling, and at most ``max_attempts`` hops over failures remain.

Events: job_id, ts, event_id, kind (submit, claim, heartbeat, complete, fail),
token (time of the claim it belongs to, null = unchecked), permanent (fail only).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.operators.cluster import follow_to_root
from voxloom.params import BLOCK_ROWS, COMPLETED, DEFAULTS, FAILED, PENDING, PROCESSING
from voxloom.session import cut

JOB = ["job_id"]
DAY = 86_400_000_000


@dataclass
class State:
    status: str | None = None
    attempts: int = 0
    token: int | None = None
    updated: int | None = None


def fold(
    s: State,
    kind: str,
    ts: int,
    token: int | None,
    permanent: bool,
    stale_us: int = DEFAULTS.stale_processing_seconds * 1_000_000,
    max_attempts: int = DEFAULTS.max_attempts,
) -> State:
    """State after one event; times in microseconds."""
    if kind == "submit":
        return State(PENDING, 0, None, ts) if s.status is None else s
    if kind == "claim":
        lapsed = s.status == PROCESSING and ts - s.updated > stale_us
        return State(PROCESSING, s.attempts, ts, ts) if s.status == PENDING or lapsed else s
    if s.status != PROCESSING or (token is not None and token != s.token):
        return s
    if kind == "heartbeat":
        return State(s.status, s.attempts, s.token, ts)
    if kind == "complete":
        return State(COMPLETED, s.attempts, s.token, ts)
    tries = s.attempts + 1
    final = permanent or tries >= max_attempts
    return State(FAILED if final else PENDING, tries, s.token, ts)


def _next_seq(rows: DataFrame, name: str, what: Column, block_rows: int) -> DataFrame:
    """Adds the smallest later-or-equal ``seq`` for which ``what`` holds."""
    return blocks.running(
        rows,
        JOB,
        [F.desc("seq")],
        -blocks.block_of("seq", block_rows),
        lasts={name: F.when(what, F.col("seq"))},
    )


def _numbered(events: DataFrame, block_rows: int) -> DataFrame:
    """Events after the first submission, numbered per job; tokens become claim numbers (-1: no such claim)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select(
        *JOB,
        us.alias("us"),
        "event_id",
        "kind",
        F.unix_micros(F.col("token").cast("timestamp")).alias("token"),
        F.coalesce("permanent", F.lit(False)).alias("permanent"),
    )
    day = blocks.block_of("us", DAY)
    e = blocks.row_numbers(e, JOB, ["us", "event_id"], day, "seq")
    first = e.where("kind = 'submit'").groupBy(*JOB).agg(F.min("seq").alias("_s"))
    e = cut(blocks.attach(e, first, JOB, blocks.block_of("seq", block_rows), "inner"), "events")
    live = e.where("seq > _s and kind <> 'submit'").drop("_s")
    claims = live.where("kind = 'claim'").groupBy(*JOB, F.col("us").alias("token")).agg(F.min("seq").alias("_t"))
    # Events of one claim share its token; the claim's own block of tokens keeps the join spread out.
    live = blocks.attach(live, claims, [*JOB, "token"], blocks.block_of("seq", block_rows))
    tok = F.when(F.col("token").isNotNull(), F.coalesce("_t", F.lit(-1)))
    return live.withColumn("tok", tok).drop("_t", "token")


def _links(live: DataFrame, stale_us: int, block_rows: int) -> DataFrame:
    """What ends each claim, were it accepted: (job_id, seq, us, how, end_seq, end_us, permanent, next_claim, beat)."""
    kind, tok = F.col("kind"), F.col("tok")
    ends = kind.isin("complete", "fail")
    rows = _next_seq(live, "open_end", ends & tok.isNull(), block_rows)
    rows = cut(_next_seq(rows, "next_claim", kind == "claim", block_rows), "next")
    seen = blocks.running(
        rows,
        JOB,
        ["seq"],
        blocks.block_of("seq", block_rows),
        lasts={"beat": F.when((kind == "heartbeat") & tok.isNull(), F.col("us"))},
    )
    seen = cut(seen, "beats")
    claims = seen.where("kind = 'claim'").select(*JOB, "seq", "us", "open_end", "beat")
    mine = seen.where("tok >= 0 and seq > tok")
    own_end = mine.where(ends).groupBy(*JOB, F.col("tok").alias("seq")).agg(F.min("seq").alias("own_end"))

    # Each claim and each of its own heartbeats keeps it alive until the next own heartbeat or the stale limit.
    alive = claims.select(*JOB, F.col("seq").alias("tok"), "seq", "us").unionByName(
        mine.where("kind = 'heartbeat'").select(*JOB, "tok", "seq", "us")
    )
    spans = blocks.running(
        alive, [*JOB, "tok"], ["seq"], blocks.block_of("seq", block_rows), nexts={"until": F.col("seq")}
    )
    probes = spans.select(*JOB, (F.col("us") + stale_us).alias("at"), F.lit(1).alias("p"), "tok", "until", F.lit(None).cast("bigint").alias("taker"))
    ready = claims.where(F.col("beat").isNull() | (F.col("us") - F.col("beat") > stale_us))
    takers = ready.select(
        *JOB,
        F.col("us").alias("at"),
        F.lit(0).alias("p"),
        F.lit(None).cast("bigint").alias("tok"),
        F.lit(None).cast("bigint").alias("until"),
        F.col("seq").alias("taker"),
    )
    order = [F.desc("at"), F.desc("p"), F.desc("taker")]
    found = blocks.running(
        probes.unionByName(takers), JOB, order, -blocks.block_of("at", DAY), lasts={"by": F.col("taker")}
    )
    over = found.where((F.col("p") == 1) & F.col("by").isNotNull() & (F.col("until").isNull() | (F.col("by") < F.col("until"))))
    taken = over.groupBy(*JOB, F.col("tok").alias("seq")).agg(F.min("by").alias("taken"))

    linked = claims.join(own_end, [*JOB, "seq"], "left").join(taken, [*JOB, "seq"], "left")
    end = F.least("open_end", "own_end")
    takeover = F.col("taken").isNotNull() & (F.col("taken") < F.coalesce(end, F.lit(2**62)))
    linked = linked.select(
        *JOB, "seq", "us", F.when(takeover, F.col("taken")).alias("taken"), F.when(~takeover, end).alias("end_seq")
    )
    facts = rows.where(ends).select(
        *JOB, F.col("seq").alias("end_seq"), F.col("us").alias("end_us"), F.col("kind").alias("end_kind"), "permanent", "next_claim"
    )
    return linked.join(facts, [*JOB, "end_seq"], "left")


def job_states(
    events: DataFrame,
    stale_seconds: int = DEFAULTS.stale_processing_seconds,
    max_attempts: int = DEFAULTS.max_attempts,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Final state per submitted job: job_id, status, attempts, token_us, updated_us."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    jobs = events.where("kind = 'submit'").groupBy(*JOB).agg(F.min(F.struct(us.alias("us"), "event_id"))["us"].alias("submitted"))
    live = cut(_numbered(events, block_rows), "live")
    links = cut(_links(live, stale_seconds * 1_000_000, block_rows), "links")
    roots = follow_to_root(
        cut(links.select(*JOB, F.col("seq").alias("cid"), F.coalesce("taken", "seq").alias("parent")), "parents"), JOB
    )
    holder = roots.select(*JOB, F.col("cid").alias("seq"), F.col("parent").alias("holder"))
    nodes = holder.join(
        links.select(*JOB, F.col("seq").alias("holder"), F.col("us").alias("token"), "end_us", "end_kind", "permanent", "next_claim"),
        [*JOB, "holder"],
    )
    nodes = cut(nodes, "nodes")
    # One row per job walks over its failures: ``at`` is the claim to accept next.
    first = live.where("kind = 'claim'").groupBy(*JOB).agg(F.min("seq").alias("at"))
    walk = jobs.join(first, "job_id", "left").select(
        *JOB,
        "at",
        F.lit(PENDING).alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("bigint").alias("token_us"),
        F.col("submitted").alias("updated_us"),
        F.lit(None).cast("bigint").alias("holder"),
    )
    hop = nodes.withColumnsRenamed({"seq": "at", "holder": "_h"})
    for _ in range(max_attempts):
        here = walk.join(hop, [*JOB, "at"], "left")
        moved, failed = F.col("_h").isNotNull(), F.col("end_kind") == "fail"
        tries = F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts"))
        dead = failed & (F.col("permanent") | (tries >= max_attempts))
        status = F.when(F.col("end_kind").isNull(), PROCESSING).when(~failed, COMPLETED).when(dead, FAILED).otherwise(PENDING)
        walk = here.select(
            *JOB,
            F.when(moved & failed & ~dead, F.col("next_claim")).alias("at"),
            F.when(moved, status).otherwise(F.col("status")).alias("status"),
            F.when(moved, tries).otherwise(F.col("attempts")).alias("attempts"),
            F.when(moved, F.col("token")).otherwise(F.col("token_us")).alias("token_us"),
            F.when(moved, F.coalesce("end_us", "token")).otherwise(F.col("updated_us")).alias("updated_us"),
            F.coalesce("_h", "holder").alias("holder"),
        )
    # A job still in progress was last seen at its latest accepted heartbeat.
    beats = live.where("kind = 'heartbeat'")
    any_beat = beats.where("tok is null").groupBy(*JOB).agg(F.max("us").alias("_any"))
    own_beat = beats.where("tok is not null and seq > tok").groupBy(*JOB, F.col("tok").alias("holder")).agg(F.max("us").alias("_own"))
    out = walk.join(any_beat, "job_id", "left").join(own_beat, [*JOB, "holder"], "left")
    latest = F.greatest("updated_us", "_any", "_own")
    return out.select(
        *JOB,
        "status",
        F.col("attempts").cast("int").alias("attempts"),
        "token_us",
        F.when(F.col("status") == PROCESSING, latest).otherwise(F.col("updated_us")).alias("updated_us"),
    )
