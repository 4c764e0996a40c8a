"""Job state from an event stream whose events may come out of order.

Per job the store keeps the state of everything up to the watermark, and a list of the later events. What arrives is
merged into the list by (time, event id); what the watermark has passed is folded into the state for good, the rest is
folded on top of it for the row that is emitted. So a late event within the watermark still takes its place, and the last
row of a job equals the batch result. A timer per job settles the list once no event can come before its last one, and
repairs a claim that lapsed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxloom.operators.lifecycle import State, fold
from voxloom.params import DEFAULTS, FAILED, PENDING, PROCESSING

STATE = T.StructType().add("status", "string").add("attempts", "integer").add("token", "long").add("updated", "long")
EVENT = T.StructType().add("us", "long").add("event_id", "long").add("kind", "string").add("token", "long").add("permanent", "boolean")


class JobStates(StatefulProcessor):
    """Folds the events of one job; see the module."""

    def __init__(self, stale_seconds: int, max_attempts: int, watch_stale: bool):
        self.stale_us = stale_seconds * 1_000_000
        self.max_attempts = max_attempts
        self.watch_stale = watch_stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", STATE)
        self.held = handle.getListState("held", EVENT)

    def _folded(self, state: State, events: list[tuple]) -> State:
        for us, _, kind, token, permanent in events:
            state = fold(state, kind, us, token, permanent, self.stale_us, self.max_attempts)
        return state

    def _settle(self, events: list[tuple], watermark_us: int) -> tuple[State, list[tuple]]:
        """The state up to the watermark, stored, and the events that stay held."""
        events.sort(key=lambda e: (e[0], e[1] is not None, e[1] or 0))
        done = sum(e[0] <= watermark_us for e in events)
        stored = self.settled.get()
        state = State(*stored) if stored is not None else State()
        if done:
            state = self._folded(state, events[:done])
            if state.status is not None:
                self.settled.update((state.status, state.attempts, state.token, state.updated))
        if events[done:]:
            self.held.put(events[done:])
        else:
            self.held.clear()
        return state, events[done:]

    def _wake(self, state: State, held: list[tuple], watermark_ms: int, waiting: bool = False) -> None:
        """One timer: when the last held event is settled, or when the claim lapses if that is watched. One that waits for
        events held before (``waiting``) stays, as it comes no later; when it fires, what is still held gets a new one."""
        if waiting and held and not self.watch_stale:
            return
        if waiting or self.watch_stale:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        due = held[-1][0] if held else None
        if self.watch_stale and state.status == PROCESSING:
            due = max(due or 0, state.updated + self.stale_us)
        if due is not None:
            self.handle.registerTimer(max(due // 1000 + 1, watermark_ms + 1))

    def _row(self, key: tuple, state: State, action: str | None) -> Row:
        return Row(job_id=key[0], status=state.status, attempts=state.attempts, token_us=state.token, updated_us=state.updated, action=action)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        events = list(self.held.get())
        waiting = bool(events)
        events += [(r.us, r.event_id, r.kind, r.token, r.permanent) for r in rows]
        state, held = self._settle([tuple(e) for e in events], watermark * 1000)
        state = self._folded(state, held)
        self._wake(state, held, watermark, waiting)
        if state.status is not None:
            yield self._row(key, state, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        state, held = self._settle([tuple(e) for e in self.held.get()], watermark * 1000)
        lapsed = self.watch_stale and not held and state.status == PROCESSING and state.updated + self.stale_us < watermark * 1000
        if lapsed:
            again = state.attempts < self.max_attempts
            state = State(PENDING if again else FAILED, state.attempts + (not again), state.token, watermark * 1000)
            self.settled.update((state.status, state.attempts, state.token, state.updated))
        else:
            # The timer that fired is gone; what is left to wait for gets a new one.
            self._wake(self._folded(state, held), held, watermark)
        if lapsed:
            yield self._row(key, state, "reset_republish" if state.status == PENDING else "fail")

    def close(self) -> None:
        pass


def job_states(
    events: DataFrame,
    stale_seconds: int = DEFAULTS.stale_processing_seconds,
    max_attempts: int = DEFAULTS.max_attempts,
    late: str = "1 hour",
    watch_stale: bool = False,
) -> DataFrame:
    """State per job, emitted whenever its events arrive (columns as ``lifecycle.job_states``, and ``action``).

    Ids are of any type. Events later than ``late`` are dropped, as are events without a time, which have no place in the
    order. With ``watch_stale`` an event-time timer also repairs jobs whose claim lapsed, as the batch sweep does: back to
    PENDING (``action`` reset_republish) while attempts remain, else FAILED (``action`` fail). One job's events within the
    watermark meet in one task; its state is four values.
    """
    typed = events.where("ts is not null").withWatermark("ts", late).select(
        "job_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "kind",
        F.unix_micros("token").alias("token"), F.coalesce("permanent", F.lit(False)).alias("permanent"),
    )
    output = T.StructType([T.StructField("job_id", events.schema["job_id"].dataType)])
    output = output.add("status", "string").add("attempts", "integer").add("token_us", "long").add("updated_us", "long").add("action", "string")
    fold_jobs = JobStates(stale_seconds, max_attempts, watch_stale)
    return typed.groupBy("job_id").transformWithState(fold_jobs, output, "Update", "EventTime")
