"""Conversation structure repair: the cheapest edits that make the roles alternate, by run-length dynamic programming.

A row is a symbol: its role's initial (s, u, a or another) and its first fault. An automaton of four states accepts the
wanted initials ``(s?(ua)+)?``; a symbol is a 4 x 4 table of least costs between states (min-plus), insertions before it
included. Equal consecutive symbols are one run, which moves a cost vector by the cached binary powers of its table. The
audit is then unrolled from the left: the least letter that keeps the cost, which gives the ASCII-least of all cheapest.

Rows are range-partitioned and sorted by conversation and turn. Conversations that stand whole inside a task are settled
there. Those that reach a task's edge (two a task at most, among them any large one) are composed from pieces: a table per
piece, costs carried backwards over the pieces, and one forward walk that streams their texts into the digest, which is
sequential by nature. Nothing holds a whole conversation.

Nulls: a null id is one conversation, null turns stand first; for the rest nulls are one space. Rows of the same turn
stand in order of text, then role; equal rows are counted before they are sent. A conversation that lost all rows has zero
counts, an empty audit and the digest of nothing. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import grouped_arrow, map_arrow, small_batches, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
PIECE_ROWS = 1024
HELD_BYTES = 4 << 20
OK, GONE, CUT = 0, 1, 2
USER, ASSISTANT = 2, 3  # states after such a row; 0 nothing yet, 1 after the system row
_PUT = {0: USER, 1: USER, USER: ASSISTANT, ASSISTANT: USER}  # the state that an added or re-roled row leads to
_KEPT = {(0, "s"): 1, (0, "u"): USER, (1, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\v\f\r"
Vector = tuple[int, int, int, int]

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LAST: Vector = (0, 2 * INSERT, INSERT, 0)  # insertions that still end a sequence well


@cache
def _inserted() -> np.ndarray:
    """Least costs of insertions alone between states."""
    table = np.full((4, 4), NEVER, np.int64)
    for start in range(4):
        state, cost = start, 0
        for _ in range(4):
            table[start, state] = min(table[start, state], cost)
            state, cost = _PUT[state], cost + INSERT
    return table


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


@cache
def power(symbol: str, fault: int, k: int) -> tuple[Vector, ...]:
    """The table of ``2 ** k`` rows of one symbol."""
    if k:
        half = np.array(power(symbol, fault, k - 1), np.int64)
        return tuple(tuple(r) for r in times(half, half).tolist())
    step = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        step[state, state] = DELETE
        if fault != GONE:
            more = TRUNCATED if fault == CUT else 0
            step[state, _PUT[state]] = min(step[state, _PUT[state]], REROLE + more)
            if (state, symbol) in _KEPT:
                to = _KEPT[state, symbol]
                step[state, to] = min(step[state, to], KEEP + more)
    return tuple(tuple(r) for r in times(_inserted(), step).tolist())


def before(symbol: str, fault: int, n: int, after: Vector) -> Vector:
    """Costs to the end from before ``n`` equal rows, given those from behind them."""
    k = 0
    while n:
        if n & 1:
            after = tuple(min(c + a for c, a in zip(row, after, strict=True)) for row in power(symbol, fault, k))
        n >>= 1
        k += 1
    return after


def table_of(runs: list[tuple[str, int, int]]) -> np.ndarray:
    """The table of a piece: its runs' powers composed."""
    whole = _identity()
    for symbol, fault, n in runs:
        k = 0
        while n:
            if n & 1:
                whole = times(whole, np.array(power(symbol, fault, k), np.int64))
            n >>= 1
            k += 1
    return whole


def _identity() -> np.ndarray:
    table = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(table, 0)
    return table


def unrolled(runs: list[tuple[str, int, int]], end: Vector, state: int) -> tuple[list[str], list[int], int]:
    """Letters of the ASCII-least cheapest edits of a piece, the state after each, and the last state.

    ``end`` are the costs behind the piece, ``state`` is where it begins. Inside a run the costs go back row by row.
    """
    ends = [end]
    for symbol, fault, n in reversed(runs):
        ends.append(before(symbol, fault, n, ends[-1]))
    ends.reverse()
    letters: list[str] = []
    states: list[int] = []
    for (symbol, fault, n), after in zip(runs, ends[1:], strict=True):
        if fault == GONE:  # an insertion before a deletion is never the lesser one
            letters += "D" * n
            states += [state] * n
            continue
        walk = [after]
        for _ in range(n):
            walk.append(before(symbol, fault, 1, walk[-1]))
        more = TRUNCATED if fault == CUT else 0
        for i in range(n, 0, -1):
            here, behind = walk[i], walk[i - 1]
            while True:
                if here[state] == DELETE + behind[state]:
                    letter = "D"
                elif here[state] == INSERT + here[_PUT[state]]:
                    letter, state = "I", _PUT[state]
                elif (state, symbol) in _KEPT and here[state] == KEEP + more + behind[_KEPT[state, symbol]]:
                    letter, state = "K", _KEPT[state, symbol]
                else:
                    letter, state = "R", _PUT[state]
                letters.append(letter)
                states.append(state)
                if letter != "I":
                    break
    return letters, states, state


class Repair:
    """Rows of one conversation in order, piece by piece, to its counts, audit and digest."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.least = self.most = self.turn = None
        self.initial: str | None = None
        self.state = 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.any = False

    def count(self, turn: int | None, initial: str, fault: str, n: int) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        if self.initial is not None:
            self.illegal += self.initial + initial not in _LEGAL
        self.illegal += n - 1  # no initial may stand beside itself
        self.initial = initial
        if fault:
            setattr(self, fault, getattr(self, fault) + n)

    def put(self, line: str) -> None:
        self.digest.update((("\n" if self.any else "") + line).encode("utf-8", "surrogatepass"))
        self.any = True

    def piece(self, rows: list[tuple], end: Vector) -> None:
        """``rows`` are turn, role, text, copies, first: whether nothing equal stands before."""
        shown: list[tuple[str, int, str, str, int]] = []
        for turn, role, text, n, first in rows:
            if not n:
                continue
            kept = text.rstrip(_SPACE)
            fault = "blank" if not kept else "duplicate" if not first else "truncated" if kept[-1] not in ".!?" else ""
            again = n - 1 if kept and first else 0
            self.count(turn, role[:1], fault, n - again)
            shown.append((role[:1], GONE if fault in ("blank", "duplicate") else CUT if fault else OK, role, text, n - again))
            if again:
                self.count(turn, role[:1], "duplicate", again)
                shown.append((role[:1], GONE, role, text, again))
        runs = [(s if s in ("s", "u", "a") else "-", f, sum(x[4] for x in g)) for (s, f), g in groupby(shown, key=lambda x: x[:2])]
        letters, states, self.state = unrolled(runs, end, self.state)
        at = iter(zip(letters, states, strict=True))
        for _, fault, role, text, n in shown:
            for _ in range(n if fault != GONE else 1):
                letter, state = next(at)
                while letter == "I":
                    self.cost += INSERT
                    self.put(f"{_NAME[state]}:")
                    letter, state = next(at)
                if letter == "D":
                    continue
                self.cost += (REROLE if letter == "R" else KEEP) + (TRUNCATED if fault == CUT else 0)
                self.put(f"{role if letter == 'K' else _NAME[state]}:{text}")
            for _ in range(n - 1 if fault == GONE else 0):
                next(at)
        self.cost += DELETE * letters.count("D")
        self.audit.append("".join(letters))

    def result(self) -> tuple:
        while _LAST[self.state]:
            self.state = _PUT[self.state]
            self.cost += INSERT
            self.audit.append("I")
            self.put(f"{_NAME[self.state]}:")
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of id and turn, as conv_id, turn, role, text and copies (0: dropped)."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced["text"], "[.!?]", "")).otherwise(spaced["text"])
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(spaced["role"]).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Equal rows of an Arrow batch as one with the sum of their copies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                yield from table.group_by(["conv_id", "turn", "role", "text"]).aggregate([("copies", "sum")]).rename_columns(batch.schema.names).to_batches()

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, rows.schema)


def _settled(rows: DataFrame, kind: str) -> DataFrame:
    """Sorted rows to results of conversations inside a task; rows of those at its edges come back with their places."""
    rest = "part long, place long, segment long, turn long, role string, text string, copies long"

    def merged(held: list[tuple]) -> list[tuple]:
        out = []
        seen = set()
        for (turn, role, text), same in groupby(held, key=lambda r: r[:3]):
            n = sum(r[3] for r in same)
            out.append((turn, role, text, n, (role, text) not in seen))
            if n:
                seen.add((role, text))
        return out

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = place = segment = 0
        conv_id, started, spread = None, False, True
        results: list[tuple] = []
        rows: list[tuple] = []

        def shown() -> dict:
            nothing = (None,) * 8
            full = [(*r, *(None,) * 7) for r in results] + [(r[0], *nothing, *r[1:]) for r in rows]
            results.clear(), rows.clear()
            return dict(zip(names, zip(*full, strict=True) if full else [[]] * len(names), strict=True))

        def flush() -> None:
            nonlocal place
            for turn, role, text, copies in held:
                rows.append((conv_id, part, place, segment, turn, role, text, copies))
                place += 1
            held.clear()

        for batch in batches:
            for own, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or own != conv_id:
                    if started and not spread:
                        one = Repair(conv_id)
                        one.piece(merged(held), _LAST)
                        results.append(one.result())
                        held.clear()
                    else:
                        flush()
                    spread = not started  # a task's first conversation may have begun before it
                    conv_id, started, size, segment = own, True, 0, segment + 1
                held.append((turn, role, text, copies))
                size += len(role) + len(text)
                if spread or size > HELD_BYTES:
                    spread = True
                    flush()
            yield shown()
        flush()
        yield shown()

    names = ["conv_id", *(p.split()[0] for p in f"{COUNTS}, {rest}".split(","))]
    return map_arrow(rows, work, f"conv_id {kind}, {COUNTS}, {rest}")


def _faulty(text: Column, first: Column) -> Column:
    kept = F.rtrim(F.translate(text, "\t\n\v\f\r", "     "))
    return F.when((F.length(kept) == 0) | ~first, GONE).when(~F.substring(kept, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK)


def _composed(spread: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that reach over tasks, from pieces of ``PIECE_ROWS`` rows."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = spread.where("copies > 0").groupBy("conv_id", key.alias("_same")).agg(F.min(F.struct("part", "place")).alias("_at"))
    first = first.select(F.col("_at.part").alias("part"), F.col("_at.place").alias("place"), F.lit(True).alias("first"))
    of = F.format_string("%019d %019d %019d", "part", "segment", F.floor(F.col("place") / PIECE_ROWS).cast("long"))  # sorts as numbers do
    rows = spread.join(first, ["part", "place"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    rows = written(rows.withColumn("of", of), "spread")

    slim = rows.where("copies > 0").select(
        "of", "conv_id", "place", "copies", F.substring("role", 1, 1).alias("initial"), _faulty(F.col("text"), F.col("first")).alias("fault")
    )

    def tables(group: pa.Table) -> dict:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("place", "initial", "fault", "copies")), strict=True))
        runs = []
        for _, initial, fault, n in rows:
            symbol = initial if initial in ("s", "u", "a") else "-"
            runs += [(symbol, fault, 1 if fault != GONE else n)] + ([(symbol, GONE, n - 1)] if n > 1 and fault != GONE else [])
        table = table_of([(s, f, sum(r[2] for r in g)) for (s, f), g in groupby(runs, key=lambda r: r[:2])])
        return {"of": [group.column("of")[0].as_py()], "conv_id": [group.column("conv_id")[0].as_py()], "costs": [np.ascontiguousarray(table).tobytes()]}

    def back(group: pa.Table) -> dict:
        costs: Vector = _LAST
        out: dict[str, list] = {"of": [], "behind": []}
        for of, held in sorted(zip(group.column("of").to_pylist(), group.column("costs").to_pylist(), strict=True), reverse=True):
            out["of"].append(of)
            out["behind"].append(np.array(costs, np.int64).tobytes())
            table = np.frombuffer(held, np.int64).reshape(4, 4)
            costs = tuple(np.minimum((table + np.array(costs, np.int64)).min(axis=1), NEVER).tolist())
        return out

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        one: Repair | None = None
        held: list[tuple] = []
        at: tuple | None = None
        done: list[tuple] = []

        def work() -> None:
            if held:
                one.piece(held, tuple(np.frombuffer(at[1], np.int64).tolist()) if at[1] else _LAST)
                held.clear()

        for batch in batches:
            for conv_id, of, behind, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if one is None or conv_id != one.conv_id:
                    work()
                    if one:
                        done.append(one.result())
                    one, at = Repair(conv_id), None
                if (of, behind) != at:
                    work()
                    at = (of, behind)
                held.append((turn, role, text, copies, first))
            yield dict(zip(names, zip(*done, strict=True) if done else [[]] * len(names), strict=True))
            done.clear()
        work()
        if one:
            done.append(one.result())
        yield dict(zip(names, zip(*done, strict=True) if done else [[]] * len(names), strict=True))

    names = ["conv_id", *(p.split()[0] for p in COUNTS.split(","))]
    pieces = grouped_arrow(slim, "of", tables, f"of string, conv_id {kind}, costs binary")
    # One row per piece: what meets here of a conversation is about a thousandth of its rows.
    behind = grouped_arrow(pieces, "conv_id", back, "of string, behind binary")
    rows = rows.join(behind, "of", "left").repartition("conv_id").sortWithinPartitions("conv_id", "of", "place")
    rows = rows.select("conv_id", "of", "behind", "turn", "role", "text", "copies", "first")
    return map_arrow(rows, walk, f"conv_id {kind}, {COUNTS}")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString().replace("bigint", "long")
    if kind not in ("long", "int", "string"):
        conversations, kind = conversations.withColumn("conv_id", F.col("conv_id").cast("string")), "string"
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Prefixes keep what the ranges are sampled from small; rows of one turn with long equal beginnings stay together.
    rows = _counted(damaged(conversations)).repartitionByRange(n, "conv_id", "turn", F.substring("text", 1, 64))
    rows = rows.sortWithinPartitions("conv_id", "turn", "text", "role")
    settled = written(_settled(rows, kind), "conversations")
    names = ["conv_id", *(p.split()[0] for p in COUNTS.split(","))]
    return settled.where("place is null").select(*names).unionByName(_composed(settled.where("place is not null"), kind).select(*names))
