"""Best-fit packing after dominance reduction (operator 5)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import blocks, map_arrow, payload, written
from voxloom.llm.tokens import encoder, paths

Fill = tuple[tuple[int, int], ...]  # (length, how many) of one sequence
PER_BLOCK = 50_000


class Histogram:
    """How many pieces of each length are left; lengths in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: c for s, c in counts.items() if c}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.remove(size)

    def fits(self, room: int) -> int | None:
        """Largest length of at most ``room``."""
        at = bisect_left(self.sizes, room + 1)
        return self.sizes[at - 1] if at else None

    def smallest(self, n: int) -> int | None:
        """Sum of the ``n`` smallest pieces."""
        total = 0
        for s in self.sizes:
            k = min(n, self.left[s])
            total, n = total + k * s, n - k
            if not n:
                return total
        return None


def best_pair(h: Histogram, room: int) -> int:
    """Largest sum of two different pieces of at most ``room``; 0 if none fit."""
    best, j = 0, len(h.sizes) - 1
    for i, s in enumerate(h.sizes):
        while j >= i and h.sizes[j] + s > room:
            j -= 1
        for k in (j, j - 1):
            if k > i or k == i and h.left[s] > 1:
                best = max(best, h.sizes[k] + s)
                break
        if j < i:
            break
    return best


def reduced(h: Histogram, room: int) -> list[tuple[Fill, int]]:
    """Fixes sequences whose set of pieces dominates all others with their largest piece, many equal ones at once.

    For the largest piece a: alone, if no other fits beside it. With the largest b that fits, if both fill the sequence;
    or if no two others fit beside a; or if no three do and the two that fit best are together no longer than b. In each
    case whatever else could stand beside a may be exchanged for b without using more sequences.
    """
    fixed: list[tuple[Fill, int]] = []
    for a in sorted(h.sizes, reverse=True):
        while h.left.get(a):
            h.left[a] -= 1  # beside one a
            if not h.left[a]:
                h.sizes.remove(a)
            b = h.fits(room - a)
            two, three = h.smallest(2), h.smallest(3)
            alone = b is None
            few = three is None or three > room - a
            pair = not alone and (a + b == room or two is None or two > room - a or few and best_pair(h, room - a) <= b)
            if a not in h.left or not h.left[a]:
                h.left[a] = 0
                insort(h.sizes, a)
            h.left[a] += 1
            if alone:
                n = h.left[a]
                fixed.append((((a, 1),), n))
                h.take(a, n)
            elif pair:
                # equal steps at once while b lasts; the choice doesn't change as only these two counts do,
                # but what fits best beside a may: go on one by one where that decided
                sure = a + b == room or two is None or two > room - a
                n = (h.left[a] // 2 if a == b else min(h.left[a], h.left[b])) if sure else 1
                fixed.append((((a, 2),) if a == b else ((a, 1), (b, 1)), n))
                h.take(a, n * (1 + (a == b)))
                if a != b:
                    h.take(b, n)
            else:
                break
    return fixed


def best_fit(h: Histogram, room: int) -> list[tuple[Fill, int]]:
    """Pieces in descending length, each into the fullest sequence that has room; equal sequences are handled as one."""
    open_at: list[int] = []  # rooms left, ascending
    groups: dict[int, list[tuple[Fill, int]]] = {}
    done: list[tuple[Fill, int]] = []

    def put(fill: Fill, n: int, left: int) -> None:
        if left < (h.sizes[0] if h.sizes else room + 1):
            done.append((fill, n))
            return
        if left not in groups:
            insort(open_at, left)
            groups[left] = []
        groups[left].append((fill, n))

    for size in sorted(h.sizes, reverse=True):
        n = h.left[size]
        h.take(size, n)
        while n:
            at = bisect_left(open_at, size)
            if at < len(open_at):
                left = open_at[at]
                fill, m = groups[left].pop()
                if not groups[left]:
                    del groups[left]
                    open_at.pop(at)
                most = left // size  # as best fit goes on in the same sequence while it stays the fullest
                each = min(most, n)
                used = min(m, n // each)
                if used < m:
                    put(fill, m - used, left)
                put((*fill, (size, each)), used, left - each * size)
                n -= used * each
            else:
                each = min(room // size, n)
                used = n // each
                put(((size, each),), used, room - each * size)
                n -= used * each
    return done + [x for held in groups.values() for x in held]


def plan(counts: dict[int, int], room: int) -> list[tuple[Fill, int]]:
    """Sequences as (pieces by length, how many such), from how often each length occurs."""
    h = Histogram(counts)
    return reduced(h, room) + best_fit(h, room)


class Places:
    """For the k-th piece of each length, its sequence and offset there."""

    def __init__(self, fills: list[tuple[Fill, int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        upto: dict[int, int] = {}
        sequence = 0
        for fill, n in fills:
            offset = 0
            for size, each in fill:
                at = upto.get(size, 0)
                rows.setdefault(size, []).append((at, sequence, each, offset))
                upto[size] = at + n * each
                offset += size * each
            sequence += n
        self.rows = {size: np.array(r, np.int64) for size, r in rows.items()}
        self.sequences = sequence

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            rows = self.rows[int(size)]
            row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
            nth = rank[own] - row[:, 0]
            sequence[own] = row[:, 1] + nth // row[:, 2]
            offset[own] = row[:, 3] + nth % row[:, 2] * size
        return sequence, offset


def pieces(docs: DataFrame, room: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each text's ids and ``end_id``, cut from the back into ``room`` tokens."""
    files = paths(vocabulary)
    lean = docs.select(F.col(id_col).alias("doc_id"), payload(F.col(text_col)).alias("body"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(*files)
        for part in blocks(batches, ["doc_id", "body"], "body"):
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, body in zip(part["doc_id"], part["body"], strict=True):
                ids = np.append(encode.ids(body.decode()), np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % room or room, len(ids) + 1, room)] if len(ids) > room else [0, len(ids)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
            yield out

    return map_arrow(lean, work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, room: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only how often each length occurs (at most ``room`` numbers, whatever the input) goes to the driver, which plans
    sequences for lengths; the pieces of a length are numbered in blocks of bounded size and take their places by
    number. A null or empty text is one piece of the end id alone. Repeated rows and rows without an id are packed
    like others.
    """
    cut = written(pieces(docs, room, id_col, text_col, vocabulary, end_id), "pieces")
    total = cut.count()
    blocked = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, total // PER_BLOCK))))
    sizes = written(blocked.groupBy("length", "_block").agg(F.count("*").alias("_n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = Places(plan(counts, room))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("length").alias("_l"), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_from"))
    order = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = blocked.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(starts, (ranked["length"] == starts["_l"]) & (ranked["_block"] == starts["_b"]))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_from") + F.col("_rank")).alias("rank"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            out["sequence_id"], out["offset"] = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked, work, schema)
