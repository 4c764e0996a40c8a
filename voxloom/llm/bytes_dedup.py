"""Exact removal of repeated byte strings by bounded interval expansion on Burrows-Wheeler transforms (operator 9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import Rolling, map_arrow, sliding_min, union_runs, written
from voxloom.llm.packed import FLAG, body_of, flagged, lean, spans_of, with_spans
from voxloom.llm.suffixes import grouped, refine

LENGTH = 100
GRAM = 16
BREAK = 255  # in no UTF-8 text
BUCKET_BYTES = 1 << 20
PLACE_BITS = np.uint64(28)


def _cutter(length: int, gram: int):
    span = length - gram + 1

    def cut(bodies: list[bytes]) -> tuple:
        data = b"\xff".join(bodies)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        base = np.cumsum(sizes + 1) - sizes - 1
        count = np.maximum(sizes - length + 1, 0)
        none = np.zeros(0, np.int64)
        if not count.sum():
            return data, none, none, none, none, none, none, none.astype(np.uint64)
        grams = Rolling(np.frombuffer(data, np.uint8)).every(gram)
        if not len(grams) < 1 << int(PLACE_BITS):
            raise ValueError("a text is too long for one block")
        place = np.arange(len(grams), dtype=np.uint64)
        mask = np.uint64((1 << int(PLACE_BITS)) - 1)
        # the leftmost least gram: equal strings have it at the same distance from their start
        least = (sliding_min((grams & ~mask) | place, span) & mask).astype(np.int64)
        row = np.repeat(np.arange(len(bodies)), count)
        whole = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - base, count)
        at = least[whole]
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(row) != 0)])
        windows = np.diff(np.r_[head, len(whole)])
        start, anchor = whole[head], at[head]
        return data, row[head], start, start + windows - 1 + length, start - base[row[head]], windows, anchor - start, grams[anchor]

    return cut


def rotations(text: np.ndarray, length: int) -> np.ndarray:
    """Places of ``text``, read as a ring, in the order of the ``length`` or more symbols that follow."""
    n = len(text)
    ring = np.r_[text, np.resize(text, 8)].astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys |= ring[k : n + k] << np.uint64(56 - 8 * k)
    rank, order, active = grouped(keys)
    h = 8
    while h < length and len(active):
        active, _ = refine(rank, order, active, rank[(active + h) % n])
        h *= 2
    return order


def prefix_classes(text: np.ndarray, length: int) -> np.ndarray:
    """Number of each place's class: places with one number are followed by the same ``length`` symbols.

    On the Burrows-Wheeler transform of the ring, two neighbours in the order whose symbols differ share nothing. Two that
    begin with one symbol share one more than the least common prefix between the places their remainders have in the order.
    So prefixes come in increasing value: a level extends backwards, by one symbol, the interval borders found on the
    level before. Borders still unknown when ``length`` is reached share at least that.
    """
    n = len(text)
    order = rotations(text, length)
    transform = text[order - 1]
    onward = np.argsort(transform, kind="stable")  # place in the order of the remainder after the first symbol
    first = text[order]
    fresh = np.flatnonzero(first[1:] != first[:-1]) + 1
    border = np.zeros(n, bool)
    border[0] = True
    border[fresh] = True
    asked = np.flatnonzero(~border)
    low, high = onward[asked - 1], onward[asked]
    newly = np.zeros(n, bool)
    for _ in range(1, length):
        if not len(fresh) or not len(asked):
            break
        newly[fresh] = True
        met = newly[high]
        wide = np.flatnonzero(~met & (high - low > 1))  # several borders in between: is one of them new?
        if len(wide) * 16 > n:
            upto = np.cumsum(newly, dtype=np.int32)
            met[wide] = upto[high[wide]] > upto[low[wide]]
        elif len(wide):
            met[wide] = np.searchsorted(fresh, high[wide], "right") > np.searchsorted(fresh, low[wide], "right")
        newly[fresh] = False
        fresh = asked[met]
        border[fresh] = True
        asked, low, high = asked[~met], low[~met], high[~met]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(border)
    return number


def _may_match(raw: np.ndarray, runs: np.ndarray, start: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Drops runs that share no window with another. Equal windows agree on the anchor and on ``length`` - ``gram`` bytes
    around it, so on half of these before it or on half behind it."""
    half = (length - gram + 1) // 2
    odd = np.random.default_rng(1).integers(0, 2**63, half + gram, np.uint64) * np.uint64(2) + np.uint64(1)
    shared = np.zeros(len(runs), bool)
    at = start + runs["anchor"]
    for first, fits in ((at, runs["anchor"] + gram + half <= runs["bytes"]), (at - half, runs["anchor"] >= half)):
        own = np.flatnonzero(fits)
        if len(own):
            value = (raw[first[own][:, None] + np.arange(half + gram)].astype(np.uint64) * odd).sum(1, dtype=np.uint64)
            _, kind, count = np.unique(value, return_inverse=True, return_counts=True)
            shared[own] |= count[kind] > 1
    return shared


def _finder(length: int, gram: int):
    def find(runs: np.ndarray, data: bytes, start: np.ndarray) -> np.ndarray:
        """Windows that also start earlier, as flags: rows of equal anchors only, each different string once."""
        if len(runs) < 2:
            return np.zeros(0, FLAG)
        raw = np.frombuffer(data, np.uint8)
        cells = raw[(start + runs["anchor"])[:, None] + np.arange(gram)]
        one, two = np.ascontiguousarray(cells[:, :8]).view(np.uint64)[:, 0], np.ascontiguousarray(cells[:, 8:]).view(np.uint64)[:, 0]
        by = np.lexsort((two, one))
        fresh = np.r_[True, (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])]
        group = np.cumsum(fresh) - 1
        picked = np.sort(by[np.bincount(group)[group] > 1])
        runs, start = runs[picked], start[picked]
        sure = _may_match(raw, runs, start, length, gram)
        runs, start = runs[sure], start[sure]
        if not len(runs):
            return np.zeros(0, FLAG)
        priority = np.lexsort((runs["first"], runs["key"], runs["order"]))
        runs, start = runs[priority], start[priority]
        kinds: dict[tuple[bytes, int], int] = {}
        ends = start + runs["bytes"]
        kind = np.fromiter(
            (kinds.setdefault((data[s:e], a), len(kinds)) for s, e, a in zip(start.tolist(), ends.tolist(), runs["anchor"].tolist(), strict=True)),
            np.int64, len(runs),
        )
        leader = np.full(len(kinds), len(runs), np.int64)
        np.minimum.at(leader, kind, np.arange(len(runs)))  # the earliest run of each string
        own = leader[kind]
        same = (runs["order"] == runs["order"][own]) & (runs["key"] == runs["key"][own]) & (runs["first"] == runs["first"][own])
        late = runs[~same]
        follow = np.zeros(len(late), FLAG)
        follow["order"], follow["key"], follow["first"] = late["order"], late["key"], late["first"]
        follow["last"] = late["first"] + late["windows"] - 1

        strings = [string for string, _ in kinds]
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        at = np.cumsum(size + 1) - size - 1
        head = runs[leader]
        place = np.lexsort((head["first"] + head["anchor"].astype(np.int64), head["key"], head["order"]))
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))  # equal windows have their anchor at one distance, so it orders their starts
        count = head["windows"].astype(np.int64)
        owner = np.repeat(np.arange(len(strings)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        number = prefix_classes(text, length)[at[owner] + nth]
        least = np.full(len(text) + 1, len(strings), np.int64)
        np.minimum.at(least, number, rank[owner])
        hit = np.flatnonzero(rank[owner] > least[number])
        if not len(hit):
            return follow
        edge = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])])
        width = np.diff(np.r_[edge, len(hit)])
        found = np.zeros(len(edge), FLAG)
        which = head[owner[hit[edge]]]
        found["order"], found["key"] = which["order"], which["key"]
        found["first"] = which["first"] + nth[hit[edge]]
        found["last"] = found["first"] + width - 1
        return np.concatenate([follow, found])

    return find


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows doc_id, key, body, spans: runs (first, last) of starts of ``length``-byte strings that start earlier as well,
    in a smaller id or further to the front. Strings never cross rows; null, empty and shorter texts have none. A row
    without an id comes after all others; rows equal in id and text count as one and get the same spans."""
    rows = lean(docs, id_col, text_col)
    gram = min(GRAM, length)
    flags = written(flagged(rows, _cutter(length, gram), _finder(length, gram), True, BUCKET_BYTES), "spans")
    return with_spans(rows, flags.distinct())


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for i, body in enumerate(batch.column("body")):
                text = body_of(body)
                first, last = spans_of(batch.column("spans"), i)
                start, end = union_runs(first, last + length)
                digest, at = hashlib.sha256(), 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int((end - start).sum()))
                out["n_spans"].append(len(start))
                out["kept_sha256"].append(digest.hexdigest())
            yield out

    return map_arrow(repeated_bytes(docs, id_col, text_col, length), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
