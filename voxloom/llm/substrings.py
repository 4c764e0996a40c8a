"""Substring dedup by super-k-mer partitioning (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import LAST, Rolling, map_arrow, mix, sliding_min, unboxed, union_runs, written
from voxloom.llm.packed import FLAG, body_of, flagged, key_of, lean, spans_of, with_spans

WINDOW = 13
SEED_WORDS = 3
BUCKET_BYTES = 1 << 20
SPACE, BREAK = 32, 10


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of single-spaced lines."""
    gap = (data == SPACE) | (data == BREAK)
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    return edge[::2], edge[1::2]


def _cutter(window: int, seed_words: int):
    span = window - seed_words + 1

    def cut(bodies: list[bytes]) -> tuple:
        lines = [b" ".join(body.split()) for body in bodies]
        counts = np.array([line.count(b" ") + 1 if line else 0 for line in lines], np.int64)
        data = b"\n".join(lines)
        start, end = _words(raw := np.frombuffer(data, np.uint8))
        none = np.zeros(0, np.int64)
        if len(start) < window:
            return data, none, none, none, none, none, none, none.astype(np.uint64)
        rolling = Rolling(raw)
        seeds = rolling.of(start[: len(start) - seed_words + 1], end[seed_words - 1 :])
        least = sliding_min(seeds, span)
        doc = np.repeat(np.arange(len(lines)), counts)
        base = np.cumsum(counts) - counts
        whole = np.flatnonzero(doc[: len(least)] == doc[window - 1 :])
        fresh = np.r_[True, (np.diff(whole) != 1) | (least[whole[1:]] != least[whole[:-1]]) | (doc[whole[1:]] != doc[whole[:-1]])] if len(whole) else none.astype(bool)
        head = np.flatnonzero(fresh)
        windows = np.diff(np.r_[head, len(whole)])
        first = whole[head]
        return data, doc[first], start[first], end[first + windows + window - 2], first - base[doc[first]], windows, np.zeros(len(first), np.int64), mix(least[first])

    return cut


def _finder(window: int):
    def find(runs: np.ndarray, data: bytes, start: np.ndarray) -> np.ndarray:
        """Windows whose words also start in a row of smaller order, as flags. Sorting window hashes brings equal windows
        together; the bytes of all that share a hash are compared."""
        if not len(runs):
            return np.zeros(0, FLAG)
        raw = np.frombuffer(data, np.uint8)
        limit = start + runs["bytes"]
        gap = np.zeros(len(raw) + 1, bool)
        gap[:-1] = raw == SPACE
        opening = np.zeros(len(raw) + 1, bool)
        opening[start] = True
        opening[1:] |= gap[:-1]
        closing = gap.copy()
        closing[limit] = True
        begin, close = np.flatnonzero(opening[:-1]), np.flatnonzero(closing)  # the words of all strings
        count = runs["windows"].astype(np.int64)
        word = np.searchsorted(begin, start)
        run = np.repeat(np.arange(len(runs)), count)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        at = word[run] + nth
        s, e = begin[at], close[at + window - 1]
        value = Rolling(raw).of(s, e)
        order = runs["order"][run]
        by = np.argsort(value)
        ordered = value[by]
        fresh = np.r_[True, ordered[1:] != ordered[:-1]]
        edge = np.flatnonzero(fresh)
        lowest, highest = np.minimum.reduceat(order[by], edge), np.maximum.reduceat(order[by], edge)
        group = np.cumsum(fresh) - 1
        late = np.zeros(len(run), bool)
        several = lowest[group] < highest[group]
        asked, kind = by[several], group[several]
        least: dict[tuple[int, bytes], int] = {}
        keys = [(k, data[i:j]) for k, i, j in zip(kind.tolist(), s[asked].tolist(), e[asked].tolist(), strict=True)]
        orders = order[asked].tolist()
        for k, o in zip(keys, orders, strict=True):
            if least.setdefault(k, o) > o:
                least[k] = o
        late[asked] = [o > least[k] for k, o in zip(keys, orders, strict=True)]
        place = np.flatnonzero(late)
        if not len(place):
            return np.zeros(0, FLAG)
        head = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (run[place[1:]] != run[place[:-1]])])
        length = np.diff(np.r_[head, len(place)])
        found = np.zeros(len(head), FLAG)
        r = run[place[head]]
        found["order"], found["key"] = runs["order"][r], runs["key"][r]
        found["first"] = runs["first"][r] + nth[place[head]]
        found["last"] = found["first"] + length - 1
        return found

    return find


def _removed(n_words: int, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return union_runs(first, np.minimum(last + window, n_words))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows doc_id, key, body, spans: runs (first, last) of windows of ``window`` words that also start in a document
    with a smaller id. Windows never cross documents; texts of fewer words, null and empty ones have none. A row without
    an id comes after all others; rows of one id never cover each other."""
    rows = lean(docs, id_col, text_col)
    flags = written(flagged(rows, _cutter(window, min(SEED_WORDS, window)), _finder(window), False, BUCKET_BYTES), "spans")
    return with_spans(rows, flags.distinct())


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_spans (removed runs of words)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "n_spans": []}
            for i, body in enumerate(batch.column("body")):
                words = body_of(body).split()
                start, end = _removed(len(words), *spans_of(batch.column("spans"), i), window)
                kept, at = [], 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out["n_spans"].append(len(start))
            yield out

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"
    return map_arrow(repeated_windows(docs, id_col, text_col, window), work, schema)


def cut_words(text: str, spans: list[int], window: int) -> str:
    """``text`` without the words that windows cover; ``spans`` are first and last windows in turn."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    space = (raw == SPACE) | ((raw >= 9) & (raw <= 13))
    begin = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)) < 0)
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    start, end = _removed(len(begin), pairs[:, 0], pairs[:, 1], window)
    edge = np.r_[begin, len(raw)].tolist()
    kept, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(data[at : edge[s]])
        at = edge[e]
    return b"".join([*kept, data[at:]]).decode()


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the repeated words taken out of ``text`` and n_chars, where there
    is one, counted anew. What stands between kept words stays; a text that loses nothing is unchanged; the row of one
    that loses every word goes."""
    key = key_of(docs, "doc_id", "text")
    flags = flagged(lean(docs, "doc_id", "text", key), _cutter(window, min(SEED_WORDS, window)), _finder(window), False, BUCKET_BYTES)
    packed = written(flags, "spans").groupBy("_order", "_key").agg(F.flatten(F.collect_set(F.array("first", "last"))).alias("_spans"))
    id_, text = F.col("_row.doc_id"), F.col("_row.text")
    keyed = docs.select(F.struct("*").alias("_row"), key.alias("_own"))
    joined = keyed.join(packed, (F.col("_own") == F.col("_key")) & (F.coalesce(id_, F.lit(int(LAST))) == F.col("_order")), "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None else cut_words(t, s, window) for t, s in rows], pa.string())

    hit = F.col("_spans").isNotNull()
    joined = joined.withColumn("_new", cut(F.when(hit, text), "_spans"))
    joined = joined.where(~hit | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.when(hit, F.col("_new")).otherwise(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.char_length("_new")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unboxed(joined, docs, **changed)
