"""Overlapping windows travelling as packed strings, shared by the two exact substring operators.

Consecutive windows of one document that share a minimiser form one string. Strings are packed per map block and bucket
(a hash of the minimiser), so equal windows meet in one bucket wherever their strings begin and end.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import LAST, blocks, bucket_count, grouped_arrow, map_arrow, payload, row_key

#: one string of windows: order of its document, key of its row, first window, number of windows, place of the anchor
RUN = np.dtype([("order", "<i8"), ("key", "<i8"), ("first", "<i8"), ("windows", "<i4"), ("anchor", "<i4"), ("bytes", "<i4")])
#: windows found earlier elsewhere: row, first window and last window
FLAG = np.dtype([("order", "<i8"), ("key", "<i8"), ("first", "<i8"), ("last", "<i8")])


LEVEL = 3


def _columns(rows: np.ndarray) -> bytes:
    """Field by field, the orders as differences: what repeats or grows slowly packs well."""
    return b"".join((np.diff(rows[f], prepend=0) if f in ("order", "key") else rows[f]).tobytes() for f in rows.dtype.names)


def _rows(body: bytes, kind: np.dtype, n: int, at: int) -> tuple[np.ndarray, int]:
    rows = np.zeros(n, kind)
    for f in kind.names:
        cell = np.frombuffer(body, kind[f], n, at)
        rows[f] = np.cumsum(cell) if f in ("order", "key") else cell
        at += cell.nbytes
    return rows, at


def pack(runs: np.ndarray, strings: list[bytes], flags: np.ndarray) -> bytes:
    body = struct.pack("<qq", len(runs), len(flags)) + _columns(runs) + _columns(flags) + b"".join(strings)
    return zstandard.ZstdCompressor(level=LEVEL).compress(body)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<qq", body)
    runs, at = _rows(body, RUN, n, 16)
    flags, at = _rows(body, FLAG, m, at)
    return runs, flags, body[at:]


def order_of(doc_id: int | None) -> int:
    """A row without an id comes after all others."""
    return int(LAST) if doc_id is None else doc_id


Cut = Callable[[list[bytes]], tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def first_runs(part: dict[str, list], cut: Cut, same_document: bool, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed strings of a block of rows, by bucket.

    ``cut`` gives the block's bytes and for each string: row, start and end in the bytes, first window, windows, anchor,
    and minimiser. A string that occurs in the block again is not shipped again: its windows are flagged at once (unless
    they are of the same document and that doesn't count), which is what keeps a passage of a third of all documents
    from becoming a third of all rows in one bucket.
    """
    rank = sorted(range(len(part["key"])), key=lambda i: (order_of(part["doc_id"][i]), part["key"][i]))
    data, row, start, end, first, windows, anchor, minimiser = cut([part["body"][i] for i in rank])
    order = np.array([order_of(part["doc_id"][i]) for i in rank], np.int64)
    key = np.array([part["key"][i] for i in rank], np.int64)
    seen: dict[tuple[bytes, int], int] = {}
    ship: list[int] = []
    strings: list[bytes] = []
    known: list[int] = []
    orders = order[row].tolist()
    identity = list(zip(orders, key[row].tolist(), first.tolist(), strict=True))
    for i, (s, e, a) in enumerate(zip(start.tolist(), end.tolist(), anchor.tolist(), strict=True)):
        string = data[s:e]
        before = seen.setdefault((string, a), i)
        if before == i or not same_document and orders[before] == orders[i]:
            ship.append(i)
            strings.append(string)
        elif identity[before] != identity[i]:  # else a row given twice
            known.append(i)
    picked = np.array(ship, np.int64)
    runs = np.zeros(len(picked), RUN)
    runs["order"], runs["key"] = order[row[picked]], key[row[picked]]
    runs["first"], runs["windows"], runs["anchor"], runs["bytes"] = first[picked], windows[picked], anchor[picked], (end - start)[picked]
    late = np.array(known, np.int64)
    flags = np.zeros(len(late), FLAG)
    flags["order"], flags["key"], flags["first"] = order[row[late]], key[row[late]], first[late]
    flags["last"] = first[late] + windows[late] - 1
    bucket = (minimiser[picked] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0]) if len(by) else np.zeros(0, np.int64)
    parts = np.array_split(flags, max(1, len(edge)))
    for k, at in enumerate(edge):
        to = edge[k + 1] if k + 1 < len(edge) else len(by)
        inside = by[at:to]
        yield int(bucket[by[at]]), pack(runs[inside], [strings[i] for i in inside.tolist()], parts[k])
    if not len(edge) and len(flags):
        yield 0, pack(runs, [], flags)


def joined_runs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """All strings of a bucket: runs, flags passed through, bytes, and where each string starts."""
    got = [unpack(blob.as_py()) for blob in group.column("blob")]
    runs = np.concatenate([g[0] for g in got])
    flags = np.concatenate([g[1] for g in got])
    data = b"".join(g[2] for g in got)
    return runs, flags, data, np.cumsum(runs["bytes"].astype(np.int64)) - runs["bytes"]


def flagged(docs: DataFrame, cut: Cut, find: Callable, same_document: bool, bucket_bytes: int) -> DataFrame:
    """Rows _order, _key, first, last: windows that start earlier elsewhere too. ``docs``: doc_id, key, body."""
    buckets = bucket_count(docs, F.col("body"), bucket_bytes)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for part in blocks(batches, ["doc_id", "key", "body"], "body"):
            held: list[tuple[int, bytes]] = list(first_runs(part, cut, same_document, buckets))
            yield {"bucket": [b for b, _ in held], "blob": [x for _, x in held]}

    def receive(group: pa.Table) -> dict:
        runs, flags, data, start = joined_runs(group)
        out = np.concatenate([flags, find(runs, data, start)])
        return {"_order": out["order"], "_key": out["key"], "first": out["first"], "last": out["last"]}

    sent = map_arrow(docs, send, "bucket long, blob binary")
    return grouped_arrow(sent, "bucket", receive, "_order long, _key long, first long, last long")


def with_spans(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """doc_id, key, body (packed, see ``body_of``) and ``spans``, the pairs (first, last) flagged in the row (null: none)."""

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for part in blocks(batches, ["doc_id", "key", "body"], "body"):
            yield part | {"body": [packer.compress(body) for body in part["body"]]}

    small = map_arrow(docs, squeeze, "doc_id long, key long, body binary")
    packed = flags.groupBy("_order", "_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    order = F.coalesce(F.col("doc_id"), F.lit(int(LAST)))
    return small.join(packed, (small["key"] == packed["_key"]) & (order == packed["_order"]), "left").drop("_order", "_key")


def body_of(cell: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(cell.as_py())


def key_of(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Tells rows of one id apart; where every id is there once, it is 0 throughout."""
    again = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count()
    return row_key(F.col(id_col), F.col(text_col)) if again else F.lit(0).cast("long")


def lean(docs: DataFrame, id_col: str, text_col: str, key: Column | None = None) -> DataFrame:
    """doc_id, key, body."""
    key = key_of(docs, id_col, text_col) if key is None else key
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), payload(F.col(text_col)).alias("body"))


def spans_of(rows: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    cell = rows[i]
    if not cell.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return cell.values.field("first").to_numpy(), cell.values.field("last").to_numpy()
