"""Fixed-stride shards of token ids in a keyed random order (operator 7)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm import files
from voxloom.llm.common import LAST, blocks, bounded, grouped_arrow, map_arrow, mix, payload, written
from voxloom.llm.tokens import END, encoder, paths
from voxloom.session import shared_dir

MAGIC = b"SLOT"
HEAD = "<4sIQQ"  # magic, tokens of a record, first slot, records
RECORD = "<qiI"  # document, piece, tokens used
SLOTTED = "<qqiI"  # slot and the same, on the way to its shard
HEAD_BYTES, RECORD_BYTES, SLOTTED_BYTES = struct.calcsize(HEAD), struct.calcsize(RECORD), struct.calcsize(SLOTTED)
SHARD_RECORDS = 8192
TOGETHER = 4  # shards written by one task: few, long strings on the way pack better than many short ones
RUN = 2048  # pieces that are coded or decoded at once
SAMPLE_ROWS, SAMPLE_CHARS = 500, 4096  # what the order of the short codes is taken from


class ShortIds:
    """16-bit numbers as one to three bytes on the way, those that ``order`` names first the shortest: seven bits a byte, the
    last byte of each below 128. Any order of all numbers gives them back as they were."""

    def __init__(self, order: np.ndarray):
        self.order = order.astype("<u2")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.n = 1 + (rank >= 1 << 7) + (rank >= 1 << 14)
        self.bytes = np.stack([rank >> 7 * k & 127 | np.where(self.n > k + 1, 128, 0) for k in range(3)], 1).astype(np.uint8)

    def pieces(self, ids: np.ndarray, stride: int) -> list[bytes]:
        """Of every ``stride`` numbers."""
        n = self.n[ids]
        data = self.bytes[ids][np.arange(3) < n[:, None]].tobytes()
        ends = np.cumsum(n)[np.minimum(np.arange(stride, len(ids) + stride, stride), len(ids)) - 1].tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def back(self, data: bytes) -> bytes:
        """The numbers of joined pieces, two bytes each."""
        part = np.frombuffer(data, np.uint8)
        end = np.flatnonzero(part < 128)
        n = np.diff(end, prepend=-1)
        rank = part[end].astype(np.int32)
        for k in (1, 2):
            more = n > k
            rank[more] = rank[more] << 7 | part[end[more] - k] & 127
        return self.order[rank].tobytes()


def frequent_first(docs: DataFrame, text_col: str, source: tuple) -> np.ndarray:
    """All numbers, those frequent in the beginnings of a few texts first. It sets only how many bytes the ids take on the way."""
    some = docs.select(payload(F.substring(F.col(text_col), 1, SAMPLE_CHARS)).alias("body")).limit(SAMPLE_ROWS).collect()
    encode = encoder(*source)
    counts = np.zeros(1 << 16, np.int64)
    counts[END] = len(some)
    for row in some:
        counts += np.bincount(np.asarray(encode.ids(bytes(row.body).decode()), np.int64), minlength=1 << 16)
    return np.argsort(-counts, kind="stable")


def permuted(index: np.ndarray, total: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 … total - 1: a balanced Feistel network over the next even number of bits; a value
    outside walks on along its cycle until it is inside, which takes under four steps on average."""
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key % 2**64))
    value = index.astype(np.uint64)
    going = np.arange(len(value))
    while len(going):
        left, right = value[going] >> half, value[going] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        value[going] = (left << half) | right
        going = going[value[going] >= np.uint64(total)]
    return value.astype(np.int64)


def sequences(docs: DataFrame, stride: int, id_col: str, text_col: str, source: tuple, codes: ShortIds) -> DataFrame:
    """Rows doc_id, piece, n_tokens, ids: each text's ids and the end id in pieces of up to ``stride`` numbers, coded."""
    lean = docs.select(F.col(id_col).alias("doc_id"), payload(F.col(text_col)).alias("body"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(*source)
        for part in blocks(batches, ["doc_id", "body"], "body", 2 << 20):
            out: dict[str, list] = {"doc_id": [], "piece": [], "n_tokens": [], "ids": []}
            for doc_id, body in zip(part["doc_id"], part["body"], strict=True):
                ids = np.append(encode.ids(body.decode()), np.uint32(END)).astype("<u2")
                for at in range(0, len(ids), RUN * stride):
                    out["ids"] += codes.pieces(ids[at : at + RUN * stride], stride)
                for k in range(-(-len(ids) // stride)):
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["n_tokens"].append(min(stride, len(ids) - k * stride))
            yield out

    return map_arrow(lean, work, "doc_id long, piece int, n_tokens int, ids binary")


def materialise(
    docs: DataFrame, folder: str, stride: int = 512, key: int = 42, shard_records: int = SHARD_RECORDS,
    id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k",
) -> DataFrame:
    """Writes all sequences below ``folder`` in training order; returns shard, path, first_slot, n_records, bytes, crc32.

    Every sequence has a number without gaps; the keyed permutation makes it a slot; shard s holds the slots from
    s * ``shard_records`` on, a record each of the same size, in order of slot. A reader resumes at slot t by opening shard
    t // shard_records at the byte of record t % shard_records. Shards are written whole and moved into place, so a
    repeated task changes nothing. Null and empty texts are a sequence of the end id; a null id is written as the largest number.
    """
    spark = docs.sparkSession
    vocabulary_paths = paths(vocabulary)
    codes = ShortIds(frequent_first(docs, text_col, vocabulary_paths))
    source = shared_dir(spark, "sequences")
    packed = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
    sequences(docs, stride, id_col, text_col, vocabulary_paths, codes).write.options(**packed).parquet(source)
    made = spark.read.parquet(source).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))

    # numbers without gaps: the rows of the files before, and the row in its own file
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(made.groupBy("file").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    starts = sizes.select(F.col("file").alias("_file"), F.coalesce(before, F.lit(0)).alias("_from"))
    starts = bounded(starts, sizes.count())
    dealt = made.join(starts, made["file"] == starts["_file"]).select("doc_id", "piece", "n_tokens", "ids", (F.col("_from") + F.col("nth")).alias("index"))
    size = RECORD_BYTES + 2 * stride

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        packer = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            slot = permuted(batch.column("index").to_numpy(), total, key)
            part = slot // (shard_records * TOGETHER)
            by = np.argsort(part, kind="stable")
            columns = [batch.column(name) for name in ("doc_id", "piece", "n_tokens", "ids")]
            for same in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
                for own in np.array_split(same, -(-len(same) // RUN)) if len(same) else ():
                    rows = [struct.pack(SLOTTED, slot[i], LAST if (d := columns[0][i].as_py()) is None else d, columns[1][i].as_py(), columns[2][i].as_py()) for i in own.tolist()]
                    body = b"".join(rows) + b"".join(columns[3][i].as_py() for i in own.tolist())
                    yield {"part": [part[own[0]]], "blob": [packer.compress(struct.pack("<q", len(own)) + body)]}

    def write(group: pa.Table) -> dict:
        part = group.column("part")[0].as_py()
        begin = part * shard_records * TOGETHER
        out = bytearray(min(shard_records * TOGETHER, total - begin) * size)
        for blob in group.column("blob"):
            body = zstandard.ZstdDecompressor().decompress(blob.as_py())
            n = struct.unpack_from("<q", body)[0]
            ids = codes.back(body[8 + n * SLOTTED_BYTES :])
            at = 0
            for slot, doc_id, piece, used in struct.iter_unpack(SLOTTED, body[8 : 8 + n * SLOTTED_BYTES]):
                record = struct.pack(RECORD, doc_id, piece, used) + ids[at : at + 2 * used]
                out[(slot - begin) * size : (slot - begin) * size + len(record)] = record
                at += 2 * used
        made: dict[str, list] = {"shard": [], "path": [], "first_slot": [], "n_records": [], "bytes": [], "crc32": []}
        for first in range(begin, begin + len(out) // size, shard_records):
            records = memoryview(out)[(first - begin) * size : (first - begin + shard_records) * size]
            head = struct.pack(HEAD, MAGIC, stride, first, len(records) // size)
            shard = first // shard_records
            path = f"{folder}/shard-{shard:08d}.bin"
            files.put(path, lambda stream, head=head, records=records: (stream.write(head), stream.write(records)))
            row = (shard, path, first, len(records) // size, len(head) + len(records), zlib.crc32(records, zlib.crc32(head)))
            for name, value in zip(made, row, strict=True):
                made[name].append(value)
        return made

    sent = map_arrow(dealt, place, "part long, blob binary")
    return written(grouped_arrow(sent, "part", write, "shard long, path string, first_slot long, n_records long, bytes long, crc32 long"), "shards")


def read_shards(manifest: DataFrame, from_slot: int = 0) -> DataFrame:
    """Rows doc_id, piece, slot, shard, offset, n_tokens, ids_crc32 of the shards, from a slot on, read back from the files.

    A shard whose head or length doesn't agree with the manifest is an error.
    """
    wanted = manifest.where(F.col("first_slot") + F.col("n_records") > from_slot).select("shard", "path", "first_slot", "n_records", "bytes")
    tasks = max(1, wanted.count())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.get(row["path"]) as source:
                    magic, stride, first, n = struct.unpack(HEAD, source.read(HEAD_BYTES))
                    size = RECORD_BYTES + 2 * stride
                    if (magic, first, n, HEAD_BYTES + n * size) != (MAGIC, row["first_slot"], row["n_records"], row["bytes"]):
                        raise ValueError(f"{row['path']}: head or length is wrong")
                    skip = max(0, from_slot - first)
                    source.seek(HEAD_BYTES + skip * size)
                    out: dict[str, list] = {"doc_id": [], "piece": [], "slot": [], "shard": [], "offset": [], "n_tokens": [], "ids_crc32": []}
                    for k in range(skip, n):
                        record = source.read(size)
                        doc_id, piece, used = struct.unpack_from(RECORD, record)
                        out["doc_id"].append(None if doc_id == LAST else doc_id)
                        out["piece"].append(piece)
                        out["slot"].append(first + k)
                        out["shard"].append(row["shard"])
                        out["offset"].append(HEAD_BYTES + k * size)
                        out["n_tokens"].append(used)
                        out["ids_crc32"].append(zlib.crc32(record[RECORD_BYTES : RECORD_BYTES + 2 * used]))
                    yield out

    schema = "doc_id long, piece int, slot long, shard long, offset long, n_tokens long, ids_crc32 long"
    return map_arrow(wanted.repartition(tasks, "shard"), work, schema)


def training_order(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Shards in a new shared folder, read back."""
    return read_shards(materialise(docs, shared_dir(spark, "order"), **options))
