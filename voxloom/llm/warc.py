"""Zstandard WARC archives: writer and frame-by-frame reader (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import IO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import files
from voxloom.llm.common import blocks, map_arrow, payload, written
from voxloom.session import shared_dir

# Fixed values of the two formats.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 2 << 20, 64 << 10
CHUNK = 1 << 20


class WarcError(ValueError):
    """An archive, frame or record that doesn't hold what it says."""


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body, usedforsecurity=False).digest()).decode()


def record(page_id: int, url: str | None, body: bytes, own: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record: the HTTP head and the payload, which a revisit leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%s" % (len(body), END)
    block = http if refers_to is not None else http + body
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("X-Page-Id", str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{own}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _line(refers_url)), ("X-Refers-To-Page-Id", str(refers_to))]
        fields.append(("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + END


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def dictionary(bodies: list[bytes]) -> bytes:
    """Trained on at most ``DICTIONARY_SAMPLE`` bytes of an archive's first records; empty if these are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, bodies, threads=0).as_bytes() if len(bodies) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archive(out: IO, records: Iterable[bytes]) -> int:
    """The dictionary in a leading skippable frame, then a frame per record. Returns the records."""
    held: list[bytes] = []
    total, rest = 0, iter(records)
    for one in rest:
        held.append(one)
        total += len(one)
        if total >= DICTIONARY_SAMPLE:
            break
    trained = dictionary([one[: 64 << 10] for one in held])
    stored = zstandard.ZstdCompressor().compress(trained) if trained else b""
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(stored)) + stored)
    options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    compress = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **options).compress
    n = 0
    for source in (held, rest):
        for one in source:
            out.write(compress(one))
            n += 1
    return n


def frames(source: IO) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time; the leading skippable frame gives the dictionary."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise WarcError("the leading frame is not a dictionary frame")
    stored = source.read(size)
    if len(stored) < size:
        raise WarcError("the dictionary is cut off")
    options = {}
    if stored:
        plain = zstandard.ZstdDecompressor().decompress(stored) if stored[:4] == zstandard.FRAME_HEADER else stored
        options["dict_data"] = zstandard.ZstdCompressionDict(plain)
    decoder = zstandard.ZstdDecompressor(**options)
    left = source.read(CHUNK)
    while left:
        one, out = decoder.decompressobj(), io.BytesIO()
        while True:
            try:
                out.write(one.decompress(left))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if one.eof:
                left = one.unused_data or source.read(CHUNK)
                break
            left = source.read(CHUNK)
            if not left:
                raise WarcError("the last frame is cut off")
        yield out.getvalue()


def parsed(frame: bytes) -> dict:
    """Fields of the record in a frame, after its head, lengths and digests were checked."""
    head, found, rest = frame.partition(END)
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", VERSION):
        raise WarcError("no record head")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"bad field: {name[:60]}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise WarcError(f"missing {', '.join(sorted(missing))}")
    if not fields["content-length"].isdigit():
        raise WarcError("bad length")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != END:
        raise WarcError("the block's length is not as stated")
    if fields.get("warc-block-digest", "") not in ("", f"sha1:{digest(block)}"):
        raise WarcError("the block's digest is not as stated")
    http, _, body = block.partition(END)
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    own = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if length not in (None, len(body)):
            raise WarcError("the payload's length is not as stated")
        if own and own != digest(body):
            raise WarcError("the payload's digest is not as stated")
    elif fields["warc-type"] == "revisit" and body:
        raise WarcError("a revisit with a payload")
    return {"fields": fields, "payload": body, "payload_bytes": length if length is not None else len(body), "payload_digest": own}


def _squeezed(pages: DataFrame) -> DataFrame:
    """page_id, url, n_bytes, digest and the packed payload of each row (page_id, url, body)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        packer = zstandard.ZstdCompressor(level=3)
        for part in blocks(batches, ["page_id", "url", "body"], "body"):
            bodies = part.pop("body")
            yield part | {"n_bytes": [len(b) for b in bodies], "digest": [digest(b) for b in bodies], "packed": [packer.compress(b) for b in bodies]}

    return map_arrow(pages, work, "page_id long, url string, n_bytes long, digest string, packed binary")


def referred(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows of ``_squeezed`` with refers_to and refers_url: of equal payloads of at least ``least_bytes`` the one with the
    largest page_id is the response (all its rows, if repeated), others refer to it."""
    large = pages.where(F.col("n_bytes") >= least_bytes)
    top = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top")).where("top.page_id is not null")
    top = top.select(F.col("digest").alias("_digest"), F.col("top.page_id").alias("_top"), F.col("top.url").alias("_url"))
    joined = pages.join(top, (pages["digest"] == top["_digest"]) & (pages["n_bytes"] >= least_bytes), "left")
    other: Column = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    return joined.select("page_id", "url", "packed", "digest", F.when(other, F.col("_top")).alias("refers_to"), F.when(other, F.col("_url")).alias("refers_url"))


def write_warcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes an archive per task below ``folder``; returns path, n_records and bytes of each. Null html is an empty payload."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload(F.col(html_col)).alias("body"))
    spread = referred(_squeezed(rows), least_bytes).repartition(F.xxhash64("page_id", "digest"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId() if context else 0:06d}.warc.zst"
        count: list[int] = []

        def records(first: pa.RecordBatch) -> Iterator[bytes]:
            yield from one_batch(first)
            for batch in source:
                yield from one_batch(batch)

        def one_batch(batch: pa.RecordBatch) -> Iterator[bytes]:
            columns = [batch.column(c) for c in ("page_id", "url", "packed", "digest", "refers_to", "refers_url")]
            for page, url, packed, own, refers, refers_url in zip(*columns, strict=True):
                body = unpack(packed.as_py())
                yield record(page.as_py(), url.as_py(), body, own.as_py(), refers.as_py(), refers_url.as_py())

        source, unpack = iter(batches), zstandard.ZstdDecompressor().decompress
        head = next((b for b in source if b.num_rows), None)
        if head is None:
            yield {"path": [], "n_records": []}
            return
        files.put(path, lambda out: count.append(write_archive(out, records(head))))
        yield {"path": [path], "n_records": [count[-1]]}

    return map_arrow(spread, work, "path string, n_records long")


def read_warcs(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """One row per record of the archives at ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Archives are read in parallel, one frame in memory at a time. A record with a wrong head, length or digest is an error
    that names the archive.
    """
    wanted = archives.select(F.col(path_col).alias("path"))
    tasks = max(1, 2 * wanted.count())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def number(text: str | None) -> int | None:
        return None if text in (None, "None") else int(text)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with files.get(path) as source:
                    try:
                        for frame in frames(source):
                            one = parsed(frame)
                            f = one["fields"]
                            rows.append((number(f.get("x-page-id")), f.get("warc-target-uri"), one["payload_bytes"], one["payload_digest"], f["warc-type"], number(f.get("x-refers-to-page-id"))))
                            if len(rows) == 1000:
                                yield {n: [r[i] for r in rows] for i, n in enumerate(names)}
                                rows = []
                    except WarcError as e:
                        raise WarcError(f"{path}: {e}") from e
                yield {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_arrow(wanted.repartition(tasks, "path"), work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of all pages in a new shared folder, read back. Empty tables give no rows; null ids are kept."""
    return read_warcs(written(write_warcs(pages, shared_dir(spark, "warc"), least_bytes=least_bytes), "archives"))
