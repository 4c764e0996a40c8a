"""Audio container checks on binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(content: Column, offset: int | Column, size: int) -> Column:
    start = F.lit(offset + 1) if isinstance(offset, int) else (offset + 1).cast("int")
    return F.substring(content, start, F.lit(size))


def _is(content: Column, offset: int | Column, magic: bytes) -> Column:
    return _at(content, offset, len(magic)) == F.lit(magic)


def sniff(content: Column) -> Column:
    """Container by magic bytes: WAV, MP3, FLAC, OGG, M4A; null if none or under 12 bytes."""
    sync = F.lit(False)
    # MPEG frame headers.
    for magic in (b"\xff\xfb", b"\xff\xf2", b"\xff\xf3", b"\xff\xe3"):
        sync = sync | _is(content, 0, magic)
    return F.when(
        F.length(content) >= 12,
        F.when(_is(content, 0, b"RIFF") & _is(content, 8, b"WAVE"), "WAV")
        .when(_is(content, 0, b"ID3") | sync, "MP3")
        .when(_is(content, 0, b"fLaC"), "FLAC")
        .when(_is(content, 0, b"OggS"), "OGG")
        .when(_is(content, 4, b"ftyp"), "M4A"),
    )


def little_endian(raw: Column) -> Column:
    """Unsigned number from up to four little-endian bytes."""
    pair = lambda i: F.substring(F.hex(raw), F.lit(2 * i + 1), F.lit(2))
    return F.conv(F.concat(pair(3), pair(2), pair(1), pair(0)), 16, 10).cast("bigint")


def _walk(content: Column, name: bytes, steps: Column) -> Column:
    """Offset of a RIFF chunk within the first ``steps`` chunks; null if it is not there."""
    size = lambda at: F.coalesce(little_endian(_at(content, at + 4, 4)), F.lit(0))
    step = lambda at, _: F.when(
        _is(content, at, name) | (at + 8 > F.length(content)), at
    ).otherwise(at + 8 + F.floor((size(at) + 1) / 2) * 2)
    found = F.aggregate(F.sequence(F.lit(1), steps), F.lit(12).cast("bigint"), step)
    return F.when(_is(content, found, name), found)


def _chunk(content: Column, name: bytes) -> Column:
    """The chunk is nearly always among the first few; only otherwise is every chunk of the file (8 bytes or more) walked."""
    most = F.greatest(F.lit(1), F.floor(F.length(content) / 8).cast("int"))
    return F.coalesce(_walk(content, name, F.lit(4)), _walk(content, name, most))


def wav_metadata(content: Column, path: Column) -> Column:
    """Struct of channels, sample_rate, frames, duration_sec, format, file_size_bytes.

    Anything but PCM WAV gets one channel, 16 kHz, no duration and its upper-case extension.
    """
    riff = _is(content, 0, b"RIFF") & _is(content, 8, b"WAVE")
    places = F.struct(
        F.when(riff, _chunk(content, b"fmt ")).alias("fmt"), F.when(riff, _chunk(content, b"data")).alias("data")
    )
    num = lambda base, off, size: little_endian(_at(content, base + off, size))
    ext = F.upper(F.regexp_replace(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1), r"\.", ""))

    def read(p: Column) -> Column:
        fmt, data = p["fmt"], p["data"]
        return F.struct(
            num(fmt, 8, 2).alias("tag"),
            num(fmt, 10, 2).alias("channels"),
            num(fmt, 12, 4).alias("rate"),
            F.floor((num(fmt, 22, 2) + 7) / 8).alias("width"),
            num(data, 4, 4).alias("bytes"),
        )

    def describe(h: Column) -> Column:
        channels, rate = h["channels"], h["rate"]
        pcm = h["tag"].isin(1, 0xFFFE) & (channels > 0) & (h["width"] > 0) & h["bytes"].isNotNull()
        ok = F.coalesce(pcm, F.lit(False))
        frames = F.floor(h["bytes"] / (channels * h["width"]))
        return F.struct(
            F.when(ok, channels).otherwise(1).cast("int").alias("channels"),
            F.when(ok, rate).otherwise(16000).cast("int").alias("sample_rate"),
            F.when(ok, frames).cast("bigint").alias("frames"),
            F.when(ok & (rate > 0), frames / rate.cast("double")).otherwise(0.0).alias("duration_sec"),
            F.when(ok, F.lit("WAV")).otherwise(ext).alias("format"),
            F.when(~ok, F.length(content).cast("bigint")).alias("file_size_bytes"),
        )

    # Each step is bound once and handed on, so the walk is not repeated per field.
    once = lambda value, fn: F.get(F.transform(F.array(value), fn), F.lit(0))
    return once(once(places, read), describe)
