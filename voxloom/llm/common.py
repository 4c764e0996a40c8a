"""What the operators of this package share: columns in, shared folders, bounded blocks and array hashing."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.session import shared_dir

BLOCK_BYTES = 2 << 20
ARROW_BYTES = "8m"
BROADCAST_ROWS = 1_000_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LAST = np.int64(2**63 - 1)
_ODD = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written below the shared folder and read back: later steps neither repeat it nor lose it.

    Inside ``passing`` it goes with the block unless it is ``lasting``."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    folders = _passing.get()
    if folders is not None and not lasting:
        folders.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders that ``written`` makes inside the block are deleted at its end, after an error too.

    As each step reads what the one before has written, what a step shuffles is of no use after it: Spark removes those
    files at the end of each query in the block, not when the driver next collects its garbage."""
    folders: list[str] = []
    token = _passing.set(folders)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        _passing.reset(token)
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
        for path in folders:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def payload(text: Column) -> Column:
    """A text as UTF-8 bytes; null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def boxed(docs: DataFrame) -> DataFrame:
    """Whole rows as column ``_row``, so that no column of theirs meets a name used here."""
    return docs.select(F.struct("*").alias("_row"))


def unboxed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in docs.columns])


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id but not a text; equal rows share it."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def blocks(batches: Iterable[pa.RecordBatch], columns: list[str], size: str, limit: int = BLOCK_BYTES) -> Iterator[dict[str, list]]:
    """Rows of Arrow batches as lists, in runs whose ``size`` column adds up to about ``limit`` bytes."""
    for batch in batches:
        held: dict[str, list] = {name: [] for name in columns}
        total = 0
        arrays = [batch.column(name) for name in columns]
        sizes = batch.column(size)
        for i in range(batch.num_rows):
            for name, array in zip(columns, arrays, strict=True):
                held[name].append(array[i].as_py())
            total += len(sizes[i].as_py() or b"")
            if total >= limit:
                yield held
                held = {name: [] for name in columns}
                total = 0
        if held[size]:
            yield held


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of its input at once, in the JVM and in Python, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and idle ones would go on holding it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a generator of column dictionaries."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    arrow = pa.schema([(name, kinds[part.split()[1]]) for name, part in zip(names, schema.split(","), strict=True)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def grouped_arrow(df: DataFrame, key: str, work: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``applyInArrow`` per value of ``key`` for a function to a column dictionary."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[part.split()[1]]) for name, part in zip(names, schema.split(","), strict=True)])

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        table = pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        give_back()
        return table

    small_batches(df.sparkSession)
    return df.groupBy(key).applyInArrow(run, schema)


def bucket_count(df: DataFrame, text: Column, bucket_bytes: int) -> int:
    """Buckets of about ``bucket_bytes`` of input each: their number grows with the input, their size doesn't."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(16, math.ceil(total / bucket_bytes))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it was counted and has at most ``BROADCAST_ROWS`` rows; else Spark shuffles it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, BLOCK_BYTES + (1 << 20)), base % 2**64, np.uint64)
        held[0] = 1
        _powers[name] = held = np.multiply.accumulate(held)
    return held[:n]


class Rolling:
    """Hashes of any slices of a byte buffer, from one prefix sum (arithmetic modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = _power("back", pow(_ODD, -1, 2**64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(0x1F3)) * _power("on", _ODD, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of all slices of ``width`` bytes, by start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by repeated doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return out if not rest else np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]


def heads(sorted_flags: np.ndarray) -> np.ndarray:
    """For each place, the last place at or before it where the flag is set (the first must be)."""
    place = np.where(sorted_flags, np.arange(len(sorted_flags)), 0)
    return np.maximum.accumulate(place)


def union_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open intervals; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[fresh], end[np.r_[fresh[1:] - 1, len(end) - 1]]
