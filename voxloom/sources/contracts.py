"""Table schemas and the input contracts of the analysis jobs.

Any producer - a model job of the user's, say a ``mapInPandas`` over raw
recordings - may write these tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    """Schema from "name type, name type"; works before a session exists."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


JOBS = _struct(
    "job_id bigint, external_id string, storage_uri string, file_name string, duration_seconds double, sample_rate int, "
    "channels int, language string, status string, error_message string, callback_url string, webhook_status string, "
    "attempts int, processing_started_at timestamp, last_error_at timestamp, overlap_summary string, num_speakers int, "
    "created_at timestamp, updated_at timestamp"
)
UTTERANCES = _struct(
    "recording_id bigint, utt_no int, utterance_id string, speaker_id string, start_time double, end_time double, text string, created_at timestamp"
)
DELIVERIES = _struct(
    "delivery_id bigint, job_id bigint, url string, payload string, attempts int, next_attempt_at timestamp, status string, "
    "error_message string, created_at timestamp, updated_at timestamp"
)


ID_COLUMNS = ("job_id", "recording_id", "delivery_id")


def with_string_ids(schema: T.StructType) -> T.StructType:
    """The same table with ids as strings, for jobs named by UUIDs."""
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in ID_COLUMNS else f for f in schema.fields])


def id_kind(df: DataFrame, schema: str, column: str = "recording_id") -> str:
    """``schema`` with an id column of the type that ``df`` has."""
    return ", ".join(f"{column} {df.schema[column].dataType.simpleString()}" if part.split()[0] == column else part for part in schema.split(", "))


@dataclass(frozen=True)
class Contract:
    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    interval: bool = True


WORDS = Contract(
    "words",
    _struct("recording_id bigint, pos bigint, word string, start_time double, end_time double"),
    ("recording_id", "pos"),
)
SEGMENTS = Contract(
    "segments",
    _struct("recording_id bigint, seg_no bigint, speaker_id string, start_time double, end_time double"),
    ("recording_id", "seg_no", "speaker_id"),
)
INTERVALS = Contract("intervals", _struct("recording_id bigint, start_time double, end_time double"), ("recording_id",))
SAMPLES = Contract(
    "samples", _struct("recording_id bigint, pos bigint, value double, sample_rate int"), ("recording_id", "pos"), False
)


def check_schema(df: DataFrame, contract: Contract) -> None:
    """Raise when a column is missing or has another type (integers may be narrower, ids integers or strings)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in contract.schema.fields:
        got = have.get(f.name)
        both_int = isinstance(got, T.IntegralType) and isinstance(f.dataType, T.IntegralType)
        named = f.name in ID_COLUMNS and isinstance(got, T.StringType)
        if got is None or (got != f.dataType and not both_int and not named):
            raise TypeError(f"{contract.name}.{f.name}: expected {f.dataType.simpleString()}, got {got}")


def check_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """One row of counts: rows, null keys, reversed intervals."""
    check_schema(df, contract)
    null_key: Column = F.lit(False)
    for k in contract.keys:
        null_key = null_key | F.col(k).isNull()
    reverse = F.col("start_time") > F.col("end_time") if contract.interval else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(null_key).alias("null_keys"), F.count_if(reverse).alias("reversed")
    )
