"""Binary write-ahead-log segments and checksummed text files of the store, read and written as DataFrames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.records import record_line, sstable_payload
from palimpsest.operators.integrity import require_valid, segment_number

# Formats of a payload's head (operation, sequence, key length) and of a length; kept as text, which travels to executors.
_HEAD, _U32 = "<BQI", "<I"
_HEAD_SIZE = struct.calcsize(_HEAD)
_NAMES = ("SET", "DELETE")


def decode_wal(data: bytes) -> Iterator[tuple[str, int, str, str | None] | None]:
    """The records of a segment up to the first that is torn or whose checksum is wrong; what follows it is never read, and None stands for it."""
    at = 0
    while at < len(data):
        size = struct.unpack_from(_U32, data, at)[0] if at + 4 <= len(data) else 0
        payload, crc = data[at + 4 : at + 4 + size], data[at + 4 + size : at + 8 + size]
        if len(payload) < size or len(crc) < 4 or size < _HEAD_SIZE or struct.unpack(_U32, crc)[0] != zlib.crc32(payload):
            yield None
            return
        kind, seq, key_size = struct.unpack_from(_HEAD, payload)
        end = _HEAD_SIZE + key_size
        value = None
        if kind == 0:
            (value_size,) = struct.unpack_from(_U32, payload, end)
            value = payload[end + 4 : end + 4 + value_size].decode()
        yield _NAMES[kind], seq, payload[_HEAD_SIZE:end].decode(), value
        at += 8 + size


def decode_segments(files: DataFrame) -> DataFrame:
    """The records of segments (``name``, ``content``): ``segment_no``, ``pos`` in the segment, ``seq``, ``op``, ``key``, ``value``; of a bad record only its place.

    A segment is one task's work and is bounded by rotation. A file that isn't named as one comes last, with a null number.
    """

    def decode(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                rows = [(name, i, r[1] if r else None, *((r[0], r[2], r[3]) if r else (None, None, None))) for i, r in enumerate(decode_wal(bytes(content)))]
                found = pd.DataFrame(rows, columns=["name", "pos", "seq", "op", "key", "value"])
                yield found.astype({"seq": "Int64"})

    rows = files.select("name", "content").mapInPandas(decode, "name string, pos bigint, seq bigint, op string, key string, value string")
    return rows.select(segment_number(F.col("name")).alias("segment_no"), "pos", "seq", "op", "key", "value")


def spliced(records: DataFrame) -> DataFrame:
    """The records of all segments as one log, in order of segment number and position, up to its first bad record: nothing after it is replayed, of no segment. One row comes to the driver."""
    number = F.coalesce("segment_no", F.lit(2**63 - 1))
    bad = records.where("op IS NULL").agg(F.min(F.struct(number.alias("s"), F.col("pos").alias("p"))).alias("at")).first()["at"]
    good = records.where("op IS NOT NULL")
    return good if bad is None else good.where((number < bad["s"]) | ((number == bad["s"]) & (F.col("pos") < bad["p"])))


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """All segments under ``path``, each up to its own first bad record, as :func:`decode_segments` gives them."""
    return decode_segments(_segments(spark, path)).where("op IS NOT NULL")


def replay_wal(spark: SparkSession, path: str) -> DataFrame:
    """The segments under ``path`` as one log up to its first bad record."""
    return spliced(decode_segments(_segments(spark, path)))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _little_endian(number: Column, size: int) -> Column:
    """An unsigned number as ``size`` bytes, lowest first."""
    digits = F.lpad(F.hex(number.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))))


def wal_frame(seq: Column, key: Column, value: Column, is_tombstone: Column) -> Column:
    """A record's frame: length, payload (operation, seq, key and, for a set, value, each with its length), checksum."""
    k = F.encode(key, "UTF-8")
    head = F.concat(F.when(is_tombstone, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), _little_endian(seq, 8), _little_endian(F.octet_length(k), 4), k)
    v = F.encode(value, "UTF-8")
    payload = F.when(is_tombstone, head).otherwise(F.concat(head, _little_endian(F.octet_length(v), 4), v))
    return F.concat(_little_endian(F.octet_length(payload), 4), payload, _little_endian(F.crc32(payload), 4))


def write_sstables(cells: DataFrame, path: str) -> None:
    """Checksummed text files in the order of key and sequence number, range-partitioned by both, so that a key of many versions is spread."""
    ordered = cells.repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")
    ordered.select(F.regexp_replace(record_line(sstable_payload()), "\n$", "").alias("value")).write.text(path)


def read_sstables(spark: SparkSession, path: str) -> DataFrame:
    """The cells of checksummed text files; a bad record fails the job, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")
    payload = F.regexp_extract("line", r"(?s)^(.*)\t[^\t]*$", 1)
    record = F.from_json(payload, "k string, s bigint, v string, t boolean")
    parsed = require_valid(lines).select(record.alias("r"))
    return parsed.select(F.col("r.k").alias("key"), F.col("r.s").alias("seq"), F.col("r.v").alias("value"), F.coalesce("r.t", F.lit(False)).alias("is_tombstone"))


def write_sparse_index(index: DataFrame, path: str) -> None:
    """A sparse index (key, offset) as checksummed text: ``k`` and ``o`` as JSON, tab, checksum."""
    payload = F.to_json(F.struct(F.col("key").alias("k"), F.col("offset").alias("o")))
    index.repartitionByRange("key").sortWithinPartitions("key").select(F.regexp_replace(record_line(payload), "\n$", "").alias("value")).write.text(path)


def read_sparse_index(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a sparse index; a bad one fails the job, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")
    payload = F.regexp_extract("line", r"(?s)^(.*)\t[^\t]*$", 1)
    return require_valid(lines).select(F.from_json(payload, "k string, o bigint").alias("r")).select(F.col("r.k").alias("key"), F.col("r.o").alias("offset"))
