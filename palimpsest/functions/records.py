"""Encodings, checksums and sizes of the store's records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Write-ahead-log frame: length 4, operation 1, sequence 8, key length 4, checksum 4.
WAL_FIXED = 21
WAL_VALUE_LENGTH = 4


def sstable_payload() -> Column:
    """JSON of one cell, without null fields: ``k``, ``s`` and either ``v`` or ``t``."""
    deleted = F.col("is_tombstone")
    return F.to_json(F.struct(F.col("key").alias("k"), F.col("seq").alias("s"), F.when(~deleted, F.col("value")).alias("v"), F.when(deleted, F.lit(True)).alias("t")))


def record_line(payload: Column) -> Column:
    """Payload, tab, checksum, line feed."""
    return F.concat(payload, F.lit("\t"), F.crc32(payload).cast("string"), F.lit("\n"))


def record_is_valid(line: Column) -> Column:
    """Whether a line without its line feed holds a payload and that payload's checksum; null and torn lines don't."""
    payload, crc = F.regexp_extract(line, r"(?s)^(.*)\t([^\t]*)$", 1), F.regexp_extract(line, r"(?s)^(.*)\t([^\t]*)$", 2)
    return F.coalesce(F.contains(line, F.lit("\t")) & (crc.try_cast("bigint") == F.crc32(payload)), F.lit(False))


def wal_record_size() -> Column:
    """Bytes of a cell's framed log record."""
    value = F.when(~F.col("is_tombstone"), F.octet_length("value") + WAL_VALUE_LENGTH).otherwise(0)
    return (F.lit(WAL_FIXED) + F.octet_length("key") + value).cast("bigint")


def cell_size() -> Column:
    """A cell's size in the memtable: code points of key and value; a tombstone counts 1."""
    return (F.length("key") + F.when(F.col("is_tombstone"), 1).otherwise(F.length("value"))).cast("bigint")


def user_size() -> Column:
    """A cell's size as the user wrote it: a delete counts its key alone."""
    return (F.length("key") + F.when(F.col("is_tombstone"), 0).otherwise(F.length("value"))).cast("bigint")
