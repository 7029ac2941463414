"""Checksums, replay of a log up to its first bad record, and files against the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.records import record_is_valid
from palimpsest.operators.joins import lookup_join


def verify_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``is_valid``: whether each record holds its own checksum."""
    return lines.withColumn("is_valid", record_is_valid(F.regexp_replace(F.col(line), "\n$", "")))


def require_valid(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines``, failing the job at a record that isn't valid; nothing is skipped in silence."""
    bad = ~record_is_valid(F.regexp_replace(F.col(line), "\n$", ""))
    return lines.where(F.when(bad, F.raise_error(F.concat(F.lit("corrupt record: "), F.coalesce(F.substring(line, 1, 80), F.lit("null")))).cast("boolean")).otherwise(True))


def valid_prefix(log: DataFrame, position: str, valid: Column) -> DataFrame:
    """The records before the first that isn't valid, in order of ``position``: no window, one number to the driver."""
    first_bad = log.where(~F.coalesce(valid, F.lit(False))).agg(F.min(position)).first()[0]
    return log if first_bad is None else log.where(F.col(position) < first_bad)


def segment_number(name: Column) -> Column:
    """The number in ``wal-<n>.log``; as a number, so that 10 follows 9."""
    return F.regexp_extract(name, r"^\s*wal-(\d+)\.log\s*$", 1).try_cast("bigint")


def file_number(name: Column) -> Column:
    """The number of a sorted file, ``sst_<n>``; of ``sst_<a>_<b>``, the first."""
    return F.split_part(name, F.lit("_"), F.lit(2)).try_cast("bigint")


def orphans(on_disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no manifest entry names."""
    return lookup_join(on_disk, manifest.select("file_name").distinct(), ["file_name"], "left_anti")


def missing(on_disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries whose file isn't there."""
    return lookup_join(manifest, on_disk.select("file_name").distinct(), ["file_name"], "left_anti")


def files_for_key(manifest: DataFrame, key: str) -> DataFrame:
    """The files that may hold ``key``, of any level, in no order: reads resolve by sequence number."""
    return manifest.where((F.col("min_key") <= key) & (F.col("max_key") >= key))
