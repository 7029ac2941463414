"""Compaction: which versions stay, which tombstones go, which files are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.operators.blocks import in_blocks, with_carry
from palimpsest.operators.joins import lookup_join
from palimpsest.operators.mvcc import resolve


def retain(cells: DataFrame, oldest_pin: int | None) -> DataFrame:
    """The versions that compaction keeps.

    Without a pin the newest of each key; with the oldest pin at S the newest that is
    at most S, and all above S. The former are found by a partial aggregate, the
    latter by a filter: a hot key is never gathered.
    """
    if oldest_pin is None:
        return resolve(cells)
    return resolve(cells, oldest_pin).unionByName(cells.where(F.col("seq") > oldest_pin).select("key", "seq", "value", "is_tombstone"))


def drop_tombstones(kept: DataFrame, deeper: DataFrame) -> DataFrame:
    """``kept`` (one version per key, no pin) without the tombstones that no file of ``deeper`` (min_key, max_key) may need.

    Only tombstones are compared with the ranges.
    """
    ranges = deeper.select(F.col("min_key").alias("key"), F.col("max_key").alias("_reach"))
    covered = covering(kept.where("is_tombstone").select("key", "seq", "value", "is_tombstone"), ranges)
    return kept.where("NOT is_tombstone").unionByName(covered)


def covering(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``points`` whose ``key`` lies in a range of ``ranges`` (key, _reach).

    Ranges and points are sorted together in blocks, where a running maximum of
    ``_reach`` tells whether any range that began reaches as far: no pair is formed, at any number of ranges.
    """
    side = ranges.select("key", F.lit(0).alias("_side"), "_reach", F.lit(None).alias("_row0"))
    data = points.select("key", F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_reach"), F.struct(*points.columns).alias("_row0"))
    blocks = in_blocks(side.withColumn("_row0", F.lit(None).cast(data.schema["_row0"].dataType)).unionByName(data), ["key", "_side"])
    tops = {r[0]: r[1] for r in blocks.groupBy("_block").agg(F.max("_reach")).collect()}  # one key per block
    carried, reach = {}, None
    for b in sorted(tops):
        carried[b] = reach
        reach = max((x for x in (reach, tops[b]) if x is not None), default=None)
    upto = F.max("_reach").over(W.partitionBy("_block").orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    reached = with_carry(blocks, carried, "string", "_earlier").withColumn("_upto", F.greatest(upto, "_earlier"))
    return reached.where("_side = 1 AND _upto >= key").select("_row0.*")


def inputs(manifest: DataFrame, level: int) -> DataFrame:
    """The files that compacting ``level`` reads: all of it and those of the next level whose ranges overlap its span."""
    span = manifest.where(F.col("level") == level).agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi")).first()
    if span is None or span["lo"] is None:
        return manifest.limit(0)
    overlaps = (F.col("level") == level + 1) & (F.col("min_key") <= span["hi"]) & (F.col("max_key") >= span["lo"])
    return manifest.where((F.col("level") == level) | overlaps)


def due(manifest: DataFrame, max_l0_files: int, factor: int = 10) -> DataFrame:
    """Levels with the number of their files, their limit, and whether they are due for compaction."""
    limit = (F.lit(max_l0_files) * F.pow(F.lit(factor), F.col("level"))).cast("bigint")
    return manifest.groupBy("level").agg(F.count("*").alias("files")).withColumn("file_limit", limit).withColumn("is_due", F.col("files") >= F.col("file_limit"))


def compact(cells: DataFrame, oldest_pin: int | None = None, deeper: DataFrame | None = None) -> DataFrame:
    """Merge the versions of the input files; without a pin, tombstones that no deeper file needs go."""
    kept = retain(cells, oldest_pin)
    if oldest_pin is not None:
        return kept
    return kept.where("NOT is_tombstone") if deeper is None else drop_tombstones(kept, deeper)


def pin_counts(events: DataFrame) -> DataFrame:
    """Snapshots that are held, with the number of holders, from events (seq, delta of 1 or -1)."""
    return events.groupBy("seq").agg(F.sum("delta").cast("bigint").alias("refs")).where("refs > 0")


def oldest_pin(events: DataFrame) -> DataFrame:
    """The oldest sequence number that is held; null if none is."""
    return pin_counts(events).agg(F.min("seq").alias("oldest"))


def without_files(manifest: DataFrame, removed: DataFrame) -> DataFrame:
    """A manifest without some files."""
    return lookup_join(manifest, removed.select("file_name").distinct(), ["file_name"], "left_anti")
