"""How cells are laid out in files: flush batches, file contents, offsets, sparse indexes, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palimpsest.functions.records import cell_size, record_line, sstable_payload
from palimpsest.operators.blocks import CloseAfter, OpenBefore, greedy_groups

def flush_batches(cells: DataFrame, threshold: int) -> DataFrame:
    """``cells`` with ``batch_id`` and ``sealed``: a batch is closed after the row that brings it to ``threshold``.

    The last, open batch is the memtable. Deterministic: rotation follows the sequence numbers alone.
    """
    grouped = greedy_groups(cells.withColumn("_cell_size", cell_size()), ["seq"], "_cell_size", CloseAfter(threshold), "batch_id")
    return grouped.withColumnRenamed("_sealed", "sealed").drop("_cell_size")


def compaction_chunks(cells: DataFrame, target: int) -> DataFrame:
    """Each key with its size over all versions and the chunk it falls into.

    A chunk is closed before the key that would exceed ``target``; a key's versions
    stay together, and a key above the target is a chunk of its own.
    """
    sizes = cells.groupBy("key").agg(F.sum(cell_size()).alias("size"))
    return greedy_groups(sizes, ["key"], "size", OpenBefore(target), "chunk").drop("_sealed")


def sstable_records(cells: DataFrame) -> DataFrame:
    """``cells`` with the line that stores each and its size in bytes."""
    return cells.withColumn("line", record_line(sstable_payload())).withColumn("bytes", F.octet_length("line").cast("bigint"))


def record_offsets(files: DataFrame, file: str = "file_no") -> DataFrame:
    """Byte offset of each record in its file, whose records are sorted by key and sequence number. A file is bounded in size."""
    before = F.sum("bytes").over(W.partitionBy(file).orderBy("key", "seq").rowsBetween(W.unboundedPreceding, -1))
    return sstable_records(files).withColumn("offset", F.coalesce(before, F.lit(0)).cast("bigint"))


def sparse_index(files: DataFrame, every: int, file: str = "file_no") -> DataFrame:
    """The offset of the first record of every ``every``-th key of each file."""
    keys = W.partitionBy(file).orderBy("key")
    numbered = record_offsets(files, file).withColumn("_n", F.dense_rank().over(keys)).withColumn("_v", F.row_number().over(W.partitionBy(file, "key").orderBy("seq")))
    return numbered.where((F.col("_n") % every == 0) & (F.col("_v") == 1)).select(file, "key", "offset")


def floor_lookup(index: DataFrame, probes: DataFrame, file: str = "file_no") -> DataFrame:
    """For each probe (file, key) the offset of the greatest indexed key that isn't above it, else 0: an as-of join.

    Index and probes are united and sorted once per file; no pair is formed.
    """
    both = index.select(file, "key", F.col("offset").alias("_o"), F.lit(0).alias("_side")).unionByName(probes.select(file, "key", F.lit(None).cast("bigint").alias("_o"), F.lit(1).alias("_side")))
    upto = W.partitionBy(file).orderBy("key", "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("offset", F.coalesce(F.last("_o", ignorenulls=True).over(upto), F.lit(0)).cast("bigint")).where("_side = 1").select(file, "key", "offset")


def key_ranges(files: DataFrame, *by: str) -> DataFrame:
    """Least and greatest key, rows and distinct keys of each file."""
    return files.groupBy(*by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("records"), F.countDistinct("key").alias("distinct_keys"))


def group_commits(log: DataFrame, position: str, buffer: int) -> DataFrame:
    """The group of log records that is made durable together."""
    return log.withColumn("commit_group", F.floor((F.col(position) - 1) / buffer).cast("bigint"))
