"""Figures of a store's layout, and of a benchmark's latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.records import cell_size, user_size
from palimpsest.operators.blocks import with_position
from palimpsest.operators.joins import lookup_join
from palimpsest.operators.layout import sstable_records
from palimpsest.operators.mvcc import live


def per_level(files: DataFrame) -> DataFrame:
    """Sorted files and records of each level; ``files`` has level and file_no."""
    return files.groupBy("level").agg(F.countDistinct("file_no").alias("sstables"), F.count("*").alias("records"))


def summary(files: DataFrame, memtable: DataFrame, written: DataFrame) -> DataFrame:
    """One row: sorted files, their bytes, the memtable's size and live keys, bytes written by the user and to disk, and their ratio (0 without user bytes).

    ``files`` are the cells in sorted files, ``memtable`` those in none, ``written`` all mutations as cells.
    """
    disk = sstable_records(files).agg(F.countDistinct("level", "file_no").alias("total_sstables"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("data_bytes"))
    memory = memtable.agg(F.coalesce(F.sum(cell_size()), F.lit(0)).alias("memtable_size"))
    keys = live(memtable).agg(F.count("*").alias("memtable_keys"))
    user = written.agg(F.coalesce(F.sum(user_size()), F.lit(0)).alias("user_bytes"))
    names = [*disk.columns, *memory.columns, *keys.columns, *user.columns]
    rows = disk.unionByName(memory, True).unionByName(keys, True).unionByName(user, True)  # one row each, merged into one
    one = rows.agg(*(F.max(n).alias(n) for n in names))
    return one.withColumn("write_amplification", F.when(F.col("user_bytes") == 0, 0.0).otherwise(F.col("data_bytes") / F.col("user_bytes")))


def latency_percentiles(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Exact median and 99th percentile of each group of ``by``, interpolated between ranks; null samples don't count.

    Samples are sorted in blocks and the few ranks that matter picked by position, so that no group is held in one task.
    """
    v = F.col(f"`{value}`").cast("double")
    keys = [F.coalesce(F.to_json(F.struct(*by)), F.lit("")) if by else F.lit("")]
    counts = samples.groupBy(*by, keys[0].alias("_g")).agg(F.count(v).alias("samples"))
    placed = with_position(samples.where(v.isNotNull()).select(keys[0].alias("_g"), v.alias("_v")), ["_g", "_v"], "_pos")
    groups = placed.groupBy("_g").agg(F.min("_pos").alias("_from"), F.count("*").alias("_n"))
    ranks = {"p50": 0.5, "p99": 0.99}
    rank = {n: (F.col("_n") - 1) * F.lit(p) for n, p in ranks.items()}
    wanted = lookup_join(placed, groups, ["_g"], spread=["_pos"]).withColumn("_at", F.col("_pos") - F.col("_from"))
    near = wanted.where(reduce(Column.__or__, [(F.col("_at") == F.floor(r)) | (F.col("_at") == F.ceil(r)) for r in rank.values()]))

    def at(n: str) -> Column:
        r = rank[n]
        low, high = (F.max(F.when(F.col("_at") == f(r), F.col("_v"))) for f in (F.floor, F.ceil))
        position = F.max(r)
        return F.when(low == high, low).otherwise((F.ceil(position) - position) * low + (position - F.floor(position)) * high).alias(n)

    return counts.join(near.groupBy("_g").agg(*(at(n) for n in ranks)), "_g", "left").drop("_g")


def parse_commands(lines: DataFrame, line: str = "line") -> DataFrame:
    """Commands of the interactive shell: ``command``, ``arg1``, ``arg2`` and ``is_valid``.

    A command counts in any case; SET takes two arguments, GET one or a key and a
    sequence number, DELETE one, SCAN two, STATS and EXIT none.
    """
    words = F.split(F.trim(F.col(line)), r"\s+")
    n = F.size(words) - 1
    command = F.upper(words[0])
    arg1, arg2 = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    valid = (
        F.when(command.isin("SET", "SCAN"), n == 2)
        .when(command == "GET", (n == 1) | ((n == 2) & arg2.try_cast("bigint").isNotNull()))
        .when(command == "DELETE", n == 1)
        .when(command.isin("STATS", "EXIT"), n == 0)
        .otherwise(False)
    )
    return lines.select(line, command.alias("command"), arg1.alias("arg1"), arg2.alias("arg2"), F.coalesce(valid, F.lit(False)).alias("is_valid"))
