"""Reading the test tables and the inputs derived from them."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import EngineConfig
from palimpsest.operators.compaction import compact
from palimpsest.operators.layout import compaction_chunks, flush_batches
from palimpsest.operators.mvcc import cells_from_mutations
from palimpsest.session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(rows: DataFrame, position: str, size: int, least: int) -> list[DataFrame]:
    """``rows`` in order of ``position``, a whole number, in ranges of it: at least ``least``, and more where a range would hold more than about ``size`` rows.

    A null position comes in the last batch. Nothing at all is one empty batch.
    """
    p = F.col(f"`{position}`")
    low, high, n = rows.agg(F.min(p), F.max(p), F.count("*")).first()
    if low is None:
        return [rows]
    count = max(least, -(-n // size))
    step = (high - low) // count + 1
    bounds = [(low + b * step, low + (b + 1) * step - 1) for b in range(count)]
    return [rows.where(p.between(a, z) | p.isNull() if z >= high and a <= high else p.between(a, z)) for a, z in bounds]


def in_growing_batches(rows: DataFrame, position: str, size: int, least: int) -> list[DataFrame]:
    """As :func:`in_batches`, but only the first ``least`` ranges hold at most about ``size`` rows; each one after them is as wide as all before it together.

    Their number grows with the logarithm of the rows, so plans and jobs over all batches stay few; and
    where every batch is joined to those before it, these are read about once in all, not once per ``size`` rows.
    """
    p = F.col(f"`{position}`")
    low, high, n = rows.agg(F.min(p), F.max(p), F.count("*")).first()
    if low is None:
        return [rows]
    ends = list(range(1, least + 1))
    while ends[-1] * size < n:
        ends.append(2 * ends[-1])
    cuts = [low, *(low + (high - low + 1) * e // ends[-1] for e in ends)]
    # The last cut alone lies beyond the highest position.
    return [rows.where(p.between(a, z - 1) | p.isNull() if z > high else p.between(a, z - 1)) for a, z in pairwise(cuts)]


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutation log derived from ``events``: seq, op, key, value."""
    deleted = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(deleted, "DELETE").otherwise("SET").alias("op"),
        F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.when(~deleted, F.col("props")).alias("value"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_from_mutations(mutations(spark, sf_dir))


def last_seq(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells in flush batches: ``batch_id`` and ``sealed``."""
    return flush_batches(cells(spark, sf_dir), EngineConfig().max_memtable_size)


#: Size at which a simulated file of level 1 is closed, and the number of its first file.
LEVEL1_CHUNK = 256
LEVEL1_FIRST = 1_000_000


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulated layout: ``level``, ``file_no``; the memtable's cells have neither.

    The older half of the sealed batches is compacted into level 1, whose files are
    chunks of keys; every other sealed batch is a file of level 0.
    """
    flushed = written(batches(spark, sf_dir), "flushed")  # read four times
    sealed = flushed.where("sealed").agg(F.max("batch_id")).first()[0]
    half = ((sealed + 1) if sealed is not None else 0) // 2
    bottom = compact(flushed.where(F.col("sealed") & (F.col("batch_id") < half)).select("key", "seq", "value", "is_tombstone"))
    chunks = compaction_chunks(bottom, LEVEL1_CHUNK).select("key", (F.col("chunk") + LEVEL1_FIRST).alias("file_no"))
    level1 = bottom.join(chunks, "key").select("key", "seq", "value", "is_tombstone", F.lit(1).alias("level"), "file_no")
    rest = flushed.where(~F.col("sealed") | (F.col("batch_id") >= half))
    level0 = rest.select("key", "seq", "value", "is_tombstone", F.when(F.col("sealed"), 0).alias("level"), F.when(F.col("sealed"), F.col("batch_id")).alias("file_no"))
    return level1.unionByName(level0)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the simulated layout."""
    ranges = levels(spark, sf_dir).where("level IS NOT NULL").groupBy("level", "file_no").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return ranges.select("level", F.concat(F.lit("sst_"), F.col("file_no").cast("string")).alias("file_name"), "min_key", "max_key")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that users may have, and 50 that don't exist."""
    users = table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1
    return spark.range(users + 50).select(F.concat(F.lit("user_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"))


def replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutations as a replication log: index, operation, key, value."""
    return mutations(spark, sf_dir).select(F.col("seq").alias("index"), F.lower("op").alias("operation"), "key", "value")


def acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who acknowledged which index, of five nodes led by n0."""
    nodes = F.explode(F.sequence(F.lit(0), F.lit(4)))
    each = replicated(spark, sf_dir).select("index", nodes.alias("j"))
    return each.where((F.col("j") == 0) | ((F.col("index") + 1) * F.col("j") % 7 < 4)).select("index", F.concat(F.lit("n"), F.col("j").cast("string")).alias("node"))


def vote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("voter"),
        F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")).alias("candidate"),
        (F.floor(F.col("event_id") / 40) + F.col("event_id") % 3 - 1).cast("bigint").alias("term"),
    )
