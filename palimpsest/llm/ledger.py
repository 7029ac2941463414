"""Has this key been seen before? An exact ledger of keys, hash-partitioned on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DataType

from palimpsest.sources.bucketed import BucketedRuns
from palimpsest.sources.versioned import VersionedTable, applied, with_applied

_BEFORE_ALL, _AFTER_ALL = -(2**63), 2**63 - 1


class KeyLedger:
    """All keys seen so far, each with the position at which it came first.

    The history is Parquet in hash buckets in the shared folder, a few runs of it. A
    batch is reduced to the first arrival of each of its keys (rank 1 by position)
    before any shuffle and sort-merge left-joined to the runs; the batch is shuffled to
    them and they are not. Keys without a match are new: they are written as the next
    run, and published together with the number of the batch. The batch's answer
    follows from that run alone: every row of a non-null key has been seen before but
    for the first arrivals of new keys. The answers are exact, and no task holds more
    of the history in memory than its sort allows.

    Batches come in order of position. A batch that is added again, whole or after a
    failure, gets the same answer and changes nothing. A batch that comes late is
    answered by the positions: a row has been seen before if an earlier position of its key is known by then.

    * A null key is never seen before and not remembered; a null position comes last.
    * Of rows of one key at one position all are first or none is.
    * Keys are compared exactly, code point by code point, at any length.
    * An empty batch adds nothing. Columns other than key and position are ignored.
    * A ledger that exists keeps its number of buckets, whatever the session's settings; another number or type of key is refused.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: DataType | None = None, buckets: int | None = None) -> None:
        schema = T.StructType([T.StructField("_key", key_type or T.StringType()), T.StructField("_first", T.LongType())])
        self.table = VersionedTable(spark, path)
        self.runs = BucketedRuns(self.table, schema, ["_key"], buckets, self.table.content().get("ledger"))

    @property
    def path(self) -> str:
        return self.table.path

    def history(self) -> DataFrame:
        """Keys and the positions at which they came first; of a key with several the least counts."""
        return self.runs.rows(self.table.content().get("runs", []))

    def _content(self, version: int) -> dict:
        content = self.table.content(version)
        self.runs.check(content.get("ledger"))
        return content

    def _publish(self, run: dict | None, batches: dict, after: int, content: dict) -> None:
        runs = self.runs.merged([*content.get("runs", []), *([run] if run else [])], lambda r: r.groupBy("_key").agg(F.min("_first").alias("_first")))
        self.table.publish({"ledger": self.runs.definition(), "runs": runs, "batches": batches}, after)

    def seed(self, keys: DataFrame, key: str) -> None:
        """Keys known before the first position."""
        after = self.table.latest()
        content = self._content(after)
        known = keys.select(F.col(f"`{key}`").alias("_key")).where("_key IS NOT NULL").groupBy("_key").agg(F.lit(_BEFORE_ALL).cast("bigint").alias("_first"))
        self._publish(self.runs.write(self.runs.aligned(known)), content.get("batches", {}), after, content)

    def add(self, batch: DataFrame, key: str, position: str, batch_no: int) -> DataFrame:
        """Add the batch numbered ``batch_no`` (from 0) and return those of its rows whose key was seen before."""
        after = self.table.latest()
        content = self._content(after)
        k, p = _key_and_position(batch, key, position)
        # The partial aggregate leaves one row per key and task.
        firsts = batch.where(k.isNotNull()).groupBy(k.alias("_key")).agg(F.min(p).alias("_first"))
        judged = self.runs.aligned(firsts).withColumn("_known", F.lit(None).cast("bigint"))
        for run in self.runs.each(content.get("runs", [])):
            judged = judged.join(run.withColumnRenamed("_first", "_there").hint("merge"), "_key", "left").withColumn("_known", F.least("_known", "_there")).drop("_there")
        # A position that is known already is that of this batch, added before.
        run = self.runs.write(judged.where("_known IS NULL OR _known >= _first"))
        if not applied(content.get("batches", {}), batch_no):
            self._publish(run, with_applied(content.get("batches", {}), batch_no), after, content)
        return _but_first(batch, self.runs.rows([run] if run else []), key, position)


def _key_and_position(rows: DataFrame, key: str, position: str) -> tuple[Column, Column]:
    return rows[f"`{key}`"], F.coalesce(rows[f"`{position}`"].cast("bigint"), F.lit(_AFTER_ALL))


def _but_first(rows: DataFrame, firsts: DataFrame, key: str, position: str) -> DataFrame:
    """``rows`` of a non-null key without the first arrivals, taken away by position and key: a key that holds a third of the rows is spread by its positions."""
    k, p = _key_and_position(rows, key, position)
    return rows.where(k.isNotNull()).join(firsts, (p == firsts["_first"]) & (k == firsts["_key"]), "left_anti")
