"""Streams into the store, deduplicated replication, and votes as keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.changefeed import replay_changes
from palimpsest.schema import MUTATIONS, REPLICATION_ENTRY
from palimpsest.sources.versioned import VersionedTable
from palimpsest.store import Store


def mutation_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Mutations as they arrive as Parquet files; the trigger's size is what paces a fast writer."""
    return spark.readStream.schema(MUTATIONS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def into_store(stream: DataFrame, store: Store, feed: str = "stream") -> DataStreamWriter:
    """Append each micro-batch, which has its own sequence numbers, to the store.

    The number of the micro-batch is published with it under the name ``feed``, which
    must be the query's own: one that is delivered again changes nothing.
    """

    def append(batch: DataFrame, batch_no: int) -> None:
        store.apply_batch(batch, feed, batch_no)

    return stream.writeStream.foreachBatch(append)


def replication_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Replication entries as they arrive, each index once while copies of it come within ``delay`` of the newest; older state is dropped.

    Entries carry ``appended_at``. Of what comes later than that, what was applied is told by the index: see :class:`StateTable`, which skips positions applied.
    """
    schema = T.StructType([*REPLICATION_ENTRY.fields, T.StructField("appended_at", T.TimestampType())])
    return spark.readStream.schema(schema).parquet(path).withWatermark("appended_at", delay).dropDuplicatesWithinWatermark(["index"])


class StateTable:
    """The states of a change feed, kept between micro-batches as versions of a table.

    States lie in ``buckets`` folders by a hash of their key; a micro-batch reads and rewrites only the buckets that its keys fall into.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], pos: str, op: str, columns: list[str], buckets: int = 64) -> None:
        self.table, self.keys, self.pos, self.op, self.columns = VersionedTable(spark, path), keys, pos, op, columns
        self.buckets = self.table.content().get("count", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def states(self, schema: T.StructType) -> DataFrame:
        return self.table.read(self.table.content().get("buckets", {}).values(), schema)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one micro-batch; one that was applied before changes nothing, late changes count as if in order."""
        content, after = self.table.content(), self.table.latest()
        if batch_id <= content.get("batch", -1):
            return
        # The batch is read twice: for its buckets, at most as many as there are, and to be merged.
        touched = {str(r[0]) for r in batch.select(self._bucket()).distinct().collect() if r[0] is not None}
        schema = replay_changes(batch.limit(0), self.keys, self.pos, self.op, self.columns).schema
        held = content.get("buckets", {})
        before = self.table.read([held[b] for b in sorted(touched & held.keys())], schema)
        merged = replay_changes(batch, self.keys, self.pos, self.op, self.columns, states=before).withColumn("_bucket", self._bucket())
        folder = self.table.write(merged.repartition("_bucket"), ["_bucket"])
        made = {n.split("=")[1]: f"{folder}/{n}" for n in self.table.files.names(f"{self.table.path}/{folder}") if n.startswith("_bucket=")}
        self.table.publish({"buckets": held | made, "count": self.buckets, "batch": batch_id}, after)


def votes(requests: DataFrame) -> DataFrame:
    """Answers to vote requests (voter, candidate, term, seq) as they come; a voter's state is its term and its vote."""

    def vote(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        term, voted = state.get if state.exists else (None, None)
        out = []
        for frame in frames:
            for r in frame.sort_values("seq").itertuples():
                granted = term is None or r.term > term or (r.term == term and voted == r.candidate)
                if granted:
                    term, voted = int(r.term), r.candidate
                out.append((key[0], r.candidate, int(r.term), int(r.seq), granted))
        if term is not None:
            state.update((term, voted))
        yield pd.DataFrame(out, columns=["voter", "candidate", "term", "seq", "granted"])

    return requests.groupBy("voter").applyInPandasWithState(
        vote, "voter string, candidate string, term bigint, seq bigint, granted boolean", "term bigint, voted string", "append", GroupStateTimeout.NoTimeout
    )
