"""What a node of the replicated store keeps on disk: its vote, and its log with a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import EngineConfig
from palimpsest.operators import replication
from palimpsest.schema import REPLICATION_ENTRY, SNAPSHOT
from palimpsest.sources.versioned import VersionedTable


class VoteState:
    """A node's term and vote, published before they are answered with, so that a restart can't vote twice in a term."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path)
        content = self.table.content()
        self.term, self.voted_for = content.get("term", 0), content.get("voted_for")

    def _keep(self, term: int, voted_for: str | None) -> None:
        self.table.publish({"term": term, "voted_for": voted_for}, self.table.latest())
        self.term, self.voted_for = term, voted_for

    def vote(self, candidate: str, term: int) -> bool:
        """Whether the vote is granted: a higher term always, the same term to nobody but the candidate that has it."""
        if term < self.term or (term == self.term and self.voted_for not in (None, candidate)):
            return False
        if (term, candidate) != (self.term, self.voted_for):
            self._keep(term, candidate)
        return True

    def stand(self, node: str) -> int:
        """Enter the next term as a candidate that has its own vote."""
        self._keep(self.term + 1, node)
        return self.term


class ReplicatedLog:
    """A node's replicated entries on top of a snapshot.

    When more than ``log_compaction_threshold`` entries lie on top of it, the snapshot is
    taken anew up to the last index and the log is empty; both are published at
    once. Entries with an index that the node has are left out, so that a batch that
    is sent again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> None:
        self.table, self.config = VersionedTable(spark, path), config

    def _content(self, version: int) -> dict:
        return {"snapshot": [], "snapshot_index": 0, "log": [], "entries": 0, "index": 0} | self.table.content(version)

    def append(self, entries: DataFrame) -> int:
        """Append entries (index, operation, key, value) in order of index; returns the last index."""
        after = self.table.latest()
        now = self._content(after)
        new = replication.received_once(entries.select(*REPLICATION_ENTRY.names).where(F.col("index") > now["index"]))
        folder = self.table.write(new)
        n, last = self.table.read([folder], REPLICATION_ENTRY).agg(F.count("*"), F.max("index")).first()
        now |= {"log": [*now["log"], folder], "entries": now["entries"] + n, "index": last or now["index"]}
        if now["entries"] > self.config.log_compaction_threshold:
            snapshot = self.table.write(self._state(now))
            now |= {"snapshot": [snapshot], "snapshot_index": now["index"], "log": [], "entries": 0}
        self.table.publish(now, after)
        return now["index"]

    def _state(self, content: dict) -> DataFrame:
        return replication.restored(self.table.read(content["snapshot"], SNAPSHOT), content["snapshot_index"], self.table.read(content["log"], REPLICATION_ENTRY))

    def state(self) -> DataFrame:
        """Keys and values after the last entry."""
        return self._state(self._content(self.table.latest()))

    def catch_up(self, index: int) -> tuple[DataFrame | None, int, DataFrame]:
        """What a node that has everything up to ``index`` is sent: a snapshot and its index, where the log no longer reaches back, and the entries after it."""
        now = self._content(self.table.latest())
        log = self.table.read(now["log"], REPLICATION_ENTRY)
        if index < now["snapshot_index"]:
            return self.table.read(now["snapshot"], SNAPSHOT), now["snapshot_index"], log
        return None, index, replication.suffix(log, index)
