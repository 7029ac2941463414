"""A multi-version key-value store on Parquet files under one atomically published manifest."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.config import EngineConfig
from palimpsest.functions.records import cell_size, sstable_payload, user_size
from palimpsest.operators import compaction, layout, mvcc
from palimpsest.operators.blocks import with_position
from palimpsest.operators.changefeed import spelled
from palimpsest.schema import CELLS, MANIFEST
from palimpsest.session import written
from palimpsest.sources.formats import replay_wal
from palimpsest.sources.versioned import VersionedTable

_STORED = T.StructType([*CELLS.fields, T.StructField("crc", T.LongType())])
_EMPTY = {"seq": 0, "user_bytes": 0, "disk_bytes": 0, "next_file": 0, "log": [], "log_size": 0, "files": [], "applied": {}}


class Store:
    """Sets and deletes with sequence numbers; reads as of any of them.

    Writes go to log folders. :meth:`flush` turns the log into a sorted file of level
    0, :meth:`compact` merges levels. All three become visible by one atomic publish,
    so that a lost job changes nothing. Reads never depend on the layout: they unite
    log and files, skip files by their range of keys, and take the newest visible
    version. A DataFrame that was read stays valid: files that were replaced are only
    deleted by :meth:`vacuum`.

    One writer at a time: a second :meth:`__init__` on the same path raises
    RuntimeError until the first is closed (``break_lock`` takes over after a crash).
    Readers need no lock: ``Store.reader``.

    A store whose manifest names a folder that isn't there can't be opened (RuntimeError).
    Opening it for writing deletes what a lost job left: folders that no version names.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig = EngineConfig(), break_lock: bool = False, read_only: bool = False) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.table = VersionedTable(spark, self.path)
        self._lock = None
        if not read_only:
            lock = f"{self.path}/LOCK"
            if break_lock:
                self.table.files.delete(lock)
            try:
                self.table.files.write(lock, b"")
            except Exception as e:
                if "AlreadyExists" in str(e) or "already exists" in str(e):
                    raise RuntimeError(f"{self.path} is open elsewhere") from e
                raise
            self._lock = lock
        self.version = self.table.latest()
        self.state = _EMPTY | self.table.content(self.version)
        self._check_folders()
        self._buffer: list[tuple[int, str, str, str | None]] = []
        self._pins: dict[int, int] = {}

    @classmethod
    def reader(cls, spark: SparkSession, path: str) -> Store:
        return cls(spark, path, read_only=True)

    @staticmethod
    def _folders(state: dict) -> list[str]:
        return [*state.get("log", ()), *(f["folder"] for f in state.get("files", ()))]

    def _check_folders(self) -> None:
        if gone := self.table.missing(self._folders(self.state)):
            self._unlock()
            raise RuntimeError(f"{self.path} lacks {', '.join(gone)}, which its manifest names")
        if self._lock is not None:
            named = {f for v in self.table.versions() for f in self._folders(self.table.content(v))}
            self.table.vacuum(named, keep_versions=0)

    def _unlock(self) -> None:
        if self._lock is not None:
            self.table.files.delete(self._lock)
            self._lock = None

    # --- writes

    def _publish(self, **changes) -> None:
        if self._lock is None:
            raise RuntimeError("the store is closed or read-only")
        state = self.state | changes
        self.version = self.table.publish(state, self.version)
        self.state = state

    def set(self, key: str, value: str) -> int:
        return self._buffered("SET", key, value)

    def delete(self, key: str) -> int:
        """Write a tombstone, whether or not the key exists."""
        return self._buffered("DELETE", key, None)

    def _buffered(self, op: str, key: str, value: str | None) -> int:
        if key is None or (op == "SET" and value is None):
            raise ValueError("key and value must be strings")
        seq = self.state["seq"] + len(self._buffer) + 1
        self._buffer.append((seq, op, key, value))
        if len(self._buffer) >= self.config.wal_buffer_size:
            self.commit()
        return seq

    def commit(self) -> None:
        """Make the buffered writes durable, as one group."""
        if self._buffer:
            rows = self.spark.createDataFrame(self._buffer, "seq bigint, op string, key string, value string")
            self._buffer = []
            self._append(mvcc.cells_from_mutations(rows, strict=True))

    @staticmethod
    def _checked(mutations: DataFrame) -> DataFrame:
        """``mutations``, failing the job at one without a known operation, a key, or a value to set."""
        op = spelled(F.col("op"))
        known = op.isin("set", "delete") & F.col("key").isNotNull() & ((op == "delete") | F.col("value").isNotNull())
        return mutations.where(F.when(~F.coalesce(known, F.lit(False)), F.raise_error(F.lit("a mutation without operation, key or value")).cast("boolean")).otherwise(True))

    def write(self, mutations: DataFrame, order: list[str]) -> int:
        """Append a batch of ``op``, ``key``, ``value`` in the order of ``order``; the store numbers it on from its last write.

        Rows with another operation, a null key, or a set of null are refused: the whole batch fails.
        """
        self.commit()
        numbered = with_position(self._checked(mutations), order, "_pos").withColumn("seq", F.col("_pos") + self.state["seq"])
        return self._append(mvcc.cells_from_mutations(numbered.select("seq", "op", "key", "value"), strict=True))

    def apply_batch(self, mutations: DataFrame, feed: str, batch_no: int) -> int:
        """Append a numbered batch of a feed, whose mutations have sequence numbers of their own.

        The number is published with the data: a batch that is delivered again changes nothing, neither reads nor figures. Refused rows fail the batch, as in :meth:`write`.
        """
        self.commit()
        if batch_no <= self.state["applied"].get(feed, -1):
            return self.state["seq"]
        return self._append(mvcc.cells_from_mutations(self._checked(mutations), strict=True), applied=self.state["applied"] | {feed: batch_no})

    def recover(self, segments: str) -> int:
        """Append what the log segments under a folder hold beyond the store's last sequence number, up to the first bad record; doing so again adds nothing."""
        self.commit()
        rows = replay_wal(self.spark, segments).where(F.col("seq") > self.state["seq"])
        return self._append(mvcc.cells_from_mutations(rows, strict=True))

    def _append(self, cells: DataFrame, **changes) -> int:
        folder = self.table.write(cells.select(*CELLS.fieldNames()))
        new = self.table.read([folder], CELLS)
        seq, user, size = new.agg(F.max("seq"), F.coalesce(F.sum(user_size()), F.lit(0)), F.coalesce(F.sum(cell_size()), F.lit(0))).first()
        self._publish(
            log=[*self.state["log"], folder], seq=max(seq or 0, self.state["seq"]), user_bytes=self.state["user_bytes"] + user, log_size=self.state["log_size"] + size, **changes
        )
        if self.state["log_size"] >= self.config.max_memtable_size:
            self.flush()
        return self.state["seq"]

    def _write_files(self, cells: DataFrame, level: int) -> list[dict]:
        """``cells`` as sorted files of ``level``, with Parquet's statistics and bloom filters on the key.

        At level 0 one file; below, files are closed before the key that would exceed the
        level's size. A file is a folder, range-partitioned by key and sequence number: a
        key of many versions is spread over its parts.
        """
        rows = cells.withColumn("crc", F.crc32(sstable_payload()))
        target = self.config.level_chunk_size(level)
        if level and (rows.agg(F.sum(cell_size())).first()[0] or 0) > target:
            rows = rows.join(layout.compaction_chunks(cells, target).select("key", F.col("chunk").alias("_chunk")), "key")
        else:
            rows = rows.withColumn("_chunk", F.lit(0).cast("bigint"))
        ordered = rows.select(*_STORED.fieldNames(), "_chunk").repartitionByRange("_chunk", "key", "seq").sortWithinPartitions("_chunk", "key", "seq")
        options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.fpp#key": str(self.config.bloom_false_positive_rate)}
        folder = self.table.write(ordered, ["_chunk"], **options)
        chunks = self.table.read([folder], T.StructType([*_STORED.fields, T.StructField("_chunk", T.LongType())])).groupBy("_chunk").agg(F.min("key"), F.max("key"), F.count("*"))
        # A row per file.
        made = [(f"{folder}/_chunk={n}", low, high, records) for n, low, high, records in sorted(map(tuple, chunks.collect()))]
        return [{"folder": f, "min_key": low, "max_key": high, "records": records, "bytes": self.table.files.size(f"{self.path}/{f}")} for f, low, high, records in made]

    def flush(self) -> None:
        """The log, all versions of it, as a file of level 0; levels that are due are compacted."""
        self.commit()
        if not self.state["log"]:
            return
        self._replace(set(), self._write_files(self.table.read(self.state["log"], CELLS), 0), 0, log=[], log_size=0)
        level = 0
        while sum(f["level"] == level for f in self.state["files"]) >= self.config.level_file_limit(level):
            self.compact(level)
            level += 1

    def compact(self, level: int = 0) -> None:
        """Merge a level with the overlapping files of the next one; files of that level which don't overlap stay as they are.

        Versions that the oldest open snapshot may read stay; without one, tombstones go that no deeper file needs.
        """
        files = self.state["files"]
        chosen = [f for f in files if f["level"] == level]
        if not chosen:
            return
        low, high = min(f["min_key"] for f in chosen), max(f["max_key"] for f in chosen)
        chosen += [f for f in files if f["level"] == level + 1 and f["min_key"] <= high and f["max_key"] >= low]
        numbers = {f["file_no"] for f in chosen}
        deeper = [(f["min_key"], f["max_key"]) for f in files if f["level"] > level + 1]
        ranges = self.spark.createDataFrame(deeper, "min_key string, max_key string") if deeper else None
        cells = self.table.read([f["folder"] for f in chosen], _STORED).drop("crc")
        merged = written(compaction.compact(cells, min(self._pins, default=None), ranges), "merged")
        self._replace(numbers, self._write_files(merged, level + 1), level + 1)

    def _replace(self, gone: set[int], made: list[dict], level: int, **changes) -> None:
        """Publish new files of ``level`` in place of others."""
        n = self.state["next_file"]
        new = [f | {"level": level, "file_no": n + i} for i, f in enumerate(made, 1)]
        self._publish(
            files=[f for f in self.state["files"] if f["file_no"] not in gone] + new, next_file=n + len(new), disk_bytes=self.state["disk_bytes"] + sum(f["bytes"] for f in made), **changes
        )

    def vacuum(self) -> list[str]:
        """Delete the folders that the current version doesn't name; call it when no DataFrame of an older one is in use."""
        return self.table.vacuum(self._folders(self.state))

    # --- reads

    def cells(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """All versions in a range of keys, of the log and of the files that may hold it."""
        files = [f["folder"] for f in self.state["files"] if (high is None or f["min_key"] <= high) and (low is None or f["max_key"] >= low)]
        every = self.table.read(files, _STORED).drop("crc").unionByName(self.table.read(self.state["log"], CELLS))
        if self._buffer:
            rows = self.spark.createDataFrame(self._buffer, "seq bigint, op string, key string, value string")
            every = every.unionByName(mvcc.cells_from_mutations(rows))
        return mvcc.in_range(every, low, high)

    def get(self, key: str, at: int | None = None) -> str | None:
        row = mvcc.live(self.cells(key, key), at).first()
        return row["value"] if row else None

    def multi_get(self, probes: DataFrame, at: int | None = None) -> DataFrame:
        return mvcc.multi_get(self.cells(), probes, at)

    def scan(self, start: str | None = None, end: str | None = None, at: int | None = None) -> DataFrame:
        """Live keys and values of a range, ordered by key."""
        return mvcc.live(self.cells(start, end), at).orderBy("key")

    def iter(self, start: str | None = None, end: str | None = None, at: int | None = None) -> Iterator[tuple[str, str]]:
        """The rows of :meth:`scan` one by one, as they are at the time of the call, whatever is written meanwhile."""
        frozen = self.scan(start, end, self.seq if at is None else at)
        return ((r["key"], r["value"]) for r in frozen.toLocalIterator())

    def dump(self, at: int | None = None) -> DataFrame:
        return mvcc.live(self.cells(), at)

    @property
    def seq(self) -> int:
        """The last sequence number given."""
        return self.state["seq"] + len(self._buffer)

    @contextmanager
    def snapshot(self) -> Iterator[int]:
        """Pin the current sequence number; equal pins are counted."""
        at = self.seq
        self._pins[at] = self._pins.get(at, 0) + 1
        try:
            yield at
        finally:
            self._pins[at] -= 1
            if not self._pins[at]:
                del self._pins[at]

    def manifest(self) -> DataFrame:
        rows = [(f["level"], f"sst_{f['file_no']}", f["min_key"], f["max_key"]) for f in self.state["files"]]
        return self.spark.createDataFrame(rows, MANIFEST)

    def verify(self) -> DataFrame:
        """The records in files whose checksum isn't that of their content."""
        rows = self.table.read([f["folder"] for f in self.state["files"]], _STORED)
        return rows.where(~F.col("crc").eqNullSafe(F.crc32(sstable_payload())))

    def stats(self) -> dict:
        """Files per level, bytes, memtable, and write amplification, as a record."""
        self.commit()
        files, user, disk = self.state["files"], self.state["user_bytes"], self.state["disk_bytes"]
        levels: dict[int, int] = {}
        for f in files:
            levels[f["level"]] = levels.get(f["level"], 0) + 1
        return {
            "sstables_per_level": levels,
            "total_sstables": len(files),
            "data_bytes": sum(f["bytes"] for f in files),
            "memtable_size": self.state["log_size"],
            "memtable_keys": mvcc.live(self.table.read(self.state["log"], CELLS)).count(),
            "seq": self.seq,
            "active_snapshots": dict(sorted(self._pins.items())),
            "bytes_written_user": user,
            "bytes_written_disk": disk,
            "write_amplification": disk / user if user else 0.0,
        }

    def close(self) -> None:
        """Make everything durable and give up the lock; closing twice is harmless."""
        if self._lock is not None:
            self.commit()
            self._unlock()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()
