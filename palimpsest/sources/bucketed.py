"""Runs of rows in hash buckets on disk, which are joined on their keys without being shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.sources.versioned import VersionedTable

#: Runs of like size that are merged into one.
MERGED_RUNS = 8


class BucketedRuns:
    """Rows of ``schema`` in hash buckets of the columns ``by``, kept as runs: Parquet folders of ``table``, written once.

    A run is visible once a version of ``table`` names it, so an append is as atomic as
    that version. The number of buckets, the columns and the schema are part of what the
    owner publishes (:meth:`definition`): reopened, the stored number holds whatever the
    session is set to, and another definition is refused. A new table takes the
    number of buckets given, else the session's shuffle partitions; a bucket should
    fit a task.

    Joined run by run on all of ``by`` with plain equality, no run is shuffled. Runs of
    like size are merged (:meth:`merged`), so that there are about as many as the
    logarithm of their number; a merge shuffles what it merges, each row a logarithmic number of times in all.
    """

    def __init__(self, table: VersionedTable, schema: T.StructType, by: Sequence[str], buckets: int | None = None, stored: dict | None = None) -> None:
        self.table, self.schema, self.by = table, schema, list(by)
        self.buckets = buckets or (stored or {}).get("buckets") or int(table.spark.conf.get("spark.sql.shuffle.partitions"))
        self.check(stored)

    def check(self, stored: dict | None) -> None:
        """Refuse a table that was defined otherwise, for instance by another session since this object was made."""
        if stored is not None and stored != self.definition():
            raise ValueError(f"{self.table.path} is defined as {stored}, not as {self.definition()}")

    def definition(self) -> dict:
        return {"buckets": self.buckets, "by": self.by, "schema": self.schema.simpleString()}

    def _named(self) -> str:
        return f"run_{uuid.uuid4().hex}"

    def aligned(self, rows: DataFrame) -> DataFrame:
        """``rows``, which an aggregate by ``by`` has left in the session's shuffle partitions, in as many partitions as there are buckets."""
        same = self.buckets == int(self.table.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows if same else rows.repartition(self.buckets, *self.by)

    def write(self, rows: DataFrame) -> dict | None:
        """Write ``rows``, partitioned by bucket already, as a run; None if there are none."""
        spark, folder, name = self.table.spark, self.table.new_folder(), self._named()
        path = f"{self.table.path}/{folder}"
        try:
            writer = rows.select(*self.schema.names).write.format("parquet").bucketBy(self.buckets, *self.by).sortBy(*self.by)
            writer.option("path", path).saveAsTable(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the definition alone: the files are external
        if not any(n.endswith(".parquet") for n in self.table.files.names(path)):
            return None
        return {"folder": folder, "bytes": self.table.files.size(path)}

    def each(self, runs: Sequence[dict]) -> list[DataFrame]:
        """Every run by itself, known to lie in its buckets."""
        spark, out = self.table.spark, []
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        keys = ", ".join(f"`{c}`" for c in self.by)
        for run in runs:
            name = self._named()
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.table.path}/{run['folder']}'")
            out.append(spark.table(name))
            spark.sql(f"DROP TABLE {name}")
        return out

    def rows(self, runs: Sequence[dict]) -> DataFrame:
        """The rows of all runs."""
        return self.table.read([r["folder"] for r in runs], self.schema)

    def merged(self, runs: list[dict], reduce: Callable[[DataFrame], DataFrame]) -> list[dict]:
        """``runs`` with the newest ones of like size merged, if there are several; ``reduce`` groups rows by ``by``."""
        if not runs:
            return runs
        first, size = len(runs) - 1, runs[-1]["bytes"]
        while first and runs[first - 1]["bytes"] <= 2 * size:
            first -= 1
            size += runs[first]["bytes"]
        if len(runs) - first < MERGED_RUNS:
            return runs
        made = self.write(self.aligned(reduce(self.rows(runs[first:]))))
        return [*runs[:first], *([made] if made else [])]
