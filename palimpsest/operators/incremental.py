"""Processing only what is new or changed, with the target itself as the state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.sources.bucketed import BucketedRuns
from palimpsest.sources.versioned import VersionedTable


class IncrementalTarget:
    """Output rows that carry the key and version of the source row they were made from.

    A run anti-joins the source against those and publishes its output as the next
    version of the target. There is no progress mark beside the output: a run that
    fails has published nothing and its rows stay pending; one that was published
    holds its rows' keys and versions, so that none is done twice.

    The target lies in hash buckets of key and version, in a few runs: the source is
    shuffled to them and they are not. A source that is read by a bound on its version
    (``source.where(...)`` before :meth:`pending`) costs as much as what the bound leaves.

    ``columns`` are further output columns. Source rows with a null in ``key`` or
    ``version`` are compared as values, null equalling null. Rows repeated in the
    source are processed once. An empty source publishes a version without new rows. Names in ``key``, ``version`` and ``columns`` must
    differ; other columns of the source are ignored (``_id`` is the target's own and is replaced). A target that exists keeps its
    number of buckets; another definition is refused.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: Sequence[tuple[str, str]], version: tuple[str, str], columns: Sequence[tuple[str, str]] = (), buckets: int | None = None
    ) -> None:
        self.table = VersionedTable(spark, path)
        self.id_columns = [n for n, _ in key] + [version[0]]
        self.schema = T.DataType.fromDDL(", ".join(f"`{n}` {t}" for n, t in [*key, version, *columns]))
        # Key and version as one struct: structs are equal if their fields are, nulls included, so that plain equality will do.
        self._types = [self.schema[c].dataType for c in self.id_columns]
        identity = T.StructType([T.StructField(f"i{i}", t) for i, t in enumerate(self._types)])
        rest = [f for f in self.schema if f.name not in self.id_columns]
        self.runs = BucketedRuns(
            self.table, T.StructType([T.StructField("_id", identity), *(T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(rest))]), ["_id"], buckets, self.table.content().get("target")
        )
        self._rest = [f.name for f in rest]

    def _identity(self, rows: DataFrame) -> Column:
        return F.struct(*(rows[f"`{c}`"].cast(t).alias(f"i{i}") for i, (c, t) in enumerate(zip(self.id_columns, self._types, strict=True))))

    def rows(self, version: int | None = None) -> DataFrame:
        back = {c: F.col(f"_id.i{i}") for i, c in enumerate(self.id_columns)} | {c: F.col(f"_c{i}") for i, c in enumerate(self._rest)}
        return self.runs.rows(self.table.content(version).get("runs", [])).select(*(back[f.name].alias(f.name) for f in self.schema))

    def pending(self, source: DataFrame) -> DataFrame:
        """The rows of ``source`` whose key and version no output row holds."""
        return self._pending(source).drop("_id")

    def _pending(self, source: DataFrame) -> DataFrame:
        """:meth:`pending` with ``_id``, by which its rows lie in their partitions."""
        identified = source.withColumn("_id", self._identity(source))
        tasks = int(self.table.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.runs.buckets < tasks:
            identified = identified.repartition(self.runs.buckets, "_id")
        content = self.table.content()
        self.runs.check(content.get("target"))
        for run in self.runs.each(content.get("runs", [])):
            done = run.select(F.col("_id").alias("_done")).hint("merge")
            identified = identified.join(done, identified["_id"] == done["_done"], "left_anti")
        # What is pending is little beside the source, so repeats go after the joins.
        return identified.dropDuplicates(["_id"])

    def _published(self, runs: list[dict], after: int) -> int:
        self.runs.check(self.table.content(after).get("target"))
        return self.table.publish({"runs": runs, "target": self.runs.definition()}, after)

    def publish(self, output: DataFrame, after: int | None = None) -> int:
        """Write ``output`` and publish it, on top of version ``after`` (else the latest), as the next version."""
        after = self.table.latest() if after is None else after
        rest = [output[f"`{c}`"].cast(self.schema[c].dataType).alias(f"_c{i}") for i, c in enumerate(self._rest)]
        if "_id" in output.columns and output.schema["_id"].dataType == self.runs.schema["_id"].dataType:
            stored = output.select("_id", *rest)  # still as :meth:`run` had it partitioned, unless it was processed otherwise
        else:
            stored = output.select(self._identity(output).alias("_id"), *rest).repartition(self.runs.buckets, "_id")
        run = self.runs.write(stored)
        return self._published(self.runs.merged([*self.table.content(after).get("runs", []), *([run] if run else [])], lambda r: r.repartition(self.runs.buckets, "_id")), after)

    def retract(self, condition: Callable[[DataFrame], DataFrame]) -> int:
        """Publish the target without some rows, which thereby are pending again; ``condition`` maps :meth:`rows` to those that stay. The target is written anew."""
        after = self.table.latest()
        kept = condition(self.rows(after))
        stored = kept.select(self._identity(kept).alias("_id"), *(kept[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(self._rest)))
        run = self.runs.write(stored.repartition(self.runs.buckets, "_id"))
        return self._published([run] if run else [], after)

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """One run; of two at a time one raises Conflict and leaves nothing."""
        after = self.table.latest()
        return self.publish(process(self._pending(source)), after)
