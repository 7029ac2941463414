"""Keeping one copy of messages that are delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.joins import lookup_join
from palimpsest.sources.bucketed import BucketedRuns
from palimpsest.sources.versioned import VersionedTable, applied, with_applied

#: The partition of deliveries without an identifier; other names begin otherwise.
_UNNAMED = "u"


class DeliveryTable:
    """The winners among all deliveries so far, in partitions, with an index from identifier to partition.

    A delivery belongs to the partition that ``partition`` (an expression of it that
    is text, for instance the day of receipt) gives. A batch is applied so: its
    copies are reduced before any shuffle and joined to the index, which lies in hash
    buckets and isn't shuffled; the index tells which older partitions hold a copy; only
    these are read, joined to the batch's copies and reduced to single winners; a new
    version of the table names new folders in place of theirs, and the batch's other
    winners are added to the partitions they belong to. Index and partitions are
    published together. A batch with a number that was applied before has no effect.

    The winner of an identifier is its delivery with the least ``order`` (then of the
    least partition, then the least row), whatever batches they came in.

    * A delivery with a null in ``ident`` is a message of its own and is kept.
    * A null ``order`` comes last. A null partition is a partition.
    * Equal rows of a batch are one delivery. An empty batch publishes a version without new rows. Columns other than those of ``schema`` are ignored.
    * A table that exists keeps its number of buckets, whatever the session's settings; another definition is refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, ident: Sequence[str], order: str, partition: Column, buckets: int | None = None) -> None:
        if "_part" in schema.names or "_known" in schema.names:
            raise ValueError("_part and _known are the table's own columns")
        self.table, self.schema, self.ident, self.order, self.partition = VersionedTable(spark, path), schema, list(ident), order, partition
        self.spark = spark
        self.stored = T.StructType([*schema.fields, T.StructField("_part", T.StringType())])
        keys = [T.StructField(f"_i{i}", schema[c].dataType) for i, c in enumerate(self.ident)]
        # Where an identifier's winner is: the head of the struct by which winners are compared.
        self.place = T.StructType([T.StructField("last", T.BooleanType()), T.StructField("o", schema[order].dataType), T.StructField("part", T.StringType())])
        self.index = BucketedRuns(self.table, T.StructType([*keys, T.StructField("_place", self.place)]), [f.name for f in keys], buckets, self.table.content().get("index"))

    def _ids(self) -> list[Column]:
        return [F.col(f"`{c}`").alias(f"_i{i}") for i, c in enumerate(self.ident)]

    def _placed(self, rows: DataFrame) -> DataFrame:
        value = self.partition.cast("string")
        return rows.withColumn("_part", F.when(value.isNull(), "null").otherwise(F.concat(F.lit("v"), value)))

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """``rows`` as their identifier, ``_i<n>``, and the struct ``_row``, whose order of comparison is the rule."""
        o = F.col(f"`{self.order}`")
        rest = (F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(self._rest()))
        return self._placed(rows).select(*self._ids(), F.struct(o.isNull().alias("last"), o.alias("o"), F.col("_part").alias("part"), *rest).alias("_row"))

    def _winners(self, rows: DataFrame) -> DataFrame:
        """One row per identifier, of any number of copies."""
        return self._ranked(rows).groupBy(*self.index.by).agg(F.min("_row").alias("_row"))

    def _rest(self) -> list[str]:
        return [f.name for f in self.schema if f.name not in (self.order, *self.ident)]

    def _columns(self) -> list[Column]:
        """The table's columns and ``_part`` from what :meth:`_winners` returns."""
        back = {c: F.col(f"_row.r{i}") for i, c in enumerate(self._rest())} | {self.order: F.col("_row.o")} | {c: F.col(f"_i{i}") for i, c in enumerate(self.ident)}
        return [*(back[f.name].alias(f.name) for f in self.schema), F.col("_row.part").alias("_part")]

    def rows(self, version: int | None = None) -> DataFrame:
        """All kept deliveries of ``version`` (else the latest)."""
        return self._read(self.table.content(version).get("parts", {}))

    def _read(self, parts: dict[str, list[str]]) -> DataFrame:
        """The rows of these partitions, from their folders alone."""
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return self.table.read([f"{folder}/_part={escaped(p)}" for p, folders in parts.items() for folder in folders], self.schema)

    def _save(self, rows: DataFrame) -> tuple[str, list[str]]:
        """One folder per partition, and their names; a hot partition is split over tasks, small ones share a task."""
        folder = self.table.write(rows.hint("rebalance", "_part"), ["_part"])
        plain = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return folder, [plain(n[len("_part=") :]) for n in self.table.files.names(f"{self.table.path}/{folder}") if n.startswith("_part=")]

    def apply(self, batch: DataFrame, batch_no: int) -> int:
        """Apply one batch, numbered from 0, and return the version that holds it."""
        after = self.table.latest()
        content = self.table.content(after) or {"parts": {}, "runs": [], "batches": {}, "index": self.index.definition()}
        self.index.check(content["index"])
        if applied(content["batches"], batch_no):
            return after
        batch = batch.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        named = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in self.ident))

        # The batch's winners with the place of an older copy, if there is one. Identifiers are distinct on both sides.
        looked = self.index.aligned(self._winners(batch.where(named))).withColumn("_known", F.lit(None).cast(self.place))
        for run in self.index.each(content["runs"]):
            looked = looked.join(run.withColumnRenamed("_place", "_there").hint("merge"), self.index.by, "left").withColumn("_known", F.least("_known", "_there")).drop("_there")
        # Read several times; no version names it.
        passing = self.table.write(looked)
        incoming = self.table.read([passing], looked.schema)
        affected = sorted(r[0] for r in incoming.select("_known.part").where("part IS NOT NULL").distinct().collect()) if content["runs"] else []

        parts: dict[str, list[str]] = {p: list(f) for p, f in content["parts"].items()}
        fresh = incoming.where("_known IS NULL") if affected else incoming
        rows = fresh.select(*self._columns())
        if affected:
            # Every identifier is there once on either side, and each that comes in is in one of these partitions: its winner is
            # the less of two. Where few come in, they go to the partitions, which are then moved only to be written.
            history = self._ranked(self._read({p: parts.pop(p) for p in affected}))
            met = incoming.where("_known IS NOT NULL").select(*self.index.by, F.col("_row").alias("_met"))
            rows = rows.unionByName(lookup_join(history, met, self.index.by, "left", spread=self.index.by).withColumn("_row", F.least("_row", "_met")).select(*self._columns()))
        unnamed = batch.where(~named).distinct().withColumn("_part", F.lit(_UNNAMED))
        folder, made = self._save(rows.unionByName(unnamed))
        for p in made:
            parts.setdefault(p, []).append(folder)

        place = F.struct(*(F.col(f"_row.{f}").alias(f) for f in self.place.names))
        entries = incoming.where(F.col("_known").isNull() | (place < F.col("_known"))).select(*self.index.by, place.alias("_place"))
        run = self.index.write(entries.repartition(self.index.buckets, *self.index.by))
        runs = self.index.merged([*content["runs"], *([run] if run else [])], lambda r: r.groupBy(*self.index.by).agg(F.min("_place").alias("_place")))
        version = self.table.publish({"parts": parts, "runs": runs, "batches": with_applied(content["batches"], batch_no), "index": content["index"]}, after)
        self.table.files.delete(f"{self.table.path}/{passing}")
        return version

    def vacuum(self) -> list[str]:
        """Delete the folders that the latest version doesn't name, and older versions; call it when no DataFrame of them is in use."""
        content = self.table.content()
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        parts = [f"{folder}/_part={escaped(p)}" for p, folders in content.get("parts", {}).items() for folder in folders]
        return self.table.vacuum([*parts, *(r["folder"] for r in content.get("runs", ()))])


def surplus(deliveries: DataFrame, table: DeliveryTable, row_id: str) -> DataFrame:
    """The deliveries that were not kept, by their unique ``row_id``."""
    kept = table.rows().select(F.col(f"`{row_id}`").alias("_kept"))
    return deliveries.join(kept, deliveries[f"`{row_id}`"] == kept["_kept"], "left_anti")
