"""Filling containers of fixed capacity with items, in bounded space."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Open containers per specification and task.
OPEN_BINS = 128

PLACEMENT = "spec_id int, container_id bigint, item_id bigint, piece_no bigint, piece_size bigint, container_capacity bigint"


class OpenBins:
    """Best fit over at most ``limit`` open containers.

    Bit ``f`` of ``free`` is set if a container with ``f`` units left is open, so the
    tightest fit is the lowest set bit at or above the size. When one too many is
    open the fullest, the lowest set bit, is closed.
    """

    def __init__(self, capacity: int, first_id: int, limit: int = OPEN_BINS) -> None:
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.free, self.bins, self.open = 0, {}, 0

    def _put_back(self, container: int, left: int) -> None:
        if not left:
            return
        self.bins.setdefault(left, []).append(container)
        self.free |= 1 << left
        self.open += 1
        if self.open > self.limit:
            self._take((self.free & -self.free).bit_length() - 1)

    def _take(self, left: int) -> int:
        same = self.bins[left]
        container = same.pop()
        if not same:
            del self.bins[left]
            self.free ^= 1 << left
        self.open -= 1
        return container

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> int:
        """The container of an item that fits into one."""
        fitting = self.free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            container = self._take(left)
        else:
            left, container = self.capacity, self._new()
        self._put_back(container, left - size)
        return container

    def pieces(self, size: int) -> Iterator[tuple[int, int]]:
        """Container and size of each piece; only an item above the capacity has more than one."""
        while size > self.capacity:
            yield self._new(), self.capacity
            size -= self.capacity
        yield self.place(size), size


def _packer(specs: Sequence[tuple[int, int]], limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, OpenBins] | None = None
        for batch in batches:
            ids, sizes, tasks = (batch.column(i).to_pylist() for i in range(3))
            if not ids:
                continue
            if packers is None:
                # A task's containers are numbered from its own base; 2^40 of them are room enough.
                packers = {spec: OpenBins(capacity, tasks[0] << 40, limit) for spec, capacity in specs}
            out: tuple[list[int], ...] = ([], [], [], [], [], [])
            spec_col, container_col, item_col, piece_col, size_col, capacity_col = out
            for spec, packer in packers.items():
                for item, size in zip(ids, sizes, strict=True):
                    for n, (container, piece) in enumerate(packer.pieces(size)):
                        spec_col.append(spec)
                        container_col.append(container)
                        item_col.append(item)
                        piece_col.append(n)
                        size_col.append(piece)
                        capacity_col.append(packer.capacity)
            types = (pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["spec_id", "container_id", "item_id", "piece_no", "piece_size", "container_capacity"])

    return run


def pack(items: DataFrame, item_id: str, size: str, specs: Sequence[tuple[int, int]], open_bins: int = OPEN_BINS) -> DataFrame:
    """Put every item into containers of each specification ``(spec_id, capacity)``: one row per piece.

    Every input partition is packed for itself, without a shuffle; what that costs is
    at most ``open_bins`` part-filled containers per partition and specification.
    Items are taken in the order of ``item_id`` within a partition, so that a task
    that is run again packs alike. Only an item above the capacity is split: into
    full containers of its own and a rest that is packed as an item.

    * A null or negative size is 0; an item of size 0 takes part and has one piece.
    * A null ``item_id`` is an item; repeated ids are items each.
    * No items, no rows; no specifications, no rows. Capacities must be at least 1.
    * Other columns are ignored, whatever their names.
    """
    for _, capacity in specs:
        if capacity < 1:
            raise ValueError("a capacity must be at least 1")
    rows = items.select(
        F.col(f"`{item_id}`").cast("bigint").alias("id"),
        F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
        F.spark_partition_id().cast("bigint").alias("task"),
    )
    return rows.sortWithinPartitions("id", "size").mapInArrow(_packer([(int(s), int(c)) for s, c in specs], open_bins), PLACEMENT)


def fill(placements: DataFrame) -> DataFrame:
    """Containers, items, split items, and how much of the space is used, for each specification.

    ``least_containers`` is what any packing needs: the size of all items over the capacity, rounded up.
    """
    per = placements.groupBy("spec_id", "container_id").agg(
        F.max("container_capacity").alias("capacity"),
        F.sum("piece_size").alias("used"),
        F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)).alias("items"),
        F.sum(F.when(F.col("piece_no") == 1, 1).otherwise(0)).alias("split"),
    )
    return (
        per.groupBy("spec_id")
        .agg(
            F.max("capacity").alias("capacity"),
            F.count("*").alias("containers"),
            F.sum("items").alias("items"),
            F.sum("split").alias("split_items"),
            F.sum("used").alias("size"),
            F.max("used").alias("fullest"),
        )
        .withColumn("least_containers", F.ceil(F.col("size") / F.col("capacity")))
        .withColumn("fill_ratio", F.col("size") / (F.col("containers") * F.col("capacity")))
    )
