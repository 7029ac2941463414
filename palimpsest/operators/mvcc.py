"""Reads of versioned cells: the newest visible version of each key, as of any sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.blocks import next_in_key
from palimpsest.operators.changefeed import spelled
from palimpsest.operators.joins import estimated_bytes, is_small, repeated


def cells_from_mutations(mutations: DataFrame, strict: bool = False) -> DataFrame:
    """Mutations (seq, op, key, value) as cells; a delete's value is dropped.

    ``op`` counts without outer blanks (of any kind) and case. Rows with another or
    null operation are no cells: they are left out, as membership entries are, or, where ``strict``, fail the job.
    """
    op = spelled(F.col("op"))
    known = F.coalesce(op.isin("set", "delete"), F.lit(False))
    if strict:
        known = F.when(~known, F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))).cast("boolean")).otherwise(True)
    return mutations.where(known).select("key", F.col("seq").cast("bigint").alias("seq"), F.when(op == "set", F.col("value")).alias("value"), (op == "delete").alias("is_tombstone"))


def resolve(cells: DataFrame, at: int | None = None) -> DataFrame:
    """The newest version with ``seq <= at`` (any, without ``at``) of each key, tombstones included.

    The filter stands before the aggregate and reaches the scan; the aggregate is
    partial before its shuffle, so a hot key is one row per task.
    """
    visible = cells if at is None else cells.where(F.col("seq") <= at)
    # The sequence number leads the struct: its maximum is the newest version.
    newest = visible.groupBy("key").agg(F.max(F.struct("seq", "is_tombstone", "value")).alias("_v"))
    return newest.select("key", F.col("_v.seq").alias("seq"), F.col("_v.value").alias("value"), F.col("_v.is_tombstone").alias("is_tombstone"))


def live(cells: DataFrame, at: int | None = None) -> DataFrame:
    """Keys and values that exist as of ``at``. Tombstones go after the choice of version, or deleted keys would come back."""
    return resolve(cells, at).where("NOT is_tombstone").select("key", "value")


def get(cells: DataFrame, key: str, at: int | None = None) -> DataFrame:
    """One row, or none if the key is missing or deleted."""
    return live(cells.where(F.col("key") == key), at)


def scan(cells: DataFrame, start: str | None = None, end: str | None = None, at: int | None = None) -> DataFrame:
    """Live keys from ``start`` to ``end``, both included; empty if they cross; unbounded where None."""
    return live(in_range(cells, start, end), at)


def in_range(cells: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All versions in a range of keys."""
    if start is not None:
        cells = cells.where(F.col("key") >= start)
    if end is not None:
        cells = cells.where(F.col("key") <= end)
    return cells


#: Probes filter the cells first if the cells are estimated to be this many times as large.
_FILTER_WORTH = 8
#: Bytes of probes, by the optimizer's estimate, above which a repeated probe is shared by all tasks.
_MANY_PROBES = 256_000_000


def multi_get(cells: DataFrame, probes: DataFrame, at: int | None = None) -> DataFrame:
    """Each probe ``key`` with its live ``value``, or null; a key asked for repeatedly comes as often. Other columns of ``probes`` are ignored.

    Probes and visible versions are united and reduced by key in one partial
    aggregate and one shuffle; neither a hot key nor a hot probe is gathered. Where
    the probes are few beside the cells, and measured to be within the bounds of a
    broadcast, they filter the cells at the scan first.
    """
    visible = cells if at is None else cells.where(F.col("seq") <= at)
    if estimated_bytes(visible) > _FILTER_WORTH * estimated_bytes(probes):
        asked = probes.select("key").distinct()
        if is_small(asked):
            visible = visible.join(F.broadcast(asked), "key", "left_semi")
    version = F.struct("seq", "is_tombstone", "value")
    held = visible.where("key IS NOT NULL").select("key", version.alias("_v"), F.lit(0).cast("bigint").alias("_asked"))
    wanted = probes.select("key", F.lit(None).cast(held.schema["_v"].dataType).alias("_v"), F.lit(1).cast("bigint").alias("_asked"))
    found = held.unionByName(wanted).groupBy("key").agg(F.max("_v").alias("_v"), F.sum("_asked").alias("_asked")).where("_asked > 0")
    return repeated(found.select("key", F.when(~F.col("_v.is_tombstone"), F.col("_v.value")).alias("value"), "_asked"), "_asked", estimated_bytes(probes) > _MANY_PROBES)


def version_blocks(cells: DataFrame, width: int = 1000) -> DataFrame:
    """The versions of each key in order of sequence number, in arrays of at most ``width`` numbers' span."""
    return cells.groupBy("key", F.floor(F.col("seq") / width).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", "is_tombstone", "value"))).alias("versions"))


def version_intervals(cells: DataFrame) -> DataFrame:
    """Each version with ``superseded_at``, the sequence number of the key's next version; null for the newest."""
    return next_in_key(cells, ["key"], "seq", "superseded_at")


def snapshot_diff(cells: DataFrame, before: int, after: int) -> DataFrame:
    """Keys whose live value differs between two snapshots: ``added``, ``removed`` or ``changed``. One pass, one shuffle."""
    v = F.struct("seq", "is_tombstone", "value")
    sides = cells.where(F.col("seq") <= max(before, after)).groupBy("key").agg(F.max(F.when(F.col("seq") <= before, v)).alias("b"), F.max(F.when(F.col("seq") <= after, v)).alias("a"))
    old, new = F.when(~F.col("b.is_tombstone"), F.col("b.value")), F.when(~F.col("a.is_tombstone"), F.col("a.value"))
    was, is_ = F.coalesce(~F.col("b.is_tombstone"), F.lit(False)), F.coalesce(~F.col("a.is_tombstone"), F.lit(False))
    change = F.when(is_ & ~was, "added").when(was & ~is_, "removed").when(was & is_ & ~old.eqNullSafe(new), "changed")
    return sides.select("key", change.alias("change"), old.alias("old_value"), new.alias("new_value")).where("change IS NOT NULL")
