"""Replication of a log to a majority, catch-up, log compaction and membership, over tables of entries and acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.changefeed import spelled
from palimpsest.operators.joins import lookup_join
from palimpsest.operators.mvcc import cells_from_mutations, live


def quorum(nodes: int) -> int:
    """Acknowledgements, the leader's included, that make a majority."""
    return nodes // 2 + 1


def acknowledged(acks: DataFrame, nodes: int) -> DataFrame:
    """Each index with its acknowledging nodes and whether these are a majority. Repeated acknowledgements count once."""
    return acks.groupBy("index").agg(F.countDistinct("node").alias("acks")).withColumn("committed", F.col("acks") >= quorum(nodes))


def committed(log: DataFrame, acks: DataFrame, nodes: int) -> DataFrame:
    """The entries that a majority acknowledged; the others stay in the log but have no effect."""
    return log.join(acknowledged(acks, nodes).where("committed").select("index"), "index", "left_semi")


def data_cells(log: DataFrame) -> DataFrame:
    """Set and delete entries as cells; membership entries change no key."""
    return cells_from_mutations(log.select(F.col("index").alias("seq"), spelled(F.col("operation")).alias("op"), "key", "value"))


def applied(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Live keys and values after the log, or after its entries up to an index."""
    return live(data_cells(log), upto)


def received_once(deliveries: DataFrame) -> DataFrame:
    """One entry per index; of copies that differ the least (operation, key, value, nulls first) counts."""
    one = deliveries.groupBy("index").agg(F.min(F.struct("operation", "key", "value")).alias("_e"))
    return one.select("index", "_e.operation", "_e.key", "_e.value")


def suffix(log: DataFrame, from_index: int) -> DataFrame:
    """What a node that has everything up to ``from_index`` lacks."""
    return log.where(F.col("index") > from_index)


def compacted(log: DataFrame, index: int) -> tuple[DataFrame, DataFrame]:
    """The snapshot of everything up to ``index``, and the log that remains."""
    return applied(log, index), suffix(log, index)


def restored(snapshot: DataFrame, index: int, log: DataFrame) -> DataFrame:
    """A snapshot (key, value) taken at ``index``, and the later entries. The snapshot replaces all earlier state."""
    base = snapshot.select("key", F.lit(index).cast("bigint").alias("seq"), "value", F.lit(False).alias("is_tombstone"))
    return live(base.unionByName(data_cells(suffix(log, index))))


def compaction_due(log: DataFrame, threshold: int, *by: str) -> DataFrame:
    """The log (of each ``by``) with its entries, whether they exceed ``threshold``, and the index that a snapshot would then be taken at. Copies of an entry count once."""
    once = log.where(F.col("index").isNotNull()).select(*by, "index").distinct()
    sizes = once.groupBy(*by).agg(F.count("*").alias("entries"), F.max("index").alias("_last"))
    due = F.col("entries") > threshold
    return sizes.select(*by, "entries", due.alias("is_due"), F.when(due, F.col("_last")).alias("snapshot_index"))


def to_send(log: DataFrame, followers: DataFrame) -> DataFrame:
    """What the next heartbeat sends to each of ``followers`` (node, index): the entries after its index, as ``node`` and the entry.

    The followers are the nodes of one cluster; a null index has nothing yet. Indices tell what is sent, not places in a list, so that a compacted log sends no less.
    """
    have = [(r["node"], -1 if r["index"] is None else r["index"]) for r in followers.select("node", "index").collect()]
    each = F.array(*(F.struct(F.lit(n).alias("node"), F.lit(i).cast("bigint").alias("has")) for n, i in have)) if have else F.expr("cast(array() AS array<struct<node:string,has:bigint>>)")
    return log.withColumn("_to", F.explode(F.filter(each, lambda f: f["has"] < F.col("index")))).select(F.col("_to.node").alias("node"), *log.columns)


def status(states: DataFrame) -> DataFrame:
    """Term, vote, leader and last index of each node (store_id, node_url), by its saved state with the highest run number, then saved last."""
    last = states.where("run_no IS NOT NULL").groupBy("store_id", "node_url").agg(F.max(F.struct("run_no", "saved_at", "term", "voted_for", "leader", "log_index")).alias("_s"))
    return last.select("store_id", "node_url", *(F.col(f"_s.{c}").alias(c) for c in ("term", "voted_for", "leader", "log_index")))


def members(log: DataFrame, *by: str) -> DataFrame:
    """The nodes (of each ``by``) after all membership entries; the last one about a node decides."""
    op = spelled(F.col("operation"))
    last = log.where(op.isin("add_node", "remove_node") & F.col("key").isNotNull() & F.col("index").isNotNull()).groupBy(*by, "key").agg(F.max(F.struct("index", op.alias("op"))).alias("_l"))
    return last.where("_l.op = 'add_node'").select(*by, F.col("key").alias("node"), F.col("_l.index").alias("since"))


def follower_reads(log: DataFrame, probes: DataFrame, follower_index: int) -> DataFrame:
    """Each probed key as the leader has it and as a follower at ``follower_index`` has it; ``stale`` where they differ. One pass over the log."""
    cells = lookup_join(data_cells(log), probes.select("key").distinct(), ["key"], "left_semi", spread=["seq"])
    v = F.struct("seq", "is_tombstone", "value")
    both = cells.groupBy("key").agg(F.max(v).alias("l"), F.max(F.when(F.col("seq") <= follower_index, v)).alias("f"))
    shown = both.select("key", F.when(~F.col("l.is_tombstone"), F.col("l.value")).alias("leader_value"), F.when(~F.col("f.is_tombstone"), F.col("f.value")).alias("follower_value"))
    return probes.join(shown, "key", "left").withColumn("stale", ~F.col("leader_value").eqNullSafe(F.col("follower_value")))
