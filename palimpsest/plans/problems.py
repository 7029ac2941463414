"""Queries of the general data problems over the tables of a versioned, replicated store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.changefeed import rebuild
from palimpsest.operators.dedup import DeliveryTable, surplus
from palimpsest.operators.diff import diff_tagged
from palimpsest.operators.incremental import IncrementalTarget
from palimpsest.operators.joins import lookup_join
from palimpsest.plans.tables import in_batches, table
from palimpsest.session import scratch_path, written

#: Deliveries that are applied in one batch, at most, and the least number of batches.
DELIVERY_BATCH, DELIVERY_BATCHES = 2_000_000, 4


# --- 2: applying a change feed


def p2_state(spark: SparkSession, sf: str) -> DataFrame:
    """Current keys, values and positions of both feeds of each store."""
    log = table(spark, sf, "mutation_log").select(F.lit("mutation_log").alias("feed"), "store_id", "key", F.col("seq").alias("pos"), "op", "value")
    replicated = (
        table(spark, sf, "replication_log")
        .where(F.col("node_role") == "leader")
        .select(F.lit("replication_log").alias("feed"), "store_id", "key", F.col("index").alias("pos"), F.col("operation").alias("op"), "value")
    )
    return rebuild(log.unionByName(replicated), ["feed", "store_id", "key"], "pos", "op", ["value"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_state(spark, sf).select("feed", "store_id", "key", "pos")


# --- 3: differences between two copies


def common_snapshots(chunks: DataFrame) -> DataFrame:
    """Keys and values of the snapshots with the highest index that both nodes of a store hold: one row per key and chunk."""
    both = (
        chunks.groupBy("store_id", "index")
        .agg(F.max((F.col("node_role") == "leader").cast("int")).alias("l"), F.max((F.col("node_role") == "follower").cast("int")).alias("f"))
        .where("l = 1 AND f = 1")
        .groupBy("store_id")
        .agg(F.max("index").alias("index"))
    )
    both = written(both, "common")  # a row per store
    held = lookup_join(chunks.select("store_id", "index", "node_role", "data"), both, ["store_id", "index"], "left_semi", spread=["data"])
    return held.select("store_id", "node_role", F.explode(F.from_json("data", "map<string,string>")).alias("row_key", "value"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "replication_log").withColumn("row_key", F.col("index").cast("string"))
    entries = diff_tagged(log, "node_role", ["store_id", "row_key"], ["operation", "key", "value"], "leader", "follower", "only_leader", "only_follower")
    snapshots = diff_tagged(common_snapshots(table(spark, sf, "snapshot_chunk")), "node_role", ["store_id", "row_key"], ["value"], "leader", "follower", "only_leader", "only_follower")
    columns = ["dataset", "store_id", "row_key", "field"]
    return entries.withColumn("dataset", F.lit("replication_log")).select(columns).unionByName(snapshots.withColumn("dataset", F.lit("snapshot")).select(columns))


def p3_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Differences per store, dataset and field."""
    return p3_found(spark, sf).groupBy("dataset", "store_id", "field").agg(F.count("*").alias("differences"))


# --- 4: processing only new or changed records


def _address(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/$", ""))


#: Publishes in which the shipping runs are replayed: each covers the next part of the run numbers.
REPLAYS = 4

_SHIPMENT = [("store_id", "bigint"), ("node_url", "string"), ("index", "bigint")]


def followers(states: DataFrame) -> DataFrame:
    """The followers of each store, from its successful run with the highest number."""
    last = states.where("lower(outcome) = 'ok' AND run_no IS NOT NULL").groupBy("store_id").agg(F.max(F.struct("run_no", "leader", "nodes")).alias("run"))
    return (
        last.select("store_id", F.col("run.leader").alias("leader"), F.explode("run.nodes").alias("node_url"))
        .where("node_url IS NOT NULL AND NOT (node_url <=> leader)")
        .select("store_id", "node_url", _address(F.col("node_url")).alias("address"))
        .distinct()
    )


def bases(states: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """Of each store and address, for each of ``bounds``, the index confirmed by, and the start of, the last successful run up to that number which gives it one: ``confirmed<i>``, ``started<i>``."""
    confirmed = states.where("lower(outcome) = 'ok' AND run_no IS NOT NULL").select("store_id", "run_no", "started_at", F.explode("follower_indices").alias("url", "confirmed")).where("confirmed IS NOT NULL")
    run = F.struct("run_no", "confirmed", "started_at")
    last = confirmed.groupBy("store_id", _address(F.col("url")).alias("address")).agg(*(F.max(F.when(F.col("run_no") <= n, run)).alias(f"_{i}") for i, n in enumerate(bounds)))
    return last.select("store_id", "address", *(F.col(f"_{i}.{c}").alias(f"{n}{i}") for i in range(len(bounds)) for c, n in (("confirmed", "confirmed"), ("started_at", "started"))))


def shipments(entries: DataFrame, receivers: DataFrame) -> DataFrame:
    """Every entry for every follower of its store. Entries of a store are met by that store's few followers."""
    return lookup_join(entries, receivers, ["store_id"], spread=["index"])


def _covered(i: int) -> str:
    """Whether the base up to the i-th bound confirms an entry. A run that doesn't say when it began can't tell that an entry came after it."""
    return f"coalesce(index <= confirmed{i} AND NOT coalesce(first_appended_at > started{i}, false), false)"


def shipped_by_runs(spark: SparkSession, entries: DataFrame, states: DataFrame, receivers: DataFrame) -> IncrementalTarget:
    """The target of the shipping runs, replayed in order of their numbers: what a successful run confirms is published as output, a run that did not succeed leaves nothing.

    Every publish covers the next part of the run numbers and takes of the source only
    what its runs confirm beyond the runs before. A follower whose later run confirms
    less than an earlier one has the rest retracted: its last run decides.
    """
    target = IncrementalTarget(spark, scratch_path(spark, "shipped"), _SHIPMENT, ("first_appended_at", "timestamp_ntz"))
    low, high = states.agg(F.min("run_no"), F.max("run_no")).first()
    if low is None:
        return target
    bounds = [low + (high - low + 1) * i // REPLAYS - 1 for i in range(1, REPLAYS + 1)]
    based = written(receivers.join(bases(states, bounds), ["store_id", "address"], "left"), "bases")  # a row per follower
    less = [F.expr(f"confirmed{i} < confirmed{i - 1} OR started{i} < started{i - 1} OR (confirmed{i - 1} IS NOT NULL AND started{i - 1} IS NULL AND started{i} IS NOT NULL)") for i in range(1, REPLAYS)]
    fell = [False, *based.agg(*(F.coalesce(F.bool_or(c), F.lit(False)) for c in less)).first()]
    source = shipments(entries, based)
    for i in range(REPLAYS):
        if fell[i]:
            now = based.where(f"confirmed{i} IS NOT NULL").select("store_id", "node_url", f"confirmed{i}", f"started{i}")
            target.retract(lambda rows, now=now, i=i: lookup_join(rows, now, ["store_id", "node_url"], "left", spread=["index"]).where(_covered(i)))
        target.run(source.where(_covered(i) + (f" AND NOT {_covered(i - 1)}" if i else "")))
    return target


def _shipping(spark: SparkSession, sf: str) -> tuple[DataFrame, IncrementalTarget]:
    """The source, every leader's entry with its version (the first time it was appended) for every follower, and the target of the runs so far."""
    states = table(spark, sf, "raft_state")
    entries = (
        table(spark, sf, "replication_log")
        .where((F.col("node_role") == "leader") & F.col("index").isNotNull())
        .groupBy("store_id", "index")
        .agg(F.min("appended_at").alias("first_appended_at"))
    )
    entries, receivers = written(entries, "entries"), written(followers(states), "followers")
    return shipments(entries, receivers).drop("address"), shipped_by_runs(spark, entries, states, receivers)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _shipping(spark, sf)
    return target.pending(source).select("store_id", "node_url", "index")


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows pending before the next run, after a run that failed before publishing, and after one that published."""
    source, target = _shipping(spark, sf)

    def pending(step: str) -> DataFrame:
        return target.pending(source).agg(F.count("*").alias("pending")).select(F.lit(step).alias("step"), "pending")

    before = pending("before")
    target.table.write(target.pending(source).select("store_id", "node_url", "index", "first_appended_at"))  # never published
    failed = pending("after a failed run")
    target.run(source)
    return before.unionByName(failed).unionByName(pending("after a run"))


# --- 5: messages delivered more than once

_REQUEST = "delivery_id bigint, store_id bigint, node_url string, batch_no bigint, index bigint, operation string, key string, value string, received_at timestamp_ntz"


def delivered(spark: SparkSession, sf: str) -> DeliveryTable:
    """All deliveries applied in batches in order of receipt, partitioned by day of receipt."""
    kept = DeliveryTable(spark, scratch_path(spark, "deliveries"), T.DataType.fromDDL(_REQUEST), ["store_id", "node_url", "index"], "delivery_id", F.to_date("received_at"))
    for b, batch in enumerate(in_batches(table(spark, sf, "replicate_request"), "delivery_id", DELIVERY_BATCH, DELIVERY_BATCHES)):
        kept.apply(batch, b)
    return kept


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "replicate_request")
    return surplus(rows.where("delivery_id IS NOT NULL"), delivered(spark, sf), "delivery_id").select("delivery_id")


def p5_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The deliveries that are kept."""
    return delivered(spark, sf).rows().select("delivery_id", "store_id", "node_url", "index")


QUERIES = {
    "p2_found": p2_found,
    "p2_state": p2_state,
    "p3_found": p3_found,
    "p3_summary": p3_summary,
    "p4_found": p4_found,
    "p4_runs": p4_runs,
    "p5_found": p5_found,
    "p5_kept": p5_kept,
}

_P2 = """
WITH feeds AS (
  SELECT 'mutation_log' AS feed, store_id, key, seq AS pos, lower(regexp_replace(op, '^\\s+|\\s+$', '', 'g')) AS op, value FROM mutation_log
  UNION ALL
  SELECT 'replication_log', store_id, key, index, lower(regexp_replace(operation, '^\\s+|\\s+$', '', 'g')), value FROM replication_log WHERE node_role = 'leader'
), last AS (
  SELECT *, row_number() OVER (PARTITION BY feed, store_id, key ORDER BY pos DESC) AS rn
  FROM feeds WHERE key IS NOT NULL AND pos IS NOT NULL AND op IN ('set', 'delete')
)
"""

_P3 = """
WITH l AS (SELECT DISTINCT store_id, index, operation, key, value FROM replication_log WHERE node_role = 'leader'),
f AS (SELECT DISTINCT store_id, index, operation, key, value FROM replication_log WHERE node_role = 'follower'),
e AS (
  SELECT coalesce(l.store_id, f.store_id) AS store_id, CAST(coalesce(l.index, f.index) AS VARCHAR) AS row_key,
    CASE WHEN f.store_id IS NULL THEN ['only_leader'] WHEN l.store_id IS NULL THEN ['only_follower'] ELSE
      list_filter([CASE WHEN l.operation IS DISTINCT FROM f.operation THEN 'operation' END, CASE WHEN l.key IS DISTINCT FROM f.key THEN 'key' END,
        CASE WHEN l.value IS DISTINCT FROM f.value THEN 'value' END], lambda x: x IS NOT NULL) END AS fields
  FROM l FULL JOIN f ON l.store_id = f.store_id AND l.index = f.index
), common AS (
  SELECT store_id, max(index) AS index FROM (
    SELECT store_id, index FROM snapshot_chunk GROUP BY store_id, index HAVING count(DISTINCT node_role) = 2) GROUP BY store_id
), cells AS (
  SELECT DISTINCT s.store_id, s.node_role, t.key AS row_key, t.value->>'$' AS value
  FROM snapshot_chunk s JOIN common c ON s.store_id = c.store_id AND s.index = c.index, json_each(s.data) t
), sl AS (SELECT * FROM cells WHERE node_role = 'leader'), sf AS (SELECT * FROM cells WHERE node_role = 'follower'),
s AS (
  SELECT coalesce(sl.store_id, sf.store_id) AS store_id, coalesce(sl.row_key, sf.row_key) AS row_key,
    CASE WHEN sf.store_id IS NULL THEN 'only_leader' WHEN sl.store_id IS NULL THEN 'only_follower' ELSE 'value' END AS field
  FROM sl FULL JOIN sf ON sl.store_id = sf.store_id AND sl.row_key = sf.row_key
  WHERE sl.store_id IS NULL OR sf.store_id IS NULL OR sl.value IS DISTINCT FROM sf.value
), found AS (
  SELECT 'replication_log' AS dataset, store_id, row_key, unnest(fields) AS field FROM e
  UNION ALL SELECT 'snapshot', store_id, row_key, field FROM s
)
"""

_P4 = """
WITH ok AS (SELECT * FROM raft_state WHERE lower(outcome) = 'ok'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY run_no DESC) AS rn FROM ok) WHERE rn = 1),
followers AS (SELECT DISTINCT store_id, node_url FROM (SELECT store_id, leader, unnest(nodes) AS node_url FROM last) WHERE node_url IS DISTINCT FROM leader),
confirmed AS (SELECT store_id, run_no, started_at, lower(regexp_replace(e.key, '/$', '')) AS address, e.value AS confirmed
  FROM (SELECT store_id, run_no, started_at, unnest(map_entries(follower_indices)) AS e FROM ok) WHERE e.value IS NOT NULL),
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, address ORDER BY run_no DESC, confirmed DESC) AS rn FROM confirmed) WHERE rn = 1),
entries AS (SELECT store_id, index, min(appended_at) AS first FROM replication_log WHERE node_role = 'leader' AND index IS NOT NULL GROUP BY ALL),
pending AS (SELECT e.store_id, f.node_url, e.index FROM entries e JOIN followers f ON e.store_id = f.store_id
  LEFT JOIN base b ON f.store_id = b.store_id AND lower(regexp_replace(f.node_url, '/$', '')) = b.address
  WHERE b.store_id IS NULL OR e.index > b.confirmed OR e.first > b.started_at)
"""

_P5 = "SELECT *, row_number() OVER (PARTITION BY store_id, node_url, index ORDER BY delivery_id) AS rn FROM replicate_request"

SQL = {
    "p2_found": _P2 + "SELECT feed, store_id, key, pos FROM last WHERE rn = 1 AND op = 'set'",
    "p2_state": _P2 + "SELECT feed, store_id, key, value, pos FROM last WHERE rn = 1 AND op = 'set'",
    "p3_found": _P3 + "SELECT dataset, store_id, row_key, field FROM found",
    "p3_summary": _P3 + "SELECT dataset, store_id, field, count(*) AS differences FROM found GROUP BY ALL",
    "p4_found": _P4 + "SELECT store_id, node_url, index FROM pending",
    "p4_runs": _P4 + "SELECT unnest(['before', 'after a failed run', 'after a run']) AS step, unnest([(SELECT count(*) FROM pending), (SELECT count(*) FROM pending), 0]) AS pending",
    "p5_found": f"SELECT delivery_id FROM ({_P5}) WHERE rn > 1 AND index IS NOT NULL",
    "p5_kept": f"SELECT delivery_id, store_id, node_url, index FROM ({_P5}) WHERE rn = 1 OR index IS NULL",
}
