"""Queries of replication and election, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import election, replication
from palimpsest.plans import tables as t
from palimpsest.plans.store_sql import M, newest
from palimpsest.plans.tables import table

NODES = 5
GAP_US = 3_600_000_000


def replog_quorum(spark, sf):
    return replication.acknowledged(t.acknowledgements(spark, sf), NODES)


def replog_apply(spark, sf):
    """Keys and values after the entries that a majority acknowledged."""
    return replication.applied(replication.committed(t.replicated(spark, sf), t.acknowledgements(spark, sf), NODES))


def replog_dedup(spark, sf):
    log = t.replicated(spark, sf)
    return replication.received_once(log.unionByName(log.where("index % 10 = 0")))


def replog_catchup(spark, sf):
    return replication.suffix(t.replicated(spark, sf), t.last_seq(spark, sf) // 2)


def replog_compaction(spark, sf):
    """Snapshot and remaining log after compaction at the middle: what a late node is sent."""
    snapshot, log = replication.compacted(t.replicated(spark, sf), t.last_seq(spark, sf) // 2)
    none = F.lit(None)
    return snapshot.select(F.lit("snapshot").alias("part"), none.cast("bigint").alias("index"), none.cast("string").alias("operation"), "key", "value").unionByName(log.withColumn("part", F.lit("log")))


def replog_snapshot_restore(spark, sf):
    middle = t.last_seq(spark, sf) // 2
    snapshot, log = replication.compacted(t.replicated(spark, sf), middle)
    return replication.restored(snapshot, middle, log)


def follower_read(spark, sf):
    return replication.follower_reads(t.replicated(spark, sf), t.probes(spark, sf), t.last_seq(spark, sf) // 2)


def membership(spark, sf):
    return replication.members(table(spark, sf, "replication_log").where("node_role = 'leader'"), "store_id")


def vote_grants(spark, sf):
    return election.votes(t.vote_requests(spark, sf))


def election_winner(spark, sf):
    return election.winners(election.votes(t.vote_requests(spark, sf)), NODES)


def prevote_grants(spark, sf):
    asked = table(spark, sf, "events").select("event_id", F.col("value").alias("elapsed"), (F.col("event_id") % 101 + 50).alias("timeout"), (F.col("user_id") % 5 == 0).alias("is_leader"))
    return election.prevotes(asked, "elapsed", "timeout", "is_leader").select("event_id", "granted")


def heartbeat_gaps(spark, sf):
    beats = table(spark, sf, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))
    return election.gaps(beats, "user_id", "us", GAP_US)


def election_rounds(spark, sf):
    """Attempts of 40 events each, the even ones answering the pre-vote."""
    e = table(spark, sf, "events")
    attempt = F.floor(F.col("event_id") / 40).cast("bigint")
    answers = e.select(
        attempt.alias("attempt"),
        F.concat(F.lit("n"), (attempt % NODES).cast("string")).alias("candidate"),
        (attempt + 1).alias("term"),
        F.when(F.col("event_id") % 2 == 0, "prevote").otherwise("vote").alias("phase"),
        F.concat(F.lit("n"), (F.col("user_id") % NODES).cast("string")).alias("voter"),
        (F.col("event_type") == "error").alias("granted"),
    )
    return election.rounds(answers, NODES)


def heartbeat_batches(spark, sf):
    """How much each of four followers, that have a fifth, two fifths ... of the log, is sent."""
    n = t.last_seq(spark, sf)
    have = spark.range(1, NODES).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"), F.floor(F.lit(n) * F.col("id") / NODES).cast("bigint").alias("index"))
    return replication.to_send(t.replicated(spark, sf), have).groupBy("node").agg(F.count("*").alias("entries"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))


#: Entries beyond which the logs of the test tables are compacted.
LOG_THRESHOLD = 1000


def replog_compaction_due(spark, sf):
    return replication.compaction_due(table(spark, sf, "replication_log").where("node_role = 'leader'"), LOG_THRESHOLD, "store_id")


def cluster_status(spark, sf):
    return replication.status(table(spark, sf, "raft_state"))


NAMES = """
replog_quorum replog_apply replog_dedup replog_catchup replog_compaction replog_compaction_due replog_snapshot_restore follower_read membership
vote_grants election_winner election_rounds prevote_grants heartbeat_gaps heartbeat_batches cluster_status
""".split()

QUERIES = {name: globals()[name] for name in NAMES}

_R = "WITH " + M + ", r AS (SELECT seq AS index, lower(op) AS operation, key, value, is_tombstone, seq FROM m), half AS (SELECT n // 2 AS h FROM n)"
_A = _R + ", acks AS (SELECT index, 'n' || CAST(j AS VARCHAR) AS node FROM r, range(5) t(j) WHERE j = 0 OR (index + 1) * j % 7 < 4), q AS (SELECT index, count(DISTINCT node) AS acks, count(DISTINCT node) >= 3 AS committed FROM acks GROUP BY index)"
_V = """WITH v AS (SELECT event_id AS seq, 'n' || CAST(user_id % 5 AS VARCHAR) AS voter, 'n' || CAST(event_id % 5 AS VARCHAR) AS candidate, event_id // 40 + event_id % 3 - 1 AS term FROM events),
x AS (SELECT *, max(term) OVER (PARTITION BY voter ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, first_value(candidate) OVER (PARTITION BY voter, term ORDER BY seq) AS first FROM v),
g AS (SELECT seq, voter, candidate, term, top IS NULL OR term > top OR (term = top AND candidate = first) AS granted FROM x)"""

SQL = {
    "replog_quorum": _A + " SELECT index, acks, committed FROM q",
    "replog_apply": _A + f", c AS (SELECT r.* FROM r JOIN q ON r.index = q.index WHERE committed) SELECT key, value FROM {newest('c')} WHERE NOT is_tombstone",
    "replog_dedup": _R + " SELECT index, operation, key, value FROM r",
    "replog_catchup": _R + " SELECT index, operation, key, value FROM r, half WHERE index > h",
    "replog_compaction": _R
    + f" SELECT 'snapshot' AS part, NULL AS index, NULL AS operation, key, value FROM {newest('r', 'seq <= (SELECT h FROM half)')} WHERE NOT is_tombstone UNION ALL SELECT 'log', index, operation, key, value FROM r, half WHERE index > h",
    "replog_snapshot_restore": _R + f" SELECT key, value FROM {newest('r')} WHERE NOT is_tombstone",
    "follower_read": _R
    + f""", l AS (SELECT * FROM {newest("r")} WHERE NOT is_tombstone), f AS (SELECT * FROM {newest("r", "seq <= (SELECT h FROM half)")} WHERE NOT is_tombstone)
SELECT p.key, l.value AS leader_value, f.value AS follower_value, l.value IS DISTINCT FROM f.value AS stale FROM (SELECT 'user_' || lpad(CAST(i AS VARCHAR), 6, '0') AS key FROM (SELECT unnest(range(0, (SELECT max(user_id) + 51 FROM events))) AS i)) p LEFT JOIN l ON p.key = l.key LEFT JOIN f ON p.key = f.key""",
    "membership": """SELECT store_id, key AS node, index AS since FROM (SELECT *, row_number() OVER (PARTITION BY store_id, key ORDER BY index DESC) AS rn FROM
  (SELECT store_id, index, key, lower(regexp_replace(operation, '^\\s+|\\s+$', '', 'g')) AS op FROM replication_log WHERE node_role = 'leader') WHERE op IN ('add_node', 'remove_node') AND key IS NOT NULL AND index IS NOT NULL) WHERE rn = 1 AND op = 'add_node'""",
    "vote_grants": _V + " SELECT * FROM g",
    "election_winner": _V + " SELECT term, candidate, count(DISTINCT voter) AS votes FROM g WHERE granted GROUP BY term, candidate HAVING count(DISTINCT voter) >= 3",
    "election_rounds": """WITH a AS (SELECT event_id // 40 AS attempt, 'n' || CAST(event_id // 40 % 5 AS VARCHAR) AS candidate, event_id // 40 + 1 AS term, event_id % 2 = 0 AS pre, 'n' || CAST(user_id % 5 AS VARCHAR) AS voter, event_type = 'error' AS granted FROM events),
c AS (SELECT attempt, candidate, term, 1 + count(DISTINCT CASE WHEN pre AND granted THEN voter END) AS p, 1 + count(DISTINCT CASE WHEN NOT pre AND granted THEN voter END) AS v FROM a WHERE voter <> candidate GROUP BY ALL)
SELECT attempt, candidate, term, p AS prevotes, CASE WHEN p >= 3 THEN v END AS votes, CASE WHEN p < 3 THEN 'no_prevote' WHEN v >= 3 THEN 'leader' ELSE 'lost' END AS outcome FROM c""",
    "heartbeat_batches": _R + " SELECT 'n' || CAST(j AS VARCHAR) AS node, count(*) AS entries, min(index) AS first_index, max(index) AS last_index FROM r, n, range(1, 5) t(j) WHERE index > n * j // 5 GROUP BY j",
    "replog_compaction_due": f"SELECT store_id, count(DISTINCT index) AS entries, count(DISTINCT index) > {LOG_THRESHOLD} AS is_due, CASE WHEN count(DISTINCT index) > {LOG_THRESHOLD} THEN max(index) END AS snapshot_index FROM replication_log WHERE node_role = 'leader' GROUP BY store_id",
    "cluster_status": """SELECT store_id, node_url, term, voted_for, leader, log_index FROM (SELECT *, row_number() OVER (PARTITION BY store_id, node_url ORDER BY run_no DESC NULLS LAST, saved_at DESC NULLS LAST, term DESC NULLS LAST, voted_for DESC NULLS LAST, leader DESC NULLS LAST, log_index DESC NULLS LAST) AS rn
  FROM raft_state WHERE run_no IS NOT NULL) WHERE rn = 1""",
    "prevote_grants": "SELECT event_id, coalesce(user_id % 5 <> 0 AND value > (event_id % 101 + 50) * 0.5, false) AS granted FROM events",
    "heartbeat_gaps": f"""SELECT node, gap_start_us, next - gap_start_us AS gap_us FROM (SELECT node, gap_start_us, lead(gap_start_us) OVER (PARTITION BY node ORDER BY gap_start_us) AS next
  FROM (SELECT DISTINCT user_id AS node, epoch_us(ts) AS gap_start_us FROM events)) WHERE next - gap_start_us > {GAP_US}""",
}
