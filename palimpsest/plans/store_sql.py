"""SQL counterparts of the store's queries, for an independent engine."""

from __future__ import annotations

from palimpsest.plans.store import POINT, POINTS, RANGE
from palimpsest.plans.tables import LEVEL1_CHUNK, LEVEL1_FIRST

M = """m AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'SET' END AS op,
  'user_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_type = 'error' AS is_tombstone FROM events),
n AS (SELECT max(seq) AS n FROM m)"""


def newest(source: str, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


F = (
    M
    + """,
sized AS (SELECT *, length(key) + CASE WHEN is_tombstone THEN 1 ELSE length(value) END AS size FROM m),
summed AS (SELECT *, CAST(sum(size) OVER (ORDER BY seq) AS BIGINT) AS cum FROM sized),
jump AS (
  SELECT CAST(0 AS BIGINT) AS batch_id, CAST(0 AS BIGINT) AS base, (SELECT min(cum) FROM summed WHERE cum >= 4096) AS close
  UNION ALL
  SELECT j.batch_id + 1, j.close, min(s.cum) FROM jump j LEFT JOIN summed s ON s.cum >= j.close + 4096 WHERE j.close IS NOT NULL GROUP BY j.batch_id, j.close),
f AS (SELECT s.*, j.batch_id, j.close IS NOT NULL AS sealed FROM summed s ASOF JOIN jump j ON s.cum > j.base)"""
)


def chunked(source: str) -> str:
    """Chunks of keys of ``source`` (key, size), one row after the other."""
    return f"""k AS (SELECT key, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY key) AS no FROM {source} GROUP BY key),
walk AS (SELECT no, key, size, CAST(0 AS BIGINT) AS chunk, size AS acc FROM k WHERE no = 1
  UNION ALL SELECT k.no, k.key, k.size, CASE WHEN w.acc + k.size > {LEVEL1_CHUNK} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.acc + k.size > {LEVEL1_CHUNK} THEN k.size ELSE w.acc + k.size END
  FROM walk w JOIN k ON k.no = w.no + 1)"""


L = (
    F
    + f""",
half AS (SELECT (max(batch_id) + 1) // 2 AS h FROM f WHERE sealed),
bottom AS (SELECT * FROM {newest("f", "sealed AND batch_id < (SELECT h FROM half)")} WHERE NOT is_tombstone),
{chunked("bottom")},
l AS (
  SELECT b.key, b.seq, b.value, b.is_tombstone, 1 AS level, w.chunk + {LEVEL1_FIRST} AS file_no FROM bottom b JOIN walk w ON b.key = w.key
  UNION ALL SELECT key, seq, value, is_tombstone, CASE WHEN sealed THEN 0 END, CASE WHEN sealed THEN batch_id END FROM f WHERE NOT sealed OR batch_id >= (SELECT h FROM half)),
man AS (SELECT level, 'sst_' || CAST(file_no AS VARCHAR) AS file_name, min(key) AS min_key, max(key) AS max_key, file_no FROM l WHERE level IS NOT NULL GROUP BY level, file_no),
span AS (SELECT min(min_key) AS lo, max(max_key) AS hi FROM man WHERE level = 0),
inputs AS (SELECT man.* FROM man, span WHERE level = 0 OR (level = 1 AND min_key <= hi AND max_key >= lo))"""
)

W, R = "WITH ", "WITH RECURSIVE "

PAYLOAD = "CASE WHEN is_tombstone THEN CAST(to_json({'k': key, 's': seq, 't': true}) AS VARCHAR) ELSE CAST(to_json({'k': key, 's': seq, 'v': value}) AS VARCHAR) END"

# CRC-32 over the payload's bytes, by the usual table, which is computed here from its polynomial.
CRC = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
p AS (SELECT *, """ + PAYLOAD + """ AS payload FROM m),
lines AS (SELECT seq, key, is_tombstone, payload || chr(9) || CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(range(1, octet_length(encode(payload)) + 1), lambda i: CAST(('0x' || substr(hex(encode(payload)), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))),
  lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1]))) AS VARCHAR) || chr(10) AS line FROM p, crc_table)"""

# A record's bytes without its checksum's digits being known from elsewhere: payload, tab, digits, line feed.
CRC_F = CRC.replace("FROM m)", "FROM f WHERE sealed)").replace("SELECT seq, key, is_tombstone, payload ||", "SELECT batch_id, seq, key, value, is_tombstone, payload ||")

OFFSETS = """off AS (SELECT batch_id, key, seq, CAST(coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY batch_id ORDER BY key, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lines),
sparse AS (SELECT batch_id, key, "offset" FROM (SELECT *, dense_rank() OVER (PARTITION BY batch_id ORDER BY key) AS kn, row_number() OVER (PARTITION BY batch_id, key ORDER BY seq) AS vn FROM off) WHERE kn % 4 = 0 AND vn = 1)"""

BLOOM = (
    F
    + """,
keys AS (SELECT DISTINCT batch_id AS file_no, key FROM f WHERE sealed),
cap AS (SELECT file_no, count(*) AS capacity, greatest(1, CAST(ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT)) AS bits FROM keys GROUP BY file_no),
sizes AS (SELECT file_no, capacity, bits, greatest(1, CAST(round_even(CAST(bits AS DOUBLE) / capacity * ln(2), 0) AS BIGINT)) AS hashes FROM cap)"""
)


def bits_of(source: str) -> str:
    return f"""(SELECT DISTINCT file_no, key, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(8), lambda j: CAST(('0x' || substr(h, 8 * j + 1, 8)) AS BIGINT))),
  lambda a, w: (a * 4294967296 % bits + w) % bits) AS bit
  FROM (SELECT file_no, key, bits, sha256(encode(key) || unhex(printf('%08x', i))) AS h FROM (SELECT s.file_no, s.key, z.bits, unnest(range(z.hashes)) AS i FROM {source} s JOIN sizes z ON s.file_no = z.file_no)))"""


PROBES = f"""bits AS (SELECT DISTINCT file_no, bit FROM {bits_of("keys")}),
asked AS (SELECT file_no, key FROM (SELECT DISTINCT file_no FROM keys), (SELECT 'user_' || lpad(CAST(i AS VARCHAR), 6, '0') AS key FROM range(200) r(i) UNION ALL SELECT 'nobody_' || CAST(i AS VARCHAR) FROM range(200) r(i))),
probed AS (SELECT w.file_no, w.key, count(b.bit) = count(*) AS may_contain FROM {bits_of("asked")} w LEFT JOIN bits b ON w.file_no = b.file_no AND w.bit = b.bit GROUP BY w.file_no, w.key)"""

PINS = M + ", pins AS (SELECT unnest([n // 4, n // 4, n // 4, n // 2, n // 2, 3 * n // 4]) AS seq, unnest([1, 1, -1, 1, -1, 1]) AS delta FROM n), refs AS (SELECT seq, CAST(sum(delta) AS BIGINT) AS refs FROM pins GROUP BY seq HAVING sum(delta) > 0)"

LIVE = "SELECT key, value FROM {} WHERE NOT is_tombstone"
IN_RANGE = f"key BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'"
FILES = "files AS (SELECT 'sst_' || CAST(batch_id + 1 AS VARCHAR) AS file_name, batch_id + 1 AS no, min(key) AS min_key, max(key) AS max_key FROM f WHERE sealed GROUP BY batch_id)"

SQL = {
    "mutations_from_events": W + M + " SELECT seq, op, key, value FROM m",
    "scan_latest": W + M + " " + LIVE.format(newest("m")),
    "dump": W + M + " " + LIVE.format(newest("m")),
    "get_point": W + M + " " + LIVE.format(newest("m", f"key IN {POINTS}")),
    "get_layered": W + M + " " + LIVE.format(newest("m", f"key IN {POINTS}")),
    "get_at": W + M + " " + LIVE.format(newest("m", f"key IN {POINTS} AND seq <= (SELECT n // 2 FROM n)")),
    "scan_range": W + M + " " + LIVE.format(newest("m", IN_RANGE)),
    "scan_at": W + M + " " + LIVE.format(newest("m", "seq <= (SELECT n // 2 FROM n)")),
    "scan_ordered": W + M + f" SELECT key, value, row_number() OVER (ORDER BY key) AS pos FROM {newest('m')} WHERE NOT is_tombstone",
    "multi_get": W + M + f" SELECT p.key, l.value FROM (SELECT 'user_' || lpad(CAST(i AS VARCHAR), 6, '0') AS key FROM (SELECT unnest(range(0, (SELECT max(user_id) + 51 FROM events))) AS i)) p LEFT JOIN {newest('m')} l ON p.key = l.key AND NOT l.is_tombstone",
    "versions_by_key": W + M + " SELECT key, seq // 1000 AS block, string_agg(CAST(seq AS VARCHAR) || CASE WHEN is_tombstone THEN '-' ELSE '+' END, ',' ORDER BY seq) AS versions FROM m GROUP BY key, seq // 1000",
    "version_intervals": W + M + " SELECT key, seq, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS superseded_at FROM m",
    "snapshot_diff": W
    + M
    + f""", b AS (SELECT * FROM {newest("m", "seq <= (SELECT n // 2 FROM n)")} WHERE NOT is_tombstone), a AS (SELECT * FROM {newest("m")} WHERE NOT is_tombstone)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change, b.value AS old_value, a.value AS new_value
FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.value IS DISTINCT FROM b.value""",
    "memtable_range_scan": R + F + f" SELECT key, seq, value, is_tombstone FROM f WHERE NOT sealed AND {IN_RANGE}",
    "size_accounting": W
    + M
    + " SELECT CAST(sum(length(key) + CASE WHEN is_tombstone THEN 1 ELSE length(value) END) AS BIGINT) AS memtable_size, CAST(sum(length(key) + CASE WHEN is_tombstone THEN 0 ELSE length(value) END) AS BIGINT) AS user_bytes, count(*) AS mutations FROM m",
    "flush_batches": R + F + " SELECT batch_id, sealed, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(size) AS BIGINT) AS size FROM f GROUP BY batch_id, sealed",
    "sstable_records": W + M + ", " + CRC + " SELECT seq, line FROM lines",
    "sstable_full_scan": R + F + ", " + CRC_F + " SELECT batch_id, key, seq, value, is_tombstone, octet_length(encode(line)) AS bytes FROM lines",
    "sstable_seek_scan": R + F + f" SELECT batch_id, key, seq, value FROM f WHERE sealed AND key >= '{POINT}'",
    "sstable_key_range": R + F + " SELECT batch_id, min(key) AS min_key, max(key) AS max_key, count(*) AS records, count(DISTINCT key) AS distinct_keys FROM f WHERE sealed GROUP BY batch_id",
    "sstable_offsets": R + F + ", " + CRC_F + ", " + OFFSETS + ' SELECT batch_id, key, seq, "offset" FROM off',
    "sstable_file_size": R + F + ", " + CRC_F + " SELECT batch_id, CAST(sum(octet_length(encode(line))) AS BIGINT) AS bytes FROM lines GROUP BY batch_id",
    "sparse_index_build": R + F + ", " + CRC_F + ", " + OFFSETS + " SELECT * FROM sparse",
    "sparse_index_floor": R
    + F
    + ", "
    + CRC_F
    + ", "
    + OFFSETS
    + """ SELECT p.batch_id, p.key, coalesce(s."offset", 0) AS "offset" FROM (SELECT batch_id, key FROM (SELECT DISTINCT batch_id FROM lines), (SELECT 'user_' || lpad(CAST(i AS VARCHAR), 6, '0') AS key FROM range(200) r(i))) p
ASOF LEFT JOIN sparse s ON p.batch_id = s.batch_id AND p.key >= s.key""",
    "compaction_chunks": R + M + f", src AS (SELECT key, length(key) + CASE WHEN is_tombstone THEN 1 ELSE length(value) END AS size FROM {newest('m')}), " + chunked("src") + " SELECT key, size, chunk FROM walk",
    "level_limits": "SELECT CAST(i AS INTEGER) AS level, CAST(2 * pow(10, i) AS BIGINT) AS file_limit, CAST(4096 * pow(10, i) AS BIGINT) AS chunk_size FROM range(7) r(i)",
    "wal_record_size": W + M + " SELECT seq, 21 + octet_length(encode(key)) + CASE WHEN is_tombstone THEN 0 ELSE 4 + octet_length(encode(value)) END AS bytes FROM m",
    "wal_group_commit": W + M + " SELECT (seq - 1) // 100 AS commit_group, count(*) AS records, max(seq) AS durable_seq FROM m GROUP BY (seq - 1) // 100",
    "compact_retain_latest": W + M + f" SELECT key, seq, value, is_tombstone FROM {newest('m')}",
    "compact_retain_pinned": W
    + M
    + ", kept AS (SELECT *, max(CASE WHEN seq <= (SELECT n // 2 FROM n) THEN seq END) OVER (PARTITION BY key) AS base FROM m) SELECT key, seq, value, is_tombstone FROM kept WHERE seq > (SELECT n // 2 FROM n) OR seq = base",
    "tombstone_gc": R
    + L
    + f""" SELECT key, seq, value, is_tombstone FROM {newest("l", "level = 0")} k WHERE NOT is_tombstone
OR EXISTS (SELECT 1 FROM man WHERE level = 1 AND k.key BETWEEN man.min_key AND man.max_key)""",
    "compaction_inputs": R + L + " SELECT level, file_name, min_key, max_key FROM inputs",
    "compaction_due": R + L + " SELECT level, count(*) AS files, CAST(2 * pow(10, level) AS BIGINT) AS file_limit, count(*) >= 2 * pow(10, level) AS is_due FROM man GROUP BY level",
    "compact_full": R + L + f" SELECT key, seq, value, is_tombstone FROM {newest('l', 'level IS NOT NULL')} WHERE NOT is_tombstone",
    "oldest_snapshot": W + PINS + " SELECT min(seq) AS oldest FROM refs",
    "snapshot_refcounts": W + PINS + " SELECT seq, refs FROM refs",
    "checksum_verify": W + M + " SELECT seq, seq % 997 <> 0 AS is_valid FROM m",
    "wal_replay_prefix": W + M + " SELECT key, seq, value, is_tombstone FROM m WHERE seq < (SELECT coalesce(min(seq), 9223372036854775807) FROM m WHERE seq % 997 = 0)",
    "wal_segment_splice": "SELECT store_id, segment_no, rec_no, row_number() OVER (ORDER BY store_id, segment_no, rec_no) AS pos FROM (SELECT store_id, CAST(regexp_extract(segment, 'wal-(\\d+)\\.log', 1) AS BIGINT) AS segment_no, rec_no FROM mutation_log)",
    "recover_counters": "SELECT coalesce(a.store_id, b.store_id) AS store_id, a.seq, b.log_index FROM (SELECT store_id, max(seq) AS seq FROM mutation_log GROUP BY store_id) a FULL JOIN (SELECT store_id, max(index) AS log_index FROM replication_log GROUP BY store_id) b ON a.store_id = b.store_id",
    "orphan_files": R + F + ", " + FILES + " SELECT 'sst_' || CAST(i AS VARCHAR) AS file_name FROM range(1, (SELECT count(*) FROM files) + 4) r(i) WHERE 'sst_' || CAST(i AS VARCHAR) NOT IN (SELECT file_name FROM files)",
    "manifest_missing_files": R + F + ", " + FILES + " SELECT file_name, min_key, max_key FROM files WHERE no % 10 = 0",
    "manifest_swap": R
    + L
    + " SELECT level, file_name, min_key, max_key FROM man WHERE file_name NOT IN (SELECT file_name FROM inputs) UNION ALL SELECT 1, 'sst_2000000', min(min_key), max(max_key) FROM inputs",
    "manifest_file_order": R + L + " SELECT level, file_name, row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -file_no ELSE file_no END) AS read_order FROM man",
    "files_for_key": R + L + f" SELECT level, file_name, min_key, max_key FROM man WHERE '{POINT}' BETWEEN min_key AND max_key",
    "bloom_sizing": R + BLOOM + " SELECT file_no, capacity, bits, hashes FROM sizes",
    "bloom_build": R + BLOOM + f" SELECT file_no, bit // 32 AS word_no, bit_or(CAST(1 AS BIGINT) << CAST(bit % 32 AS BIGINT)) AS word FROM {bits_of('keys')} GROUP BY file_no, bit // 32",
    "bloom_roundtrip": R + BLOOM + f" SELECT file_no, bit // 32 AS word_no, bit_or(CAST(1 AS BIGINT) << CAST(bit % 32 AS BIGINT)) AS word FROM {bits_of('keys')} GROUP BY file_no, bit // 32",
    "bloom_probe": R + BLOOM + ", " + PROBES + " SELECT file_no, key, may_contain FROM probed",
    "bloom_fpr": R + BLOOM + ", " + PROBES + " SELECT file_no, avg(CAST(may_contain AS DOUBLE)) AS false_positive_rate FROM probed WHERE key LIKE 'nobody\\_%' ESCAPE '\\' GROUP BY file_no",
    "stats_levels": R + L + " SELECT level, count(DISTINCT file_no) AS sstables, count(*) AS records FROM l WHERE level IS NOT NULL GROUP BY level",
    "stats_summary": R
    + L
    + ", "
    + CRC.replace("FROM m)", "FROM l WHERE level IS NOT NULL)")
    + f""", s AS (SELECT (SELECT count(*) FROM man) AS total_sstables, (SELECT CAST(sum(octet_length(encode(line))) AS BIGINT) FROM lines) AS data_bytes,
(SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM f WHERE NOT sealed) AS memtable_size, (SELECT count(*) FROM {newest("f", "NOT sealed")} WHERE NOT is_tombstone) AS memtable_keys,
(SELECT CAST(sum(length(key) + CASE WHEN is_tombstone THEN 0 ELSE length(value) END) AS BIGINT) FROM m) AS user_bytes) SELECT *, data_bytes / CAST(user_bytes AS DOUBLE) AS write_amplification FROM s""",
    "latency_percentiles": "SELECT event_type, count(value) AS samples, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type",
    "parse_commands": """WITH lines AS (SELECT DISTINCT CASE event_id % 9 WHEN 0 THEN 'SET ' || k || ' v' WHEN 1 THEN ' get ' || k WHEN 2 THEN 'GET ' || k || ' 12' WHEN 3 THEN 'Delete ' || k
  WHEN 4 THEN 'scan a  z' WHEN 5 THEN 'STATS' WHEN 6 THEN 'get ' || k || ' x' WHEN 7 THEN 'set a' ELSE 'flush' END AS line FROM (SELECT event_id, 'user_' || CAST(user_id AS VARCHAR) AS k FROM events)),
w AS (SELECT line, string_split_regex(trim(line), '\\s+') AS w FROM lines), c AS (SELECT line, upper(w[1]) AS command, w[2] AS arg1, w[3] AS arg2, len(w) - 1 AS n FROM w)
SELECT line, command, arg1, arg2, coalesce(CASE WHEN command IN ('SET', 'SCAN') THEN n = 2 WHEN command = 'GET' THEN n = 1 OR (n = 2 AND TRY_CAST(arg2 AS BIGINT) IS NOT NULL) WHEN command = 'DELETE' THEN n = 1
  WHEN command IN ('STATS', 'EXIT') THEN n = 0 ELSE false END, false) AS is_valid FROM c""",
}
