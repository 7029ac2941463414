"""Queries of the store: reads, layout, compaction, integrity, filters, figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import EngineConfig
from palimpsest.functions import records
from palimpsest.operators import bloom, compaction, integrity, layout, mvcc, stats
from palimpsest.operators.blocks import with_position
from palimpsest.plans import tables as t
from palimpsest.plans.tables import table
from palimpsest.session import written
from palimpsest.sources.formats import decode_segments, spliced, wal_frame

CONFIG = EngineConfig()
#: A key that exists, one that is deleted and one that is missing, at one size of the tables or another.
POINTS, RANGE = ("user_000012", "user_000003", "user_000006", "user_000010", "nobody"), ("user_000010", "user_000019")
POINT = POINTS[0]


def _half(spark: SparkSession, sf: str) -> int:
    return t.last_seq(spark, sf) // 2


# --- reads


def mutations_from_events(spark, sf):
    return t.mutations(spark, sf)


def scan_latest(spark, sf):
    return mvcc.live(t.cells(spark, sf))


def _points(cells: DataFrame, at: int | None = None) -> DataFrame:
    """A point read of each of the keys."""
    return reduce(DataFrame.unionByName, [mvcc.get(cells, key, at) for key in POINTS])


def get_point(spark, sf):
    return _points(t.cells(spark, sf))


def get_at(spark, sf):
    return _points(t.cells(spark, sf), _half(spark, sf))


def scan_range(spark, sf):
    return mvcc.scan(t.cells(spark, sf), *RANGE)


def scan_at(spark, sf):
    return mvcc.scan(t.cells(spark, sf), at=_half(spark, sf))


def scan_ordered(spark, sf):
    return with_position(mvcc.live(t.cells(spark, sf)), ["key"])


def get_layered(spark, sf):
    """A point read over memtable and levels; the layout doesn't matter to it."""
    return _points(written(t.levels(spark, sf), "levels"))


def multi_get(spark, sf):
    return mvcc.multi_get(t.cells(spark, sf), t.probes(spark, sf))


def versions_by_key(spark, sf):
    versions = F.array_join(F.transform("versions", lambda v: F.concat(v["seq"].cast("string"), F.when(v["is_tombstone"], "-").otherwise("+"))), ",")
    return mvcc.version_blocks(t.cells(spark, sf)).select("key", "block", versions.alias("versions"))


def version_intervals(spark, sf):
    return mvcc.version_intervals(t.cells(spark, sf)).select("key", "seq", "superseded_at")


def snapshot_diff(spark, sf):
    n = t.last_seq(spark, sf)
    return mvcc.snapshot_diff(t.cells(spark, sf), n // 2, n)


def memtable_range_scan(spark, sf):
    return mvcc.in_range(t.batches(spark, sf).where("NOT sealed"), *RANGE).select("key", "seq", "value", "is_tombstone")


# --- layout


def size_accounting(spark, sf):
    sizes = t.cells(spark, sf).select(records.cell_size().alias("c"), records.user_size().alias("u"))
    return sizes.agg(F.sum("c").alias("memtable_size"), F.sum("u").alias("user_bytes"), F.count("*").alias("mutations"))


def flush_batches(spark, sf):
    sizes = t.batches(spark, sf).withColumn("size", records.cell_size())
    return sizes.groupBy("batch_id", "sealed").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("size").alias("size"))


def sstable_records(spark, sf):
    return layout.sstable_records(t.cells(spark, sf)).select("seq", "line")


def sstable_full_scan(spark, sf):
    return layout.sstable_records(t.batches(spark, sf).where("sealed")).select("batch_id", "key", "seq", "value", "is_tombstone", "bytes")


def sstable_seek_scan(spark, sf):
    return mvcc.in_range(t.batches(spark, sf).where("sealed"), start=POINT).select("batch_id", "key", "seq", "value")


def sstable_key_range(spark, sf):
    return layout.key_ranges(t.batches(spark, sf).where("sealed"), "batch_id")


def sstable_offsets(spark, sf):
    return layout.record_offsets(t.batches(spark, sf).where("sealed"), "batch_id").select("batch_id", "key", "seq", "offset")


def sstable_file_size(spark, sf):
    return layout.sstable_records(t.batches(spark, sf).where("sealed")).groupBy("batch_id").agg(F.sum("bytes").alias("bytes"))


def sparse_index_build(spark, sf):
    return layout.sparse_index(t.batches(spark, sf).where("sealed"), CONFIG.sparse_index_n, "batch_id")


def sparse_index_floor(spark, sf):
    files = written(t.batches(spark, sf).where("sealed"), "files")
    each = files.select("batch_id").distinct().withColumn("key", F.explode(F.lit([f"user_{i:06d}" for i in range(200)])))
    return layout.floor_lookup(layout.sparse_index(files, CONFIG.sparse_index_n, "batch_id"), each, "batch_id")


def compaction_chunks(spark, sf):
    return layout.compaction_chunks(mvcc.resolve(t.cells(spark, sf)), t.LEVEL1_CHUNK)


def level_limits(spark, sf):
    rows = [(level, CONFIG.level_file_limit(level), CONFIG.level_chunk_size(level)) for level in range(7)]
    return spark.createDataFrame(rows, "level int, file_limit bigint, chunk_size bigint")


def wal_record_size(spark, sf):
    return t.cells(spark, sf).select("seq", records.wal_record_size().alias("bytes"))


def wal_group_commit(spark, sf):
    grouped = layout.group_commits(t.cells(spark, sf), "seq", CONFIG.wal_buffer_size)
    return grouped.groupBy("commit_group").agg(F.count("*").alias("records"), F.max("seq").alias("durable_seq"))


# --- compaction


def compact_retain_latest(spark, sf):
    return compaction.retain(t.cells(spark, sf), None)


def compact_retain_pinned(spark, sf):
    return compaction.retain(t.cells(spark, sf), _half(spark, sf))


def tombstone_gc(spark, sf):
    """Level 0 compacted, while level 1 counts as deeper than the output."""
    cells = written(t.levels(spark, sf), "levels")
    deeper = layout.key_ranges(cells.where("level = 1"), "file_no").select("min_key", "max_key")
    return compaction.compact(cells.where("level = 0"), None, deeper)


def compaction_inputs(spark, sf):
    return compaction.inputs(written(t.manifest(spark, sf), "manifest"), 0)


def compaction_due(spark, sf):
    return compaction.due(t.manifest(spark, sf), CONFIG.max_l0_files, CONFIG.level_factor)


def compact_full(spark, sf):
    """All levels into one, no pin: what is live in the files."""
    return compaction.compact(t.levels(spark, sf).where("level IS NOT NULL"))


def _pins(spark, sf):
    n = t.last_seq(spark, sf)
    rows = [(n // 4, 1), (n // 4, 1), (n // 4, -1), (n // 2, 1), (n // 2, -1), (3 * n // 4, 1)]
    return spark.createDataFrame(rows, "seq bigint, delta int")


def oldest_snapshot(spark, sf):
    return compaction.oldest_pin(_pins(spark, sf))


def snapshot_refcounts(spark, sf):
    return compaction.pin_counts(_pins(spark, sf))


# --- integrity and recovery


def checksum_verify(spark, sf):
    """Every 997th record has a letter of its payload changed."""
    lines = layout.sstable_records(t.cells(spark, sf))
    changed = lines.withColumn("line", F.when(F.col("seq") % 997 == 0, F.replace("line", F.lit('"k"'), F.lit('"K"'))).otherwise(F.col("line")))
    return integrity.verify_records(changed).select("seq", "is_valid")


#: Records of one log segment.
SEGMENT = 1000


def wal_replay_prefix(spark, sf):
    """The log in binary segments, with a letter of every 997th record's key changed, read and replayed as one log."""
    key = [F.col(c) for c in ("seq", "key", "value", "is_tombstone")]
    frame = wal_frame(*key)
    changed = F.when(F.col("seq") % 997 == 0, F.overlay(frame, F.unhex(F.lit("55")), 18, 1)).otherwise(frame)
    each = t.cells(spark, sf).select(F.floor((F.col("seq") - 1) / SEGMENT).alias("n"), F.struct("seq", F.hex(changed).alias("f")).alias("r"))
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["f"]), ""))
    segments = each.groupBy("n").agg(whole.alias("content")).select(F.concat(F.lit("wal-"), F.col("n").cast("string"), F.lit(".log")).alias("name"), "content")
    records = written(decode_segments(segments), "records")
    return mvcc.cells_from_mutations(spliced(records)).select("key", "seq", "value", "is_tombstone")


def wal_segment_splice(spark, sf):
    """All segments of the mutation log, store by store in the order of segment numbers, as one log."""
    log = table(spark, sf, "mutation_log").withColumn("segment_no", integrity.segment_number(F.col("segment")))
    return with_position(log.select("store_id", "segment_no", "rec_no"), ["store_id", "segment_no", "rec_no"])


def recover_counters(spark, sf):
    log = table(spark, sf, "mutation_log").groupBy("store_id").agg(F.max("seq").alias("seq"))
    index = table(spark, sf, "replication_log").groupBy("store_id").agg(F.max("index").alias("log_index"))
    return log.join(index, "store_id", "full").select("store_id", "seq", "log_index")


def _sealed_files(spark, sf):
    sealed = t.batches(spark, sf).where("sealed")
    return written(layout.key_ranges(sealed, "batch_id").select(F.lit(0).alias("level"), F.concat(F.lit("sst_"), (F.col("batch_id") + 1).cast("string")).alias("file_name"), "min_key", "max_key"), "manifest")


def orphan_files(spark, sf):
    listed = _sealed_files(spark, sf)
    n = listed.count()
    disk = spark.range(1, n + 4).select(F.concat(F.lit("sst_"), F.col("id").cast("string")).alias("file_name"))
    return integrity.orphans(disk, listed)


def manifest_missing_files(spark, sf):
    listed = _sealed_files(spark, sf)
    disk = listed.where(integrity.file_number(F.col("file_name")) % 10 != 0)
    return integrity.missing(disk, listed).select("file_name", "min_key", "max_key")


def manifest_swap(spark, sf):
    """Level 0 compacted: its inputs leave the manifest and one file of level 1 takes their place."""
    now = written(t.manifest(spark, sf), "manifest")
    read = compaction.inputs(now, 0)
    made = read.agg(F.lit(1).alias("level"), F.lit("sst_2000000").alias("file_name"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))
    return compaction.without_files(now, read).unionByName(made)


def manifest_file_order(spark, sf):
    number = integrity.file_number(F.col("file_name"))
    ordered = t.manifest(spark, sf).withColumn("_n", F.when(F.col("level") == 0, -number).otherwise(number))
    return with_position(ordered, ["level", "_n"], "read_order").select("level", "file_name", "read_order")


def files_for_key(spark, sf):
    return integrity.files_for_key(t.manifest(spark, sf), POINT)


# --- bloom filters


def _bloom_files(spark, sf):
    return written(t.batches(spark, sf).where("sealed").select(F.col("batch_id").alias("file_no"), "key").distinct(), "keys")


def bloom_sizing(spark, sf):
    return bloom.sizing(_bloom_files(spark, sf), CONFIG.bloom_false_positive_rate)


def _bloom(spark, sf):
    files = _bloom_files(spark, sf)
    sizes = written(bloom.sizing(files, CONFIG.bloom_false_positive_rate), "sizes")
    return files, sizes, written(bloom.build(files, sizes), "words")


def bloom_build(spark, sf):
    return _bloom(spark, sf)[2]


def _bloom_probes(files):
    return files.select("file_no").distinct().withColumn("key", F.explode(F.lit([f"user_{i:06d}" for i in range(200)] + [f"nobody_{i}" for i in range(200)])))


def bloom_probe(spark, sf):
    files, sizes, words = _bloom(spark, sf)
    return bloom.probe(words, sizes, _bloom_probes(files))


def bloom_roundtrip(spark, sf):
    """The words after a filter was serialised and read again."""
    _, sizes, words = _bloom(spark, sf)
    return bloom.deserialize(bloom.serialize(words, sizes))


def bloom_fpr(spark, sf):
    """Share of keys that no file holds which the filters let through."""
    files, sizes, words = _bloom(spark, sf)
    asked = bloom.probe(words, sizes, _bloom_probes(files)).where(F.col("key").startswith("nobody_"))
    return asked.groupBy("file_no").agg(F.avg(F.col("may_contain").cast("double")).alias("false_positive_rate"))


# --- figures


def stats_levels(spark, sf):
    return stats.per_level(t.levels(spark, sf).where("level IS NOT NULL"))


def stats_summary(spark, sf):
    cells = written(t.levels(spark, sf), "levels")
    return stats.summary(cells.where("level IS NOT NULL"), cells.where("level IS NULL"), t.cells(spark, sf))


def latency_percentiles(spark, sf):
    return stats.latency_percentiles(table(spark, sf, "events"), "value", "event_type")


def parse_commands(spark, sf):
    e, k = F.col("event_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    forms = [F.concat(F.lit("SET "), k, F.lit(" v")), F.concat(F.lit(" get "), k), F.concat(F.lit("GET "), k, F.lit(" 12")), F.concat(F.lit("Delete "), k), F.lit("scan a  z"), F.lit("STATS"), F.concat(F.lit("get "), k, F.lit(" x")), F.lit("set a"), F.lit("flush")]
    line = forms[-1]
    for i in range(len(forms) - 2, -1, -1):
        line = F.when(e % len(forms) == i, forms[i]).otherwise(line)
    return stats.parse_commands(table(spark, sf, "events").select("event_id", line.alias("line")).drop("event_id").distinct())


NAMES = """
mutations_from_events scan_latest get_point get_at scan_range scan_at scan_ordered get_layered multi_get versions_by_key version_intervals snapshot_diff
memtable_range_scan size_accounting flush_batches sstable_records sstable_full_scan sstable_seek_scan sstable_key_range sstable_offsets sstable_file_size
sparse_index_build sparse_index_floor compaction_chunks level_limits wal_record_size wal_group_commit compact_retain_latest compact_retain_pinned tombstone_gc
compaction_inputs compaction_due compact_full oldest_snapshot snapshot_refcounts checksum_verify wal_replay_prefix wal_segment_splice recover_counters
orphan_files manifest_missing_files manifest_swap manifest_file_order files_for_key bloom_sizing bloom_build bloom_probe bloom_roundtrip bloom_fpr
stats_levels stats_summary latency_percentiles parse_commands
""".split()

QUERIES = {name: globals()[name] for name in NAMES} | {"dump": scan_latest}
