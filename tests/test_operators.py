import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bloom, compaction, election, integrity, joins, mvcc, replication, stats

CELLS = "key string, seq bigint, value string, is_tombstone boolean"


def test_votes_equal_the_fold(spark):
    rng = random.Random(1)
    asked = [(rng.choice(["v", "v", "w", None]), rng.choice(["a", "b", "c"]), rng.choice([None, *range(1, 8)]), n) for n in range(300)]
    state, expected = {}, {}
    for voter, candidate, term, n in asked:
        top, voted = state.get(voter, (0, None))
        granted = term is not None and (term > top or (term == top and voted == candidate))
        if granted:
            state[voter] = (term, candidate)
        expected[n] = granted
    df = spark.createDataFrame(asked, "voter string, candidate string, term bigint, seq bigint").repartition(3)
    assert {r["seq"]: r["granted"] for r in election.votes(df).collect()} == expected


def test_one_vote_a_term_reopens_on_a_higher_one(spark):
    df = spark.createDataFrame([("v", "A", 1, 1), ("v", "B", 1, 2), ("v", "B", 2, 3)], "voter string, candidate string, term bigint, seq bigint")
    assert [r["granted"] for r in election.votes(df).orderBy("seq").collect()] == [True, False, True]


def test_points_in_ranges(spark, rows):
    rng = random.Random(3)
    ranges = [tuple(sorted(f"{n:03d}" for n in rng.sample(range(1000), 2))) for _ in range(4)]
    points = [(f"{n:03d}", n, None, True) for n in rng.sample(range(1000), 150)]
    expected = [p for p in points if any(a <= p[0] <= b for a, b in ranges)]
    got = compaction.covering(spark.createDataFrame(points, CELLS), spark.createDataFrame(ranges, "key string, _reach string"))
    assert rows(got) == sorted(expected, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_beyond_the_bound(spark, rows, how):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [(None, i) for i in range(20)] + [("x", 1), ("y", 3)], "k string, n int")
    right = spark.createDataFrame([("hot", "h"), ("x", "1"), ("x", "2"), (None, "n")], "k string, v string")
    small, large = (joins.lookup_join(left, right, ["k"], how, max_rows=m) for m in (100, 1))
    assert rows(small) == rows(large) == rows(left.join(right, ["k"], how))


def test_retention_with_and_without_a_pin(spark, rows):
    data = [("history", i, f"v{i}", False) for i in range(1, 6)] + [("deleted", 6, "before", False), ("deleted", 7, None, True)]
    df = spark.createDataFrame(data, CELLS)
    assert rows(compaction.retain(df, None).select("key", "seq")) == [("deleted", 7), ("history", 5)]
    assert rows(compaction.retain(df, 2).select("key", "seq")) == [("deleted", 6), ("deleted", 7), ("history", 2), ("history", 3), ("history", 4), ("history", 5)]
    for at in (6, 7):
        assert rows(mvcc.live(compaction.retain(df, 6), at)) == rows(mvcc.live(df, at))


def test_reads_at_a_sequence_number(spark, rows):
    df = spark.createDataFrame([("a", 1, "1", False), ("a", 3, None, True), ("b", 2, "", False), ("a", 5, "5", False), ("a", 5, "5", False)], CELLS)
    assert rows(mvcc.live(df, 0)) == [] and rows(mvcc.live(df, 2)) == [("a", "1"), ("b", "")]
    assert rows(mvcc.live(df, 4)) == [("b", "")] and rows(mvcc.live(df)) == [("a", "5"), ("b", "")]
    assert rows(mvcc.snapshot_diff(df, 2, 4)) == [("a", "removed", "1", None)]


def test_bloom_has_no_false_negatives_and_rejects_malformed_filters(spark, rows):
    keys = spark.createDataFrame([(f, k) for f in (1, 2) for k in ["foo", "bar", "ключ", "", f"only{f}"]], "file_no bigint, key string")
    sizes = bloom.sizing(keys, 0.01)
    bits = bloom.build(keys, sizes)
    assert all(r["may_contain"] for r in bloom.probe(bits, sizes, keys).collect())
    expected = {}
    for f, k in map(tuple, keys.collect()):
        z = sizes.where(F.col("file_no") == f).first()
        for i in range(z["hashes"]):
            bit = int.from_bytes(hashlib.sha256(k.encode() + i.to_bytes(4, "big")).digest(), "big") % z["bits"]
            expected[f, bit // 32] = expected.get((f, bit // 32), 0) | 1 << bit % 32
    assert {(r["file_no"], r["word_no"]): r["word"] for r in bits.collect()} == expected
    saved = bloom.serialize(bits, sizes)
    assert rows(bloom.deserialize(saved)) == rows(bits)
    for bad in ("101", "x\n101", "3\n", "3\n102", "0\n1", None):
        with pytest.raises(Exception, match="malformed"):
            bloom.deserialize(spark.createDataFrame([(1, bad)], "file_no bigint, data string")).collect()


def test_replay_of_a_prefix_and_of_nothing(spark, rows):
    df = spark.createDataFrame([(1, True), (2, True), (3, None), (4, True)], "pos int, ok boolean")
    assert [r["pos"] for r in integrity.valid_prefix(df, "pos", df["ok"]).collect()] == [1, 2]
    assert integrity.valid_prefix(df.where("pos < 3"), "pos", df["ok"]).count() == 2
    assert integrity.valid_prefix(df.limit(0), "pos", df["ok"]).count() == 0


def test_quorum_restore_and_empty_stats(spark, rows):
    assert [replication.quorum(n) for n in (1, 2, 3, 4, 5)] == [1, 2, 2, 3, 3]
    acks = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "index bigint, node string")
    assert rows(replication.acknowledged(acks, 3)) == [(1, 2, True), (2, 1, False)]
    snapshot = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    log = spark.createDataFrame([(5, "delete", "a", None), (6, " SET", "c", "3"), (2, "set", "b", "old")], "index bigint, operation string, key string, value string")
    assert rows(replication.restored(snapshot, 4, log)) == [("b", "2"), ("c", "3")]
    none = spark.createDataFrame([], CELLS + ", level int, file_no bigint")
    assert stats.summary(none, none, none).first().asDict() == {"total_sstables": 0, "data_bytes": 0, "memtable_size": 0, "memtable_keys": 0, "user_bytes": 0, "write_amplification": 0.0}


def test_many_copies_of_one_probe(spark):
    cells = spark.createDataFrame([("hot", 1, "v", False), ("gone", 2, "v", False), ("gone", 3, None, True), (None, 4, "v", False)], CELLS)
    asked = spark.createDataFrame([("hot",)] * 2500 + [("gone",)] * 2 + [("never",), (None,)], "key string")
    for spread in (False, True):
        before, mvcc._MANY_PROBES = mvcc._MANY_PROBES, 0 if spread else mvcc._MANY_PROBES
        try:
            got = {tuple(r) for r in mvcc.multi_get(cells, asked).groupBy("key", "value").count().collect()}
        finally:
            mvcc._MANY_PROBES = before
        assert got == {("hot", "v", 2500), ("gone", None, 2), ("never", None, 1), (None, None, 1)}
    assert mvcc.multi_get(cells, asked.limit(0)).count() == 0 and mvcc.multi_get(cells.limit(0), asked).count() == 2504


def test_operations_are_spelled_alike_everywhere(spark):
    blanks = "\t\n\r\x0b\x0c "
    data = [(i, f"{b}SeT{b}", "k", "v") for i, b in enumerate(blanks)]
    df = spark.createDataFrame([*data, (9, "add_node", "n", None), (10, None, "n", None)], "seq bigint, op string, key string, value string")
    assert mvcc.cells_from_mutations(df).count() == len(blanks)
    with pytest.raises(Exception, match="unknown operation"):
        mvcc.cells_from_mutations(df, strict=True).collect()


def test_percentiles_of_ties_nulls_and_single_samples(spark):
    data = [("a", float(v)) for v in range(1, 102)] + [("b", 5.0)] * 7 + [("c", None)] + [(None, 1.0), (None, 2.0)]
    got = {r["g"]: (r["samples"], r["p50"], r["p99"]) for r in stats.latency_percentiles(spark.createDataFrame(data, "g string, v double").repartition(3), "v", "g").collect()}
    assert got == {"a": (101, 51.0, 100.0), "b": (7, 5.0, 5.0), "c": (0, None, None), None: (2, 1.5, 1.99)}


def test_election_rounds(spark):
    yes = [(1, "a", 2, "prevote", "b", True), (1, "a", 2, "vote", "b", True), (1, "a", 2, "vote", "b", False)]
    no = [(2, "a", 3, "prevote", "a", True), (2, "a", 3, "prevote", "b", False), (2, "a", 3, "vote", "b", True), (2, "a", 3, "vote", "c", True)]
    lost = [(3, "b", 4, "prevote", "c", True), (3, "b", 4, "vote", "c", None)]
    df = spark.createDataFrame(yes + no + lost, "attempt int, candidate string, term int, phase string, voter string, granted boolean")
    assert {tuple(r) for r in election.rounds(df, 3).collect()} == {(1, "a", 2, 2, 2, "leader"), (2, "a", 3, 1, None, "no_prevote"), (3, "b", 4, 2, 1, "lost")}


def test_what_a_heartbeat_sends(spark):
    log = spark.createDataFrame([(i, "set", "k", "v") for i in range(1, 5)], "index bigint, operation string, key string, value string")
    have = spark.createDataFrame([("a", 4), ("b", 2), ("new", None)], "node string, index bigint")
    assert sorted((r["node"], r["index"]) for r in replication.to_send(log, have).collect()) == [("b", 3), ("b", 4), ("new", 1), ("new", 2), ("new", 3), ("new", 4)]
    assert replication.to_send(log, have.limit(0)).count() == 0
