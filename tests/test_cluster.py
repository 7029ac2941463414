from palimpsest.cluster import ReplicatedLog, VoteState
from palimpsest.config import EngineConfig
from palimpsest.session import scratch_path

ENTRY = "index bigint, operation string, key string, value string"


def test_a_vote_survives_a_restart(spark):
    path = scratch_path(spark, "vote")
    assert VoteState(spark, path).vote("a", 1)
    again = VoteState(spark, path)
    assert (again.term, again.voted_for) == (1, "a")
    assert again.vote("a", 1) and not again.vote("b", 1) and not again.vote("b", 0)
    assert again.stand("me") == 2 and not VoteState(spark, path).vote("b", 2)
    assert VoteState(spark, path).vote("b", 3) and VoteState(spark, path).voted_for == "b"


def test_the_log_is_compacted_beyond_its_threshold(spark, rows):
    log = ReplicatedLog(spark, scratch_path(spark, "log"), EngineConfig(log_compaction_threshold=4))
    first = spark.createDataFrame([(i, "set", f"k{i}", str(i)) for i in range(1, 5)], ENTRY)
    assert log.append(first) == 4 and log.catch_up(2)[0] is None and log.catch_up(2)[2].count() == 2
    assert log.append(first) == 4  # sent again
    assert log.append(spark.createDataFrame([(5, "delete", "k1", None), (6, "add_node", "n", None)], ENTRY)) == 6
    snapshot, index, entries = log.catch_up(2)
    assert index == 6 and entries.count() == 0 and rows(snapshot) == [("k2", "2"), ("k3", "3"), ("k4", "4")]
    assert log.append(spark.createDataFrame([(7, "set", "k1", "new")], ENTRY)) == 7
    assert log.catch_up(6)[0] is None and [r["index"] for r in log.catch_up(6)[2].collect()] == [7]
    assert rows(log.state()) == [("k1", "new"), ("k2", "2"), ("k3", "3"), ("k4", "4")]


def test_an_empty_log(spark):
    log = ReplicatedLog(spark, scratch_path(spark, "log"))
    assert log.append(spark.createDataFrame([], ENTRY)) == 0 and log.state().count() == 0
