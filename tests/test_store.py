import random

import pytest

from palimpsest.cli import answer
from palimpsest.config import EngineConfig
from palimpsest.session import scratch_path
from palimpsest.sources.versioned import CorruptManifest
from palimpsest.store import Store

SMALL = EngineConfig(max_memtable_size=200, max_l0_files=2, wal_buffer_size=50)


@pytest.fixture
def path(spark):
    return scratch_path(spark, "store")


def dumped(store):
    return dict(map(tuple, store.dump().collect()))


def test_set_get_delete_and_empty_value(spark, path):
    with Store(spark, path) as s:
        assert s.get("foo") is None
        s.set("foo", "bar")
        s.set("empty", "")
        assert s.get("foo") == "bar" and s.get("empty") == ""
        s.delete("foo")
        s.delete("never there")
        assert s.get("foo") is None and s.seq == 4
        s.flush()
        assert s.get("empty") == ""


def test_restart_keeps_everything(spark, path):
    with Store(spark, path) as s:
        s.set("a", "1")
        s.flush()
        s.delete("a")
        s.set("b", "2")
    with Store(spark, path) as s:
        assert s.get("a") is None and s.get("b") == "2" and s.seq == 3
        assert s.stats()["bytes_written_user"] == 5


def test_second_writer_is_refused_and_readers_are_not(spark, path):
    with Store(spark, path) as s:
        s.set("a", "1")
        s.commit()
        with pytest.raises(RuntimeError):
            Store(spark, path)
        assert Store.reader(spark, path).get("a") == "1"
    Store(spark, path).close()


def test_random_log_against_a_dict_at_every_layout(spark, path):
    rng = random.Random(2)
    truth, history = {}, []
    with Store(spark, path, SMALL) as s:
        for i in range(120):
            k = rng.choice(["hot", *(f"k{j}" for j in range(20))])
            if rng.random() < 0.3:
                s.delete(k)
                truth.pop(k, None)
            else:
                s.set(k, f"v{i}")
                truth[k] = f"v{i}"
            history.append(dict(truth))
        assert dumped(s) == truth
        s.flush()
        assert dumped(s) == truth
        s.compact(0)
        assert dumped(s) == truth
        assert [tuple(r) for r in s.scan("k1", "k3").collect()] == sorted((k, v) for k, v in truth.items() if "k1" <= k <= "k3")
        assert s.scan("z", "a").count() == 0
        assert s.verify().count() == 0


def test_snapshots_survive_compaction_and_are_reclaimed_after(spark, path):
    with Store(spark, path) as s:
        s.set("k", "v1")
        s.set("d", "before")
        with s.snapshot() as at, s.snapshot() as again:
            assert at == again and s.stats()["active_snapshots"] == {2: 2}
            s.set("k", "v2")
            s.delete("d")
            s.set("k", "v3")
            s.flush()
            s.compact(0)
            assert s.get("k", at) == "v1" and s.get("d", at) == "before" and s.get("d") is None
            assert s.get("k", 0) is None
        s.set("x", "y")
        s.flush()
        s.compact(0)
        s.compact(1)
        assert s.get("k", at) is None and s.get("k") == "v3"
        assert s.stats()["active_snapshots"] == {}


def test_tombstones_stay_while_a_deeper_file_needs_them(spark, path):
    with Store(spark, path) as s:
        s.set("a", "1")
        s.set("z", "1")
        s.flush()
        s.compact(0)
        s.compact(1)  # at level 2
        s.delete("a")
        s.flush()
        s.compact(0)
        assert s.get("a") is None and {f["level"] for f in s.state["files"]} == {1, 2}
        s.compact(1)
        assert dumped(s) == {"z": "1"} and [f["records"] for f in s.state["files"]] == [1]


def test_reads_stay_valid_after_compaction_until_vacuum(spark, path):
    with Store(spark, path) as s:
        s.set("a", "1")
        s.flush()
        frame, rest = s.dump(), s.iter()
        s.set("a", "2")
        s.flush()
        s.compact(0)
        assert [tuple(r) for r in frame.collect()] == [("a", "1")] and list(rest) == [("a", "1")]
        assert s.vacuum() and s.get("a") == "2"


def test_batches_and_multi_get(spark, path):
    with Store(spark, path) as s:
        batch = spark.createDataFrame([(1, " set", "a", "1"), (2, "DELETE", "b", None), (3, "Set", "a", "2")], "n int, op string, key string, value string")
        assert s.write(batch, ["n"]) == 3
        probes = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
        assert sorted(map(tuple, s.multi_get(probes).collect())) == [("a", "2"), ("b", None), ("c", None)]
        with pytest.raises(Exception, match="without operation"):
            s.write(batch.selectExpr("n", "op", "key", "'x' AS value").unionByName(spark.createDataFrame([(4, "set", None, "x")], "n int, op string, key string, value string")), ["n"])
        assert s.seq == 3


def test_stats(spark, path):
    with Store(spark, path, EngineConfig(max_l0_files=100)) as s:
        for i in range(10):
            s.set(str(i), str(i))
        s.flush()
        s.set("m", "1")
        found = s.stats()
        assert found["sstables_per_level"] == {0: 1} and found["total_sstables"] == 1
        assert found["memtable_keys"] == 1 and found["memtable_size"] == 2 and found["seq"] == 11
        assert found["bytes_written_user"] == 22 and found["write_amplification"] > 1


def test_corrupt_manifest_is_an_error_and_deletes_nothing(spark, path):
    with Store(spark, path) as s:
        s.set("a", "1")
        s.flush()
        version, files = s.version, s.table.files
    name = f"{path}/versions/{version:012d}.json"
    good = files.read(name)
    for bad in (b"garbage corruption", good.replace(b'"a"', b'"b"')):
        files.delete(name)
        files.write(name, bad)
        with pytest.raises(CorruptManifest):
            Store(spark, path, break_lock=True)
    files.delete(name)
    files.write(name, good)
    assert Store.reader(spark, path).get("a") == "1"


def test_shell(spark, path):
    with Store(spark, path) as s:
        assert answer(s, "SET a 1") == "ok" and answer(s, "get a") == "1" and answer(s, "GET a 0") == "(none)"
        assert answer(s, "get a x") == "a sequence number is needed" and answer(s, "set a") == "SET takes 2 arguments"
        assert answer(s, "scan a z") == "a 1" and answer(s, "nonsense") == "unknown command: nonsense"
        assert answer(s, "delete a") == "ok" and answer(s, "scan a z") == "(none)" and "total_sstables: 0" in answer(s, "stats")
        assert answer(s, "exit") is None


def test_compaction_cuts_its_output_and_rewrites_only_what_overlaps(spark, path):
    config = EngineConfig(max_memtable_size=40, max_l0_files=100, level_factor=2)
    with Store(spark, path, config) as s:
        rows = [("SET", f"k{i:03d}", "x" * 10) for i in range(60)]
        s.write(spark.createDataFrame(rows, "op string, key string, value string"), ["key"])
        s.flush()
        s.compact(0)
        files = sorted((f for f in s.state["files"]), key=lambda f: f["min_key"])
        assert len(files) == 12 and {f["level"] for f in files} == {1} and all(f["records"] == 5 for f in files)  # 14 units each, 80 a file
        assert all(a["max_key"] < b["min_key"] for a, b in zip(files, files[1:], strict=False))
        assert dumped(s) == {k: v for _, k, v in rows}
        s.set("k012", "new" * 12)
        s.flush()
        s.compact(0)
        now = {f["folder"]: f for f in s.state["files"]}
        gone = [f for f in files if f["folder"] not in now]
        assert [(f["min_key"], f["max_key"]) for f in gone] == [("k010", "k014")]
        assert s.get("k012") == "new" * 12 and s.get("k011") == "x" * 10
        held = {p.split("/data/")[1].rsplit("/", 1)[0] for p in s.cells("k030", "k031").inputFiles()}
        assert held == {f["folder"].split("/", 1)[1] for f in s.state["files"] if f["min_key"] <= "k031" and f["max_key"] >= "k030"}
        s.vacuum()
        assert len(dumped(s)) == 60 and s.verify().count() == 0


def test_a_key_of_many_versions_is_spread_over_a_file(spark, path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with Store(spark, path, EngineConfig(max_memtable_size=10**9)) as s:
        s.write(spark.range(20_000).selectExpr("'SET' AS op", "'hot' AS key", "cast(id AS string) AS value", "id"), ["id"])
        s.flush()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(s.cells().inputFiles()) > 1 and s.get("hot") == "19999" and s.get("hot", 5) == "4"


def test_a_missing_file_is_an_error_and_what_no_version_names_goes(spark, path):
    with Store(spark, path) as s:
        s.set("a", "1")
        s.flush()
        lost = s.table.write(s.cells())
    with Store(spark, path) as s:
        assert not s.table.files.exists(f"{path}/{lost}") and s.get("a") == "1"
        folder = s.state["files"][0]["folder"]
    s.table.files.delete(f"{path}/{folder}")
    for _ in range(2):  # the lock isn't kept
        with pytest.raises(RuntimeError, match="lacks"):
            Store(spark, path)


def test_recovery_from_log_segments(spark, path, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.sources.formats import wal_frame

    cells = spark.createDataFrame([("a", 1, "1", False), ("b", 2, "2", False), ("a", 3, None, True), ("c", 4, "4", False)], "key string, seq bigint, value string, is_tombstone boolean").coalesce(1)
    frames = [bytes(r[0]) for r in cells.select(wal_frame(F.col("seq"), F.col("key"), F.col("value"), F.col("is_tombstone"))).collect()]
    (tmp_path / "wal-9.log").write_bytes(frames[0] + frames[1])
    (tmp_path / "wal-10.log").write_bytes(frames[2] + frames[3][:-1])
    with Store(spark, path) as s:
        assert s.recover(str(tmp_path)) == 3 and dumped(s) == {"b": "2"}
        before = s.stats()
        assert s.recover(str(tmp_path)) == 3 and s.stats() == before
    (tmp_path / "wal-10.log").write_bytes(frames[2] + frames[3])
    with Store(spark, path) as s:
        assert s.recover(str(tmp_path)) == 4 and dumped(s) == {"b": "2", "c": "4"}


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\r", "\x0b"])
def test_no_row_of_a_batch_is_lost_for_its_spelling(spark, path, blank):
    with Store(spark, path) as s:
        rows = [("SET", "a", "1"), (f"{blank}Set{blank}", "b", "2")]
        assert s.write(spark.createDataFrame(rows, "op string, key string, value string"), ["key"]) == 2
        assert dumped(s) == {"a": "1", "b": "2"}
