import struct
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.integrity import file_number, segment_number, verify_records
from palimpsest.session import scratch_path
from palimpsest.sources.formats import decode_wal, read_sparse_index, read_sstables, read_wal, replay_wal, wal_frame, write_sparse_index, write_sstables

CELLS = [("k", 1, "v", False), ("ключ", 2, "", False), ("k", 3, None, True), ('q"\\', 2**40, "a\tb\n", False)]
SCHEMA = "key string, seq bigint, value string, is_tombstone boolean"


def frame(kind, seq, key, value=None):
    payload = struct.pack("<BQI", kind, seq, len(key.encode())) + key.encode()
    if kind == 0:
        payload += struct.pack("<I", len(value.encode())) + value.encode()
    return struct.pack("<I", len(payload)) + payload + struct.pack("<I", zlib.crc32(payload))


def test_wal_frames_equal_their_encoding_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame(CELLS, SCHEMA).coalesce(1)
    frames = [bytes(r[0]) for r in df.select(wal_frame(F.col("seq"), F.col("key"), F.col("value"), F.col("is_tombstone"))).collect()]
    assert frames == [frame(int(t), s, k, v) for k, s, v, t in CELLS]
    (tmp_path / "wal-9.log").write_bytes(b"".join(frames[:2]))
    (tmp_path / "wal-10.log").write_bytes(b"".join(frames[2:]))
    got = read_wal(spark, str(tmp_path)).orderBy("segment_no", "pos").collect()
    assert [(r["segment_no"], r["seq"], r["op"], r["key"], r["value"]) for r in got] == [(9 if i < 2 else 10, s, "DELETE" if t else "SET", k, v) for i, (k, s, v, t) in enumerate(CELLS)]


def test_replay_stops_at_the_first_bad_record():
    good = [frame(0, i, f"k{i}", "v") for i in range(3)]
    flipped = bytearray(good[1])
    flipped[10] ^= 1
    assert [r and r[1] for r in decode_wal(good[0] + bytes(flipped) + good[2])] == [0, None]
    assert [r and r[1] for r in decode_wal(good[0] + good[1][:-1])] == [0, None]
    assert list(decode_wal(b"")) == [] and list(decode_wal(bytes(8))) == list(decode_wal(b"x")) == [None]


def test_sstables_round_trip_and_corruption_is_an_error(spark, rows):
    path = scratch_path(spark, "sst")
    write_sstables(spark.createDataFrame(CELLS, SCHEMA), path)
    assert rows(read_sstables(spark, path)) == sorted(CELLS, key=repr)
    bad = scratch_path(spark, "sst")
    spark.read.text(path).select(F.regexp_replace("value", '"k"', '"K"').alias("value")).write.text(bad)
    with pytest.raises(Exception, match="corrupt record"):
        read_sstables(spark, bad).collect()


def test_lines_that_are_no_records(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",), ("x\tnot a number",), ("x\t",), (f"x\t{zlib.crc32(b'x')}\n",), (f"x\ty\t{zlib.crc32(b'x' + bytes([9]) + b'y')}",)], "line string")
    assert [r["is_valid"] for r in verify_records(df).collect()] == [False, False, False, False, False, True, True]


def test_numbers_in_names(spark):
    df = spark.createDataFrame([("wal-10.log", "sst_12"), ("wal-x.log", "sst"), (None, None)], "w string, s string")
    assert [tuple(r) for r in df.select(segment_number(F.col("w")), file_number(F.col("s"))).collect()] == [(10, 12), (None, None), (None, None)]


def test_a_bad_record_ends_the_replay_of_all_later_segments(spark, tmp_path):
    good = [frame(0, i, f"k{i}", "v") for i in range(6)]
    (tmp_path / "wal-2.log").write_bytes(good[0] + good[1])
    (tmp_path / "wal-10.log").write_bytes(good[2] + good[3][:-2])
    (tmp_path / "wal-11.log").write_bytes(good[4] + good[5])
    assert sorted(r["seq"] for r in read_wal(spark, str(tmp_path)).collect()) == [0, 1, 2, 4, 5]
    assert sorted(r["seq"] for r in replay_wal(spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_sparse_index_round_trip_and_corruption_is_an_error(spark, rows):
    entries = [("a", 0), ("ключ\t", 2**40), ("", 7)]
    path, bad = scratch_path(spark, "index"), scratch_path(spark, "index")
    write_sparse_index(spark.createDataFrame(entries, "key string, offset bigint"), path)
    assert rows(read_sparse_index(spark, path)) == sorted(entries, key=repr)
    spark.read.text(path).select(F.replace("value", F.lit('"k"'), F.lit('"K"')).alias("value")).write.text(bad)
    with pytest.raises(Exception, match="corrupt record"):
        read_sparse_index(spark, bad).collect()
