import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.dedup import DeliveryTable, surplus
from palimpsest.session import scratch_path

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("who", T.StringType()), T.StructField("msg", T.LongType()), T.StructField("day", T.StringType()), T.StructField("payload", T.StringType())])


def delivery_table(spark):
    return DeliveryTable(spark, scratch_path(spark, "deliveries"), SCHEMA, ["who", "msg"], "id", F.col("day"))


def deliveries(seed, n=200):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b"]), rng.choice([None] + [1] * 10 + list(range(30))), rng.choice(["d1", "d2", "d3", None, "o/dd=%"]), rng.choice([None, "", "p"])) for i in range(n)]


def winners(data):
    best = {}
    for r in data:
        if r[2] is not None:
            best[r[1], r[2]] = min(best.get((r[1], r[2]), r), r, key=lambda x: x[0])
    return sorted([*best.values(), *(r for r in data if r[2] is None)], key=repr)


def test_batches_in_and_out_of_order_keep_the_first_delivery(spark, rows):
    data = deliveries(3)
    for batches in ([data[:70], data[70:140], data[140:]], [data[140:], data[:70], data[70:140]]):
        t = delivery_table(spark)
        for n, b in enumerate(batches):
            t.apply(spark.createDataFrame(b, SCHEMA), n)
        assert rows(t.rows()) == winners(data)
        kept = {r[0] for r in winners(data)}
        assert {r["id"] for r in surplus(spark.createDataFrame(data, SCHEMA), t, "id").collect()} == set(range(200)) - kept


def test_a_batch_applied_twice_changes_nothing(spark, rows):
    data = deliveries(4, 60)
    t = delivery_table(spark)
    v = t.apply(spark.createDataFrame(data, SCHEMA), 0)
    assert t.apply(spark.createDataFrame(data, SCHEMA), 0) == v
    t.apply(spark.createDataFrame(data, SCHEMA), 7)
    assert rows(t.rows().where("msg IS NOT NULL")) == [r for r in winners(data) if r[2] is not None]


def test_only_affected_partitions_are_replaced(spark):
    t = delivery_table(spark)
    t.apply(spark.createDataFrame([(1, "a", 1, "d1", "x"), (2, "a", 2, "d2", "x")], SCHEMA), 0)
    before = t.table.content()["parts"]
    t.apply(spark.createDataFrame([(3, "a", 2, "d3", "y")], SCHEMA), 1)
    after = t.table.content()["parts"]
    assert after["vd1"] == before["vd1"] and after["vd2"] != before["vd2"]
    assert {r["id"] for r in t.rows().collect()} == {1, 2}
    assert {r["id"] for r in t.rows(1).collect()} == {1, 2}


def test_empty_and_extra_columns(spark):
    t = delivery_table(spark)
    t.apply(spark.createDataFrame([], SCHEMA).withColumn("_part", F.lit("x")).withColumn("_row", F.lit(1)), 0)
    assert t.rows().count() == 0
    t.apply(spark.createDataFrame([(5, "a", 1, None, None)], SCHEMA).withColumn("_part", F.lit("x")), 1)
    assert [tuple(r) for r in t.rows().collect()] == [(5, "a", 1, None, None)]


def test_a_lost_batch_leaves_nothing_that_counts(spark, rows, monkeypatch):
    data = deliveries(6, 80)
    t = delivery_table(spark)
    t.apply(spark.createDataFrame(data[:40], SCHEMA), 0)
    monkeypatch.setattr(t.table, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.apply(spark.createDataFrame(data[40:], SCHEMA), 1)
    monkeypatch.undo()
    assert rows(t.rows()) == winners(data[:40])
    t.apply(spark.createDataFrame(data[40:], SCHEMA), 1)
    assert rows(t.rows()) == winners(data)
    t.vacuum()
    assert rows(t.rows()) == winners(data)


def test_many_small_batches_and_another_number_of_shuffle_partitions(spark, rows):
    """The number of buckets is the table's; runs of the index are merged; batches in order need no list."""
    data = deliveries(8, 180)
    made = delivery_table(spark)
    for n in range(9):
        spark.conf.set("spark.sql.shuffle.partitions", 2 + n % 4)
        try:
            again = DeliveryTable(spark, made.table.path, SCHEMA, ["who", "msg"], "id", F.col("day"))
            again.apply(spark.createDataFrame(data[20 * n : 20 * n + 20], SCHEMA), n)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert rows(again.rows()) == winners(data)
    content = again.table.content()
    assert content["batches"] == {"upto": 8, "beyond": []} and len(content["runs"]) < 9 and content["index"]["buckets"] == again.index.buckets == 2
    with pytest.raises(ValueError, match="defined as"):
        made.apply(spark.createDataFrame(data, SCHEMA), 99)  # made when the table didn't exist, under another setting
    with pytest.raises(ValueError, match="defined as"):
        DeliveryTable(spark, made.table.path, SCHEMA, ["who"], "id", F.col("day"))
    with pytest.raises(ValueError, match="defined as"):
        DeliveryTable(spark, made.table.path, SCHEMA, ["who", "msg"], "id", F.col("day"), buckets=3)
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("run_")]


def test_the_index_is_not_shuffled(spark):
    t = delivery_table(spark)
    t.apply(spark.createDataFrame([(1, "a", 1, "d1", "x")], SCHEMA), 0)
    for partitions in (2, 4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            ids = t.index.aligned(spark.createDataFrame([("a", 1)], "_i0 string, _i1 bigint").groupBy("_i0", "_i1").count())
            for run in t.index.each(t.table.content()["runs"]):
                ids = ids.join(run.hint("merge"), t.index.by, "left")
            text = ids._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert "SortMergeJoin" in text and "Exchange" not in text[text.index("Scan parquet") - 300 :], text
