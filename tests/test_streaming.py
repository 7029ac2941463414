import random
from datetime import datetime

from palimpsest.operators.changefeed import current_rows, rebuild, replay_changes
from palimpsest.operators.election import votes as batch_votes
from palimpsest.session import scratch_path
from palimpsest.store import Store
from palimpsest.streaming.jobs import StateTable, into_store, mutation_stream, replication_stream, votes

MUTATION = "seq bigint, op string, key string, value string"


def write_files(spark, data, schema, files=3):
    path = scratch_path(spark, "stream")
    for n in range(files):
        spark.createDataFrame(data[n::files], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def mutations(seed, n=120):
    rng = random.Random(seed)
    return [(i, *rng.choice([("SET", f"v{i}"), ("SET", ""), ("DELETE", None)])) for i in range(1, n)]


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_a_stream_into_the_store_equals_the_batch(spark):
    rng = random.Random(1)
    data = [(i, op, rng.choice(["hot", "a", "b", "c"]), v) for i, op, v in mutations(1)]
    truth = {}
    for _, op, k, v in data:
        truth.pop(k, None)
        if op == "SET":
            truth[k] = v
    with Store(spark, scratch_path(spark, "store")) as store:
        stream = mutation_stream(spark, write_files(spark, data, MUTATION), files_per_trigger=1)
        finish(into_store(stream, store).option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start())
        assert dict(map(tuple, store.dump().collect())) == truth and store.seq == len(data)


def test_a_change_feed_by_micro_batches_equals_one_replay(spark, rows):
    rng = random.Random(2)
    data = [(i, op, rng.choice(["hot", "a", "b"]), v) for i, op, v in mutations(2)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, MUTATION)
    path = write_files(spark, data + data[:30], MUTATION)
    table = StateTable(spark, scratch_path(spark, "states"), ["key"], "seq", "op", ["value"])
    stream = mutation_stream(spark, path, files_per_trigger=1)
    finish(stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start())
    before = table.table.latest()
    table.apply(df, 0)  # delivered again
    assert table.table.latest() == before == 3
    schema = replay_changes(df, ["key"], "seq", "op", ["value"]).schema
    states = table.states(schema)
    assert rows(current_rows(states, ["key"], ["value"])) == rows(rebuild(df, ["key"], "seq", "op", ["value"]))


def test_replicated_entries_come_once(spark):
    data = [(i % 40, "set", f"k{i % 40}", "v", datetime(2025, 1, 1, 0, i % 40)) for i in range(120)]
    path = write_files(spark, data, "index bigint, operation string, key string, value string, appended_at timestamp")
    query = replication_stream(spark, path).writeStream.format("memory").queryName("once").option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start()
    finish(query)
    assert sorted(r["index"] for r in spark.table("once").collect()) == list(range(40))


def test_votes_as_keyed_state_equal_the_relation(spark):
    rng = random.Random(3)
    asked = [(rng.choice(["v", "w"]), rng.choice(["a", "b"]), rng.randint(1, 6), n) for n in range(60)]
    schema = "voter string, candidate string, term bigint, seq bigint"
    path = scratch_path(spark, "requests")
    spark.createDataFrame(asked, schema).coalesce(1).write.parquet(path)
    stream = votes(spark.readStream.schema(schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("votes").option("checkpointLocation", scratch_path(spark, "progress")).outputMode("append").trigger(availableNow=True).start()
    finish(query)
    expected = {r["seq"]: r["granted"] for r in batch_votes(spark.createDataFrame(asked, schema)).collect()}
    assert {r["seq"]: r["granted"] for r in spark.table("votes").collect()} == expected


def test_a_micro_batch_that_comes_again_changes_no_figure(spark):
    with Store(spark, scratch_path(spark, "store")) as store:
        batch = spark.createDataFrame([(1, "SET", "a", "1"), (2, "SET", "b", "2")], MUTATION)
        store.apply_batch(batch, "feed", 0)
        before = store.stats()
        store.apply_batch(batch, "feed", 0)
        assert store.stats() == before and store.cells().count() == 2
        store.apply_batch(batch.selectExpr("seq + 2 AS seq", "op", "key", "value"), "another", 0)
        assert store.seq == 4


def test_a_micro_batch_rewrites_only_the_buckets_it_touches(spark):
    table = StateTable(spark, scratch_path(spark, "states"), ["key"], "seq", "op", ["value"])
    table.apply(spark.createDataFrame([(i, "SET", f"k{i}", "v") for i in range(40)], MUTATION), 0)
    before = table.table.content()["buckets"]
    table.apply(spark.createDataFrame([(99, "SET", "k7", "w")], MUTATION), 1)
    after = table.table.content()["buckets"]
    assert len(before) > 10 and before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
