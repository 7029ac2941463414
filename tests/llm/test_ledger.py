import random

import pytest

from palimpsest.llm import queries
from palimpsest.llm.ledger import KeyLedger
from palimpsest.plans.tables import in_growing_batches
from palimpsest.session import scratch_path

SCHEMA = "k string, pos bigint, _key string, _first string"


def generate(seed, n=300):
    rng = random.Random(seed)
    keys = ["hot"] * 10 + ["a", "A", "a ", "é", "e\u0301", "", None, *(f"k{i}" for i in range(60))]
    return [(rng.choice(keys), p, "x", "y") for p in range(n)]


def expected(data, known=()):
    seen, out = set(known), []
    for k, p, *_ in data:
        if k is not None and k in seen:
            out.append(p)
        seen.add(k)
    return out


def ledger(spark, known=(), **options):
    made = KeyLedger(spark, scratch_path(spark, "ledger"), **options)
    made.seed(spark.createDataFrame([(k,) for k in known], "key string"), "key")
    return made


def add(spark, made, data, n):
    return sorted(r["pos"] for r in made.add(spark.createDataFrame(data, SCHEMA).repartition(3), "k", "pos", n).collect())


def test_every_batch_is_answered_as_in_one_pass(spark):
    data = generate(1)
    made = ledger(spark, ["k1", "k2", "k2", None], buckets=3)
    got = [p for n in range(3) for p in add(spark, made, data[100 * n : 100 * n + 100], n)]
    assert got == expected(data, {"k1", "k2"})
    rows = made.add(spark.createDataFrame(data[:1], SCHEMA), "k", "pos", 3)
    assert rows.columns == ["k", "pos", "_key", "_first"]


def test_a_batch_added_again_has_the_same_answer_and_changes_nothing(spark):
    data = generate(2, 200)
    made = ledger(spark)
    first = add(spark, made, data[:100], 0)
    version = made.table.latest()
    assert add(spark, made, data[:100], 0) == first and made.table.latest() == version
    second = add(spark, made, data[100:], 1)
    assert add(spark, made, data[100:], 1) == second and add(spark, made, data[:100], 0) == first
    assert first + second == expected(data)


def test_a_batch_that_was_lost_half_way_leaves_nothing(spark, monkeypatch):
    data = generate(3, 100)
    made = ledger(spark)
    monkeypatch.setattr(made.table, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        made.add(spark.createDataFrame(data, SCHEMA), "k", "pos", 0)
    monkeypatch.undo()
    assert add(spark, made, data, 0) == expected(data)


def test_reopened_under_other_settings_it_stays_exact_or_is_refused(spark):
    """With 3 buckets written, and 5 shuffle partitions when read: every key must be recognised."""
    data = [(f"k{i}", i, "", "") for i in range(1000)]
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        made = ledger(spark)
        assert add(spark, made, data, 0) == []
        for n, partitions in ((1, 5), (2, 2), (3, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            again = KeyLedger(spark, made.path)
            assert again.runs.buckets == 3
            assert add(spark, again, [(k, p + 1000 * n, "", "") for k, p, *_ in data], n) == [p + 1000 * n for p in range(1000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    with pytest.raises(ValueError, match="defined as"):
        KeyLedger(spark, made.path, buckets=5)


def test_many_small_batches_keep_few_runs(spark):
    data = generate(4, 180)
    made = ledger(spark, ["k5"])
    got = [p for n in range(9) for p in add(spark, made, data[20 * n : 20 * n + 20], n)]
    assert got == expected(data, {"k5"}) and len(made.table.content()["runs"]) < 8
    assert made.table.content()["batches"] == {"upto": 8, "beyond": []}
    assert made.history().select("_key").distinct().count() == made.history().count()


def test_empty_tables_and_long_keys(spark):
    made = ledger(spark)
    empty = spark.createDataFrame([], SCHEMA)
    assert made.add(empty, "k", "pos", 0).count() == 0 and made.history().count() == 0
    assert add(spark, made, [("x" * 100_000, 1, "", ""), ("x" * 100_000, 2, "", ""), ("y", None, "", ""), ("z", 3, "", ""), ("z", 3, "", "")], 1) == [2]


def test_neither_append_nor_answer_shuffles_or_broadcasts_the_history(spark, monkeypatch):
    made = ledger(spark, [f"k{i}" for i in range(50)])
    plans = []
    write = made.runs.write
    monkeypatch.setattr(made.runs, "write", lambda rows: plans.append(rows) or write(rows))
    answer = made.add(spark.createDataFrame(generate(5, 50), SCHEMA), "k", "pos", 0)
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    history = text.index("Scan parquet")
    assert "SortMergeJoin" in text and "Bucketed: true" in text and "Exchange" not in text[history - 300 :] and "Broadcast" not in text
    # The answer reads the batch's own new keys alone.
    folders = {p.split("/data/")[1].split("/")[0] for p in answer.inputFiles() if "/data/" in p}
    assert folders == {made.table.content()["runs"][-1]["folder"].split("/")[1]}


def test_batches_that_grow_are_few_and_whole(spark):
    for positions in ([7], [3, 3, 3], list(range(-5, 95)), [1, 2, 10**12], [None, *range(20), None], [None], [], [-(2**63), 2**63 - 1]):
        rows = spark.createDataFrame([(p,) for p in positions], "pos bigint").coalesce(1)
        got = [sorted((r["pos"] for r in b.collect()), key=lambda p: (p is None, p)) for b in in_growing_batches(rows, "pos", 3, 2)]
        assert [p for b in got for p in b] == sorted(positions, key=lambda p: (p is None, p))
        assert len(got) <= 7
    assert [b.count() for b in in_growing_batches(spark.range(96), "id", 3, 2)] == [3, 3, 6, 12, 24, 48]
    assert [b.count() for b in in_growing_batches(spark.range(6), "id", 3, 2)] == [3, 3]


def test_the_answer_of_many_records_takes_few_batches_and_a_small_plan(spark, tmp_path, monkeypatch):
    """640 records in first batches of 10: 64 equal batches would leave 64 joins and their files to the driver."""
    data = generate(6, 640)
    spark.createDataFrame([(p, k) for k, p, *_ in data], "rec_id bigint, k string").write.parquet(f"{tmp_path}/sst_record.parquet")
    spark.createDataFrame([("k1",), ("k2",)], "k string").write.parquet(f"{tmp_path}/key_ledger.parquet")
    monkeypatch.setattr(queries, "LEDGER_BATCH", 10)
    added, add_to = [], KeyLedger.add
    monkeypatch.setattr(KeyLedger, "add", lambda self, *a: added.append(a) or add_to(self, *a))
    found = queries.p1_found(spark, str(tmp_path))
    assert sorted(r["rec_id"] for r in found.collect()) == expected(data, {"k1", "k2"})
    assert len(added) == 8 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
