import pytest

from palimpsest.operators.incremental import IncrementalTarget
from palimpsest.session import scratch_path
from palimpsest.sources.versioned import Conflict

KEY, VERSION = [("k", "string"), ("n", "int")], ("v", "bigint")


def target(spark):
    return IncrementalTarget(spark, scratch_path(spark, "target"), KEY, VERSION, [("out", "string")])


def source(spark, data):
    return spark.createDataFrame(data, "k string, n int, v bigint, `_done0` string")


def run(t, df):
    return t.run(df, lambda p: p.selectExpr("k", "n", "v", "upper(k) AS out"))


def test_only_new_and_changed_rows_are_processed(spark, rows):
    t = target(spark)
    run(t, source(spark, [("a", 1, 1, "x"), ("b", 1, 1, "x")]))
    later = source(spark, [("a", 1, 1, "x"), ("b", 1, 2, "y"), ("c", 1, 1, "x"), ("c", 1, 1, "z"), (None, None, None, "q")])
    assert rows(t.pending(later).select("k", "n", "v")) == sorted([("b", 1, 2), ("c", 1, 1), (None, None, None)], key=repr)
    run(t, later)
    assert t.pending(later).count() == 0
    assert t.rows().count() == 5
    assert rows(t.rows(1).select("k", "out")) == [("a", "A"), ("b", "B")]


def test_a_run_that_fails_leaves_nothing(spark):
    t = target(spark)
    df = source(spark, [("a", 1, 1, "x")])
    with pytest.raises(Exception, match="boom"):
        t.run(df, lambda p: p.selectExpr("k", "n", "v", "raise_error('boom') AS out"))
    assert t.table.latest() == 0
    assert t.pending(df).count() == 1


def test_of_two_runs_at_once_one_is_refused(spark):
    t = target(spark)
    df = source(spark, [("a", 1, 1, "x")])
    out = t.pending(df).selectExpr("k", "n", "v", "k AS out")
    t.publish(out, after=0)
    with pytest.raises(Conflict):
        t.publish(out, after=0)
    assert t.rows().count() == 1


def test_empty_source(spark):
    t = target(spark)
    run(t, source(spark, []))
    assert t.rows().count() == 0 and t.table.latest() == 1


def test_what_is_retracted_is_pending_again(spark, rows):
    t = target(spark)
    df = source(spark, [("a", 1, 1, "x"), ("b", 1, 1, "x"), (None, 1, 1, "x")])
    run(t, df)
    t.retract(lambda r: r.where("NOT (k <=> 'b')"))
    assert rows(t.pending(df).select("k")) == [("b",)] and t.rows().count() == 2 and t.rows(1).count() == 3


def test_many_runs_and_another_number_of_shuffle_partitions(spark):
    t = target(spark)
    for n in range(9):
        spark.conf.set("spark.sql.shuffle.partitions", 2 + n % 4)
        try:
            again = IncrementalTarget(spark, t.table.path, KEY, VERSION, [("out", "string")])
            df = source(spark, [(f"k{i}", 1, 1, "") for i in range(10 * n + 10)])
            assert again.pending(df).count() == 10
            run(again, df)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(again.table.content()["runs"]) < 8 and again.pending(df).count() == 0
    with pytest.raises(ValueError, match="defined as"):
        IncrementalTarget(spark, t.table.path, KEY, VERSION, [("out", "string")], buckets=9)


def test_the_target_is_not_shuffled(spark):
    t = target(spark)
    run(t, source(spark, [("a", 1, 1, "x")]))
    text = t.pending(source(spark, [("a", 1, 1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text[text.index("Scan parquet") - 300 :]
