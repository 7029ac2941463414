import random

from palimpsest.operators.diff import diff_copies, diff_tagged


def test_against_brute_force(spark, rows):
    rng = random.Random(1)
    value = lambda: rng.choice([None, "", "a", "b"])
    left = {k: (value(), value()) for k in rng.sample(range(60), 40)}
    right = {k: left[k] if k in left and rng.random() < 0.5 else (value(), value()) for k in rng.sample(range(60), 40)}
    expected = []
    for k in left.keys() | right.keys():
        if k not in right:
            expected.append((k, "only_left"))
        elif k not in left:
            expected.append((k, "only_right"))
        else:
            expected += [(k, f) for f, x, y in zip("xy", left[k], right[k], strict=True) if x != y]
    frames = [spark.createDataFrame([(k, *v) for k, v in d.items()] * 2, "k int, x string, y string") for d in (left, right)]
    assert rows(diff_copies(*frames, ["k"], ["x", "y"])) == sorted(expected, key=repr)


def test_all_null_rows_null_keys_and_clashing_names(spark, rows):
    schema = "`_row` string, `_l` string, side string, there int"
    data = [(None, None, "L", 1), (None, None, "R", 2), ("a", None, "L", 1), ("b", "x", "R", 1), ("c", "x", "L", 1), ("c", None, "R", 1), ("z", "q", "other", 1), ("z", "q", None, 1)]
    got = diff_tagged(spark.createDataFrame(data, schema), "side", ["_row"], ["_l"], "L", "R")
    assert rows(got) == [("a", "only_left"), ("b", "only_right"), ("c", "_l")]


def test_empty_sides_no_fields_and_quoted_names(spark, rows):
    full = spark.createDataFrame([(1, "x")], "k int, `it's` string")
    none = full.limit(0)
    assert rows(diff_copies(full, none, ["k"], ["it's"])) == [(1, "only_left")]
    assert rows(diff_copies(none, full, ["k"], ["it's"])) == [(1, "only_right")]
    assert rows(diff_copies(none, none, ["k"], ["it's"])) == []
    assert rows(diff_copies(full, spark.createDataFrame([(1, "y")], full.schema), ["k"], ["it's"])) == [(1, "it's")]
    assert rows(diff_copies(full, full, ["k"], [])) == []


def test_rows_of_one_side_that_disagree_have_one_result(spark, rows):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], "k int, v string")
    right = spark.createDataFrame([(1, "b")], "k int, v string")
    for n in (1, 3):
        assert rows(diff_copies(left.repartition(n), right, ["k"], ["v"])) == []
