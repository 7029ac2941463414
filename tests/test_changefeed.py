import random

from palimpsest.operators.changefeed import current_rows, rebuild, replay_changes

SCHEMA = "key string, pos bigint, op string, a string, b int, changed array<string>"


def brute(changes, create_on_update=True):
    """The changes of each key one by one in order; of those at one position, deletes last."""
    state = {}
    order = {"insert": 0, "update": 0, "delete": 1}
    for key, pos, op, a, b, changed in sorted((c for c in changes if c[0] is not None and c[1] is not None), key=lambda c: (c[1], order[c[2]])):
        if op == "delete":
            state.pop(key, None)
        elif op == "insert":
            state[key] = {"a": a, "b": b, "pos": pos} if changed is None else {"a": a if "a" in changed else None, "b": b if "b" in changed else None, "pos": pos}
            if changed is not None:
                raise AssertionError("the generator gives inserts no list")
        else:
            row = state.setdefault(key, {"a": None, "b": None, "pos": pos}) if create_on_update else state.get(key)
            if row is not None:
                row["pos"] = pos
                for c, v in (("a", a), ("b", b)):
                    if (changed is None and v is not None) or (changed is not None and c in changed):
                        row[c] = v
    return sorted((k, r["a"], r["b"], r["pos"]) for k, r in state.items())


def generate(rng, n):
    out = []
    for pos in rng.sample(range(10 * n), n):
        key = rng.choice(["hot"] * 5 + ["x", "y", "", "ключ", None])
        op = rng.choice(["insert", "update", "update", "delete"])
        a, b = rng.choice([None, "", "v1", "v2"]), rng.choice([None, 1, 2])
        changed = rng.choice([None, ["a"], ["b"], ["a", "b"], []]) if op == "update" else None
        out.append((key, pos, op, *((None, None) if op == "delete" else (a, b)), changed))
    return out


def test_against_brute_force_in_any_order_with_repeats(spark, rows):
    for seed in range(4):
        rng = random.Random(seed)
        changes = generate(rng, 120)
        sent = changes + rng.sample(changes, 40)
        rng.shuffle(sent)
        df = spark.createDataFrame(sent, SCHEMA).repartition(5)
        got = rebuild(df, ["key"], "pos", "op", ["a", "b"], changed="changed")
        assert rows(got) == sorted(brute(changes), key=repr)


def test_states_continue_and_late_changes_count_in_order(spark, rows):
    changes = generate(random.Random(9), 150)
    first, second = changes[::2], changes[1::2]
    states = None
    for part in (first, second, first):  # the third was applied before
        states = replay_changes(spark.createDataFrame(part, SCHEMA), ["key"], "pos", "op", ["a", "b"], changed="changed", states=states)
    assert rows(current_rows(states, ["key"], ["a", "b"])) == sorted(brute(changes), key=repr)


def test_spelling_unknown_operations_and_nulls(spark, rows):
    data = [("k", 1, " SET\t", "x"), ("k", 2, "add_node", "y"), ("k", None, "set", "z"), (None, 5, "set", "w"), ("d", 1, "Set", "v"), ("d", 2, "DELETE ", "marker"), ("e", 1, "set", ""), ("n", 1, None, "q")]
    df = spark.createDataFrame(data, "key string, pos bigint, op string, v string")
    assert rows(rebuild(df, ["key"], "pos", "op", ["v"])) == [("e", "", 1), ("k", "x", 1)]


def test_conflicting_copies_have_one_result(spark, rows):
    data = [("k", 3, "set", "b"), ("k", 3, "set", "c"), ("k", 3, "set", None), ("t", 1, "set", "a"), ("t", 1, "delete", None)]
    for n in (1, 3):
        df = spark.createDataFrame(data, "key string, pos bigint, op string, v string").repartition(n)
        assert rows(rebuild(df, ["key"], "pos", "op", ["v"])) == [("k", "c", 3)]


def test_update_of_a_missing_row(spark, rows):
    df = spark.createDataFrame([("k", 1, "update", "a"), ("d", 1, "insert", "a"), ("d", 2, "delete", None), ("d", 3, "update", "b")], "key string, pos bigint, op string, v string")
    states = replay_changes(df, ["key"], "pos", "op", ["v"])
    assert rows(current_rows(states, ["key"], ["v"])) == [("d", "b", 3), ("k", "a", 1)]
    assert rows(current_rows(states, ["key"], ["v"], create_on_update=False)) == []


def test_empty_clashing_names_and_long_values(spark, rows):
    schema = "`_k0` string, `_ins` bigint, op string, `_c0` string, `we ird` string, pos int"
    assert rows(rebuild(spark.createDataFrame([], schema), ["_k0"], "_ins", "op", ["_c0"])) == []
    long = "é" * 200_000
    df = spark.createDataFrame([("k", 1, "set", "x", "y", 7), ("k", 2, "set", long, "y", 7)], schema)
    assert rows(rebuild(df, ["_k0"], "_ins", "op", ["_c0"])) == [("k", long, 2)]


def test_hot_key_over_many_batches(spark, rows):
    n = 30_000
    df = spark.range(n).selectExpr("'hot' AS key", "id AS pos", "'set' AS op", "cast(id AS string) AS v").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert rows(rebuild(df, ["key"], "pos", "op", ["v"])) == [("hot", str(n - 1), n - 1)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
