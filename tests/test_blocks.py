import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import blocks
from palimpsest.operators.blocks import CloseAfter, OpenBefore, _composed, _ends, _through, _transfer, greedy_groups, next_in_key, with_position, with_running_sum


def one_by_one(rule, sizes):
    out, group, size = [], 0, 0
    for w in sizes:
        if isinstance(rule, CloseAfter):
            out.append(group)
            size += w
            if size >= rule.limit:
                group, size = group + 1, 0
        else:
            if size > 0 and size + w > rule.limit:
                group, size = group + 1, 0
            size += w
            out.append(group)
    return out


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([CloseAfter, OpenBefore]), st.integers(1, 40), st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=20), min_size=1, max_size=5))
def test_blocks_chain_to_the_sequential_fold(kind, limit, parts):
    rule, open_size, groups, got = kind(limit), 0, 0, []
    for b in parts:
        cum = np.cumsum(b)
        ends = _ends(rule, cum, open_size)
        got += (groups + np.searchsorted(np.array(ends, dtype=np.int64), np.arange(len(b)), side="right")).tolist()
        out, ended, _ = _through(_transfer(rule, cum), np.array([open_size]))
        assert ended[0] == len(ends)
        open_size, groups = int(out[0]), groups + int(ended[0])
    assert got == one_by_one(rule, [w for b in parts for w in b])


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([CloseAfter, OpenBefore]), st.integers(1, 60), st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=5))
def test_tables_compose_to_going_through_one_after_the_other(kind, limit, parts):
    rule = kind(limit)
    tables = [_transfer(rule, np.cumsum(b)) for b in parts]
    whole = tables[0]
    for t in tables[1:]:
        whole = _composed(whole, t)
    sizes, ended = np.arange(limit + 5), np.zeros(limit + 5, dtype=np.int64)
    out = sizes
    for t in tables:
        out, more, _ = _through(t, out)
        ended = ended + more
    got, groups, _ = _through(whole, sizes)
    assert got.tolist() == out.tolist() and groups.tolist() == ended.tolist()


@pytest.mark.parametrize("fan", [64, 2])
def test_greedy_groups_over_partitions(spark, monkeypatch, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(blocks, "block_count", lambda df: 9)
    rng = random.Random(0)
    sizes = [rng.randint(1, 50) for _ in range(700)]
    df = spark.createDataFrame([(i, s, f"row {i}") for i, s in enumerate(sizes)], "i bigint, size int, other string").repartition(5)
    for rule in (CloseAfter(100), OpenBefore(100), CloseAfter(5000)):
        got = greedy_groups(df, ["i"], "size", rule, "g").orderBy("i").collect()
        assert [r["g"] for r in got] == one_by_one(rule, sizes) and [r["other"] for r in got] == [f"row {i}" for i in range(700)]
        if isinstance(rule, CloseAfter):
            assert [r["_sealed"] for r in got] == [g < one_by_one(rule, sizes + [10_000])[-1] for g in one_by_one(rule, sizes)]
    assert greedy_groups(df.limit(0), ["i"], "size", CloseAfter(3), "g").collect() == []
    odd = spark.createDataFrame([(1, None, "a"), (2, -5, "b"), (3, 3, "c"), (4, 1, "d")], df.schema)
    assert [r["g"] for r in greedy_groups(odd, ["i"], "size", CloseAfter(3), "g").orderBy("i").collect()] == [0, 0, 0, 1]


def test_positions_and_running_sums(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", None, "é", "", "a"]], "k string").repartition(3)
    assert [(r["k"], r["pos"]) for r in with_position(df, ["k"]).orderBy("pos").collect()] == [(None, 1), ("", 2), ("a", 3), ("a", 4), ("b", 5), ("é", 6)]
    sums = with_running_sum(spark.range(100).withColumnRenamed("id", "n"), ["n"], "n", "s").orderBy("n").collect()
    assert [r["s"] for r in sums] == [n * (n + 1) // 2 for n in range(100)]


def test_next_in_key_across_stretches(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "x", None]), n) for n in rng.sample(range(1000), 200)]
    by = {}
    for k, n in sorted(data, key=lambda r: r[1]):
        by.setdefault(k, []).append(n)
    after = {(k, a): b for k, ns in by.items() if k is not None for a, b in zip(ns, ns[1:], strict=False)}
    df = spark.createDataFrame(data, "k string, n bigint").where("k IS NOT NULL")
    got = next_in_key(df, ["k"], "n", "next", width=37).collect()
    assert {(r["k"], r["n"]): r["next"] for r in got} == {(k, n): after.get((k, n)) for k, n in data if k is not None}
    before = next_in_key(df, ["k"], "n", "last", width=37, previous=True).collect()
    assert {(r["k"], r["last"]): r["n"] for r in before if r["last"] is not None} == after
