from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.packing import OpenBins, fill, pack


def best_fit(capacity, limit, sizes):
    """Best fit by looking through all open bins."""
    bins, closed, out, n = {}, 0, [], 0
    for size in sizes:
        fitting = [(left, -i, i) for i, left in bins.items() if left >= size]
        if fitting:
            left, _, i = min(fitting)
            del bins[i]
        else:
            left, i, n = capacity, n, n + 1
        if left > size:
            bins[i] = left - size
            if len(bins) > limit:
                del bins[min(bins, key=lambda b: bins[b])]
        out.append((size, left))
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 50), st.integers(1, 6), st.lists(st.integers(0, 50), max_size=80))
def test_the_tightest_bin_is_taken_and_the_fullest_closed(capacity, limit, sizes):
    sizes = [s for s in sizes if s <= capacity]
    packer, used, got = OpenBins(capacity, 0, limit), defaultdict(int), []
    for s in sizes:
        c = packer.place(s)
        got.append((s, capacity - used[c]))
        used[c] += s
        assert used[c] <= capacity and packer.open <= limit
    # Which of two bins with equal space is taken makes no difference to any later choice.
    assert got == best_fit(capacity, limit, sizes)


def test_every_item_is_whole_unless_it_is_above_the_capacity(spark):
    sizes = [0, 1, 5, 7, 10, 11, 25, 30, 3, 3, 3, 9, None, -4]
    df = spark.createDataFrame([(i if i != 3 else None, s, "clash") for i, s in enumerate(sizes)], "id int, size int, task string").repartition(3)
    got = pack(df, "id", "size", [(1, 10), (2, 1)]).collect()
    for spec, capacity in ((1, 10), (2, 1)):
        pieces, containers = defaultdict(list), defaultdict(int)
        for r in got:
            if r["spec_id"] == spec:
                pieces[r["item_id"]].append((r["piece_no"], r["piece_size"]))
                containers[r["container_id"]] += r["piece_size"]
        assert len(pieces) == len(sizes) and max(containers.values()) <= capacity
        for i, s in enumerate(sizes):
            found = sorted(pieces[i if i != 3 else None])
            size = max(s or 0, 0)
            assert [n for n, _ in found] == list(range(max(1, -(-size // capacity)))) and sum(x for _, x in found) == size


def test_fill_figures_and_runs_are_alike(spark):
    df = spark.range(2000).selectExpr("id", "(id * 7919) % 900 + 1 AS size").repartition(4, "id")
    placed = [sorted(map(tuple, pack(df, "id", "size", [(1, 1000)]).collect())) for _ in range(2)]
    assert placed[0] == placed[1]
    row = fill(pack(df, "id", "size", [(1, 1000)])).first()
    assert row["items"] == 2000 and row["split_items"] == 0 and row["fullest"] <= 1000
    assert row["size"] == sum((i * 7919) % 900 + 1 for i in range(2000))
    assert row["containers"] >= row["least_containers"] and row["fill_ratio"] > 0.9


def test_nothing_to_pack_and_bad_capacity(spark):
    df = spark.createDataFrame([], "id bigint, size bigint")
    assert pack(df, "id", "size", [(1, 10)]).count() == 0 and fill(pack(df, "id", "size", [(1, 10)])).count() == 0
    assert pack(spark.range(3).selectExpr("id", "id AS size"), "id", "size", []).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "size", [(1, 0)])
