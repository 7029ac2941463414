"""What the plans must look like to hold at any size."""

import re

import pytest

from palimpsest.operators import mvcc
from palimpsest.plans import catalogue
from palimpsest.session import scratch_path
from palimpsest.store import Store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_cross_join_and_no_global_window(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow\b", line):
            below = next((x for x in lines[i + 1 :] if "Exchange" in x), "")
            assert "SinglePartition" not in below, text


def test_filters_and_columns_reach_the_scan(spark):
    with Store(spark, scratch_path(spark, "store")) as s:
        s.set("a", "1")
        s.set("b", "2")
        s.flush()
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        try:
            text = plan(s.scan("a", "b", at=1).select("key"))
        finally:
            spark.conf.unset("spark.sql.maxMetadataStringLength")
        pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: (\S+)", text)
        assert len(pushed) == 1
        for f in ("GreaterThanOrEqual(key,a)", "LessThanOrEqual(key,b)", "LessThanOrEqual(seq,1)"):
            assert f in pushed[0][0]
        assert "crc" not in pushed[0][1]


def test_a_hot_key_is_aggregated_before_the_shuffle(spark):
    cells = spark.createDataFrame([("k", 1, "v", False)], "key string, seq bigint, value string, is_tombstone boolean")
    text = plan(mvcc.live(cells))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_max" in text


def test_a_small_read_skips_files(spark):
    with Store(spark, scratch_path(spark, "store")) as s:
        for k in "az":
            s.set(k, "1")
            s.flush()
        names = {f["folder"] for f in s.state["files"] if f["min_key"] <= "a" <= f["max_key"]}
        read = {p.split("/data/")[1].split("/")[0] for p in s.cells("a", "a").inputFiles()}
        assert read == {n.split("/")[1] for n in names}
