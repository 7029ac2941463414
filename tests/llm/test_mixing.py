import math
from collections import Counter

from palimpsest.llm.mixing import draw, mixture_plan, shares

TARGETS = "mix_id int, source string, target_share double, max_repeats int, budget_ratio double"


def setup(spark, n=4000):
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN ' Small' WHEN id % 10 = 1 THEN NULL ELSE 'BIG\t' END AS source", "100 + id % 7 AS size", "'x' AS rate", "'y' AS _source")
    targets = spark.createDataFrame([(1, "big", 0.4, 1, 1.0), (1, "small", 0.25, 3, 1.0), (1, "gone", 0.1, 2, 1.0), (2, "small", 0.5, 2, 1.0), (2, None, 0.1, 1, 1.0), (3, "big", 1.0, 5, 2.5)], TARGETS)
    return docs, targets


def test_rates_shortages_and_caps(spark):
    docs, targets = setup(spark)
    plan = {(r["mix_id"], r["source"]): r for r in mixture_plan(docs, targets).collect()}
    total = sum(100 + i % 7 for i in range(4000))
    small = sum(100 + i % 7 for i in range(0, 4000, 10))
    assert math.isclose(plan[1, "small"]["rate"], 0.25 * total / small) and not plan[1, "small"]["short"]
    assert plan[2, "small"]["rate"] == 2.0 and plan[2, "small"]["short"]
    assert plan[1, "gone"]["rate"] == 0.0 and plan[1, "gone"]["short"] and plan[2, None]["short"]


def test_copies_are_floor_or_one_more_and_shares_come_out(spark):
    docs, targets = setup(spark)
    plan = mixture_plan(docs, targets)
    drawn = draw(docs, plan, ["doc_id"])
    rate = {(r["mix_id"], r["source"]): r["rate"] for r in plan.collect()}
    copies = Counter((r["mix_id"], r["source"], r["doc_id"]) for r in drawn.collect())
    for (mix, source, _), n in copies.items():
        assert n in (math.floor(rate[mix, source]), math.floor(rate[mix, source]) + 1) and n <= 5
    got = {(r["mix_id"], r["source"]): r for r in shares(plan, drawn).collect()}
    assert abs(got[1, "big"]["share_of_budget"] - 0.4) < 0.02 and abs(got[1, "small"]["share_of_budget"] - 0.25) < 0.02
    assert got[2, "small"]["most_repeats"] == 2 and got[1, "gone"]["copies"] == 0
    again = Counter((r["mix_id"], r["source"], r["doc_id"]) for r in draw(docs.repartition(7), plan, ["doc_id"]).collect())
    assert copies == again
    assert copies != Counter((r["mix_id"], r["source"], r["doc_id"]) for r in draw(docs, plan, ["doc_id"], seed=7).collect())


def test_empty_tables_null_sizes_and_repeated_rows(spark):
    docs, targets = setup(spark)
    none = mixture_plan(docs.limit(0), targets)
    assert not any(r["short"] for r in none.collect()) and draw(docs.limit(0), none, ["doc_id"]).count() == 0
    assert mixture_plan(docs, targets.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, "big", None), (None, "big", 50), (2, "big", 50), (2, "big", 50)], "doc_id bigint, source string, size int")
    plan = mixture_plan(nulls, spark.createDataFrame([(1, "big", 1.0, 3, 2.0)], TARGETS))
    assert plan.first()["rate"] == 2.0
    assert draw(nulls, plan, ["doc_id"]).count() == 8 and sum(r["size"] for r in draw(nulls, plan, ["doc_id"]).collect()) == 300
