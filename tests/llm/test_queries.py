"""Every registered query of the package against its SQL, or against the texts where there is none."""

import pytest

from palimpsest.llm.queries import QUERIES, SQL
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    compare(QUERIES[name](spark, SF), con, SQL[name])


def test_what_has_no_sql_agrees(spark, con):
    """The judgements against the texts, and the queries made of them against the judgements."""
    assert QUERIES.keys() - SQL.keys() == {"p8_found", "p8_judged", "p8_rates"}
    judged = QUERIES["p8_judged"](spark, SF).collect()
    texts = {i: (len(t), len(t.encode())) for i, t in con.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()}
    assert {r["doc_id"]: (r["chars"], r["bytes"]) for r in judged} == texts
    assert all(0 <= r["posterior"] <= 1 and r["is_cut"] == (r["posterior"] > 0.5) for r in judged)
    cut = {r["doc_id"] for r in judged if r["is_cut"]}
    assert cut and {r["doc_id"] for r in QUERIES["p8_found"](spark, SF).collect()} == cut
    rates = QUERIES["p8_rates"](spark, SF).collect()
    assert sum(r["documents"] for r in rates) == len(judged) and sum(r["cut"] for r in rates) == len(cut)
    for r in rates:
        here = [j for j in judged if j["source"] == r["source"]]
        assert r["documents"] == len(here) and abs(r["cut_rate"] - sum(j["is_cut"] for j in here) / len(here)) < 1e-9


def test_the_core_does_not_import_the_package():
    import pathlib
    import re

    import palimpsest

    root = pathlib.Path(palimpsest.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"palimpsest\.llm|from \.+llm", p.read_text()), p
