"""Every registered query of the core against its SQL in another engine."""

import pytest

from palimpsest.plans import catalogue
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    compare(catalogue.QUERIES[name](spark, SF), con, catalogue.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["get_point", "get_at", "scan_range"])
def test_point_reads_find_something_at_every_size(spark, name, sf):
    assert catalogue.QUERIES[name](spark, f"/root/testdata/{sf}").count() > 0


def test_an_error_inside_the_subpackage_is_not_taken_for_its_absence(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "palimpsest", tmp_path / "palimpsest")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    (tmp_path / "palimpsest" / "llm").mkdir(exist_ok=True)
    (tmp_path / "palimpsest" / "llm" / "__init__.py").write_text("")
    (tmp_path / "palimpsest" / "llm" / "queries.py").write_text("import a_module_that_is_missing")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode != 0
    shutil.rmtree(tmp_path / "palimpsest" / "llm")
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert found.stdout.strip() == str(len(catalogue.QUERIES))
