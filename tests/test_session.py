import subprocess
import sys

import pytest
from pyspark import cloudpickle

from palimpsest import session
from palimpsest.operators.changefeed import _replay_sorted


def test_functions_run_where_the_package_is_not_installed(tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(_replay_sorted(["_k0"], 1)))
    code = "import sys; sys.path = [p for p in sys.path if 'repo' not in p]; from pyspark import cloudpickle; f = cloudpickle.loads(open('f', 'rb').read()); assert list(f(iter([]))) == []; assert 'palimpsest' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_the_shared_folder_is_the_sessions(spark):
    assert session.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = session.written(spark.range(3), "x")
    assert df.count() == 3 and df.inputFiles()[0].startswith(session.shared_dir(spark))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_a_scope_deletes_what_was_written_in_it_and_nothing_else(spark):
    kept = session.written(spark.range(3), "kept")
    with session.scratch_scope(spark):
        df = session.written(spark.range(3), "x")
        assert df.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        df.count()
    assert kept.count() == 3
    other = f"{session.shared_dir(spark)}/palimpsest/another-application/x"
    spark.range(1).write.parquet(other)
    session.clear_scratch(spark)
    assert spark.read.parquet(other).count() == 1
