"""The session, its shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_SCOPES: list[list[str]] = []


def local_session(app: str = "palimpsest", cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests, the bench and the command line; a cluster brings its own."""
    parts = "8" if cpus == "*" else cpus
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (a local test) a temporary folder is made for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="palimpsest-")
    _OWN.append(made)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


@atexit.register
def _remove_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def _scratch(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's."""
    return f"{shared_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`written` and :func:`scratch_path` made inside, for instance all that one query wrote, once its result is safe."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; other applications' files stay. Call it when no DataFrame of it is in use."""
    _delete(spark, _scratch(spark))
