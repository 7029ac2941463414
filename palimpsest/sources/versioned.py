"""A table of immutable folders whose versions are published atomically.

``<path>/data/<id>`` holds Parquet, written once. ``<path>/versions/<n>.json`` names
the folders of version ``n`` under a checksum. A version appears by a rename that
fails if its name is taken, so a reader sees a whole version or none, a lost job
leaves only folders that no version names, and of two writers one gets
:class:`Conflict`. File systems whose rename is neither atomic nor exclusive
(plain object stores) need a lock around :meth:`VersionedTable.publish`.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published this version first."""


class CorruptManifest(ValueError):
    """A version file can't be read; nothing is deleted because of it."""


def _canonical(content: dict) -> bytes:
    return json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def applied(mark: dict, batch: int) -> bool:
    """Whether ``batch``, numbered from 0, is among those that ``mark`` remembers."""
    return batch <= mark.get("upto", -1) or batch in mark.get("beyond", ())


def with_applied(mark: dict, batch: int) -> dict:
    """``mark`` with ``batch``: the number up to which all were applied, and those beyond it, so that batches in order need no list."""
    if batch < 0:
        raise ValueError("batches are numbered from 0")
    upto, beyond = mark.get("upto", -1), {*mark.get("beyond", ()), batch}
    while upto + 1 in beyond:
        upto += 1
    return {"upto": upto, "beyond": sorted(b for b in beyond if b > upto)}


class Files:
    """The few file operations that are needed, through Hadoop, on any file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, content: bytes) -> None:
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def rename_new(self, source: str, target: str) -> bool:
        """Rename, unless ``target`` exists."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(source), self._path(target), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def size(self, path: str) -> int:
        p = self._path(path)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The highest version; 0 before the first."""
        return max(self.versions(), default=0)

    def content(self, version: int | None = None) -> dict:
        """What ``version`` (else the latest) was published with; ``{}`` for version 0."""
        version = self.latest() if version is None else version
        if version == 0:
            return {}
        raw = self.files.read(f"{self.path}/versions/{version:012d}.json")
        try:
            whole = json.loads(raw)
            content, crc = whole["content"], whole["crc"]
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptManifest(f"version {version} of {self.path} can't be parsed") from e
        if zlib.crc32(_canonical(content)) != crc:
            raise CorruptManifest(f"version {version} of {self.path} has a wrong checksum")
        return content

    def publish(self, content: dict, after: int) -> int:
        """Make ``content`` version ``after`` + 1, if that doesn't exist yet."""
        version = after + 1
        target = f"{self.path}/versions/{version:012d}.json"
        part = f"{self.path}/pending/{uuid.uuid4().hex}"
        self.files.write(part, json.dumps({"content": content, "crc": zlib.crc32(_canonical(content))}, ensure_ascii=False).encode())
        # Hadoop renames only into folders that exist.
        self.files._fs.mkdirs(self.files._path(f"{self.path}/versions"))
        if not self.files.rename_new(part, target):
            self.files.delete(part)
            raise Conflict(f"version {version} of {self.path} exists")
        return version

    def new_folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, partition_by: Iterable[str] = (), **options: str) -> str:
        """Write ``df`` into a new folder and return its name; no version names it yet."""
        folder = self.new_folder()
        df.write.options(**options).partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        return folder

    def read(self, folders: Iterable[str], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        if not paths:
            # The optimizer drops what is never true, a union with it too.
            return self.spark.createDataFrame([], schema).where("false")
        return self.spark.read.schema(schema).parquet(*paths)

    def vacuum(self, named: Iterable[str], keep_versions: int = 1) -> list[str]:
        """Delete the data that is not in ``named`` (folders, or parts of folders), and all version files but the last ``keep_versions`` (0 keeps all); call it when no reader holds them."""
        parts: dict[str, set[str]] = {}
        for f in named:
            _, folder, *part = f.split("/", 2)
            parts.setdefault(folder, set()).update(part)
        gone = [n for n in self.files.names(f"{self.path}/data") if n not in parts]
        for folder, kept in parts.items():
            if kept:
                gone += [f"{folder}/{n}" for n in self.files.names(f"{self.path}/data/{folder}") if "=" in n and n not in kept]
        for n in gone:
            self.files.delete(f"{self.path}/data/{n}")
        for v in self.versions()[:-keep_versions] if keep_versions else []:
            self.files.delete(f"{self.path}/versions/{v:012d}.json")
        return gone

    def missing(self, named: Iterable[str]) -> list[str]:
        """Those of ``named`` that aren't there."""
        return sorted(f for f in named if not self.files.exists(f"{self.path}/{f}"))
