"""Versioned JSON documents in any file system that Spark reaches, and files of lines."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from pipehat.runtime import hadoop_path


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Manifest:
    """A document with numbered versions below a folder.

    A version is written beside its place and renamed there, which fails if it exists; so readers see whole versions and of two
    writers one starts again. A pointer beside the versions tells a recent one, from which readers go on to the newest, so that
    reading doesn't list the folder. The last `kept` versions can be read; older ones go, some at a time (None: none go).
    """

    KEPT, STEP = 1024, 64

    def __init__(self, spark: SparkSession, folder: str, name: str = "manifest", kept: int | None = KEPT):
        self.spark, self.folder, self.name, self.kept = spark, folder.rstrip("/"), name, kept
        self.fs, path = hadoop_path(spark, self.folder)
        self.fs.mkdirs(path)

    def _file(self, version: int) -> str:
        return f"{self.folder}/{self.name}.{version:010d}.json"

    def _path(self, version: int):
        return hadoop_path(self.spark, self._file(version))[1]

    def versions(self) -> list[int]:
        """All that are kept, by a listing."""
        start = f"{self.name}."
        names = (s.getPath().getName() for s in self.fs.listStatus(hadoop_path(self.spark, self.folder)[1]))
        return sorted(int(n[len(start) : -5]) for n in names if n.startswith(start) and n.endswith(".json"))

    def newest(self) -> int:
        """The newest version, 0 before the first."""
        pointer = f"{self.folder}/{self.name}.latest"
        text = read_text(self.spark, pointer) if exists(self.spark, pointer) else ""
        version = int(text) if text.isdigit() else 0
        if not version or not self.fs.exists(self._path(version)):  # no pointer, or one caught half written
            version = max(self.versions(), default=0)
        while self.fs.exists(self._path(version + 1)):
            version += 1
        return version

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """(version, document); (0, {}) before the first."""
        version = self.newest() if version is None else version
        return (version, json.loads(read_text(self.spark, self._file(version)))) if version else (0, {})

    def drop(self, version: int) -> None:
        """Forget an old version."""
        self.fs.delete(self._path(version), False)

    def commit(self, base: int, document: dict) -> int:
        """Make the version after base."""
        version, draft = base + 1, f"{self.folder}/.{uuid.uuid4().hex}.tmp"
        write_text(self.spark, draft, json.dumps(document, sort_keys=True))
        if self.fs.exists(self._path(version)) or not self.fs.rename(hadoop_path(self.spark, draft)[1], self._path(version)):
            self.fs.delete(hadoop_path(self.spark, draft)[1], False)
            raise Conflict(f"version {version} exists")
        write_text(self.spark, f"{self.folder}/{self.name}.latest", str(version), overwrite=True)
        if self.kept is not None and version % self.STEP == 0:
            for old in range(max(1, version - self.kept - self.STEP), version - self.kept):
                self.fs.delete(self._path(old), False)
        return version


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, p = hadoop_path(spark, path)
    stream = fs.create(p, overwrite)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a text in a file's place in one step: readers see the old one or the new one, whole."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, draft, text)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop_path(spark, path)[0].getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(hadoop_path(spark, draft)[1], hadoop_path(spark, path)[1], options)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, 0 if there is none."""
    fs, p = hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path below, bytes) of all files, sorted."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    top, out, found = fs.getFileStatus(p).getPath().toUri().getPath(), [], fs.listFiles(p, True)
    while found.hasNext():
        s = found.next()
        out.append((s.getPath().toUri().getPath()[len(top) :].lstrip("/"), s.getLen()))
    return sorted(out)


def copy_all(spark: SparkSession, pairs: list[tuple[str, str]], at_once: int = 16) -> None:
    """Copy many files, some at once; their bytes go through the driver's file system clients, a buffer each."""
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(lambda p: copy(spark, *p), pairs))


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder within Spark's file systems."""
    (fs, a), (to, b) = hadoop_path(spark, source), hadoop_path(spark, target)
    to.mkdirs(b.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"can't copy {source}")
