"""Small files and folders on whatever file system a path names, through Hadoop's client.

For metadata only (manifests, listings, deletes): data goes through Spark's readers and writers.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, ascending; none if it does not exist."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def file_states(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of each file."""
    out = []
    for path in sorted(paths):
        fs, at = _at(spark, path)
        s = fs.getFileStatus(at)
        out.append((path, s.getLen(), s.getModificationTime()))
    return out


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8", most: int = 1 << 16) -> str:
    """The first line of a file, compressed or not, of which ``most`` bytes are read."""
    jvm = spark._jvm
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(at)
        plain = stream if codec is None else codec.createInputStream(stream)
        head = jvm.org.apache.commons.io.input.BoundedInputStream(plain, most)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(head, encoding)).readLine() or ""
    finally:
        stream.close()


def files_in(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, of a pattern, or the file itself; as readers do, names with ``_`` or ``.`` in front are passed over."""
    fs, at = _at(spark, path)
    out = []
    for found in fs.globStatus(at) or []:
        under = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
        out += [s.getPath().toString() for s in under if s.isFile() and s.getPath().getName()[0] not in "_."]
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole under its name, by a rename, or not at all."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    _, draft = _at(spark, f"{at.getParent().toString()}/.draft-{at.getName()}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(draft, at):
        raise OSError(f"{path} stands already")


class Manifest:
    """Versions of a small JSON state in a folder; the highest number is in force.

    A reader holds what it has read: what a version names is deleted only after a later version
    has been committed (see ``keep``). One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder, keep

    def _versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, self.folder) if n.endswith(".json") and not n.startswith(".")]

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def read(self) -> dict | None:
        found = self._versions()
        return json.loads(read_text(self.spark, self._path(found[-1]))) if found else None

    def commit(self, state: dict) -> None:
        found = self._versions()
        write_text(self.spark, self._path(found[-1] + 1 if found else 1), json.dumps(state))
        for old in found[: max(0, len(found) + 1 - self.keep)]:
            delete(self.spark, self._path(old))
