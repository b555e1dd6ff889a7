"""Listing, renaming and deleting below a folder of whatever file system the session uses."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


class Folder:
    """Listing, renaming and deleting below one folder, on whatever file system it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def entries(self, *parts: str) -> dict[str, int]:
        """Names and sizes; an empty dict where there is no such folder."""
        at = self._at(*parts)
        if not self._fs.exists(at):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(at)}

    def data_files(self, *parts: str) -> dict[str, int]:
        return {n: size for n, size in self.entries(*parts).items() if not n.startswith(("_", "."))}

    def stamp(self, *parts: str) -> str:
        """A text that changes when a data file of the folder is added, removed or written anew."""
        listed = self._fs.listStatus(self._at(*parts))
        files = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in listed]
        held = sorted(f for f in files if not f[0].startswith(("_", ".")))
        return hashlib.sha256(repr(held).encode()).hexdigest() if held else ""

    def days(self) -> list[str]:
        return sorted(n for n in self.entries() if n.startswith("day="))

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._at(*parts), True)

    def move(self, source: list[str], target: list[str]) -> None:
        self._fs.mkdirs(self._at(*target).getParent())
        self._fs.rename(self._at(*source), self._at(*target))

    def mark(self, *parts: str) -> None:
        self._fs.createNewFile(self._at(*parts))
