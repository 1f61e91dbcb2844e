"""Small files in a folder of any store that Spark reaches, through the session's own Hadoop file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """One folder; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        """Sorted names in the folder; none where it does not exist."""
        path, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def exists(self, name: str = "") -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> str:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def start(self, name: str, most: int) -> str:
        """The first bytes of a file, as far as they are text."""
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(stream.readNBytes(most)).decode(errors="ignore")
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = False) -> bool:
        """Write a file that readers see whole or not at all. Without `replace` the first writer of a name wins; False for the others."""
        path, fs = self._at(name)
        made, _ = self._at(f".{uuid.uuid4().hex}.tmp")
        stream = fs.create(made)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if replace or not fs.exists(path):
            if replace:
                fs.delete(path, False)
            fs.mkdirs(path.getParent())
            if fs.rename(made, path):
                return True
        fs.delete(made, False)
        return False

    def join(self, parts: list[str], name: str, head: str, tail: str, skip: int = 0) -> None:
        """One file of the parts in order, without the first `skip` bytes of all, put in place of `name` once it is whole."""
        path, fs = self._at(name)
        made, _ = self._at(f".{uuid.uuid4().hex}.tmp")
        out = fs.create(made)
        try:
            out.write(head.encode())
            for part in parts:
                stream = fs.open(self._at(part)[0])
                try:
                    skip -= stream.skip(skip) if skip else 0
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                finally:
                    stream.close()
            out.write(tail.encode())
        finally:
            out.close()
        fs.delete(path, True)
        fs.rename(made, path)

    def rename(self, old: str, new: str) -> bool:
        (a, fs), (b, _) = self._at(old), self._at(new)
        return fs.rename(a, b)

    def remove(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)
