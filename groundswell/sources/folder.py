"""Small text files of the driver beside a table: ledgers and manifests."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Folder:
    """A folder on any file system that Spark knows; its files are written once and never change.

    `create` relies on the file system's create-if-absent; where there is none (an object store), there must be one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = path.rstrip("/")
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._bytes = jvm.org.apache.commons.io.IOUtils.toByteArray

    def names(self, prefix: str = "") -> list[str]:
        where = self._path(self.path)
        if not self._fs.exists(where):
            return []
        return sorted(n for s in self._fs.listStatus(where) if (n := s.getPath().getName()).startswith(prefix))

    def create(self, name: str, text: str = "") -> bool:
        """False if the file is there already."""
        where = self._path(f"{self.path}/{name}")
        if self._fs.exists(where):
            return False
        try:
            out = self._fs.create(where, False)
        except Exception as e:  # lost the race
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str, last: str = "", patience_s: float = 10.0) -> str:
        """A file's text; one that does not end in `last` is just being written and waited for."""
        until = time.monotonic() + patience_s
        while True:
            stream = self._fs.open(self._path(f"{self.path}/{name}"))
            try:
                text = bytes(self._bytes(stream)).decode()
            finally:
                stream.close()
            if text.endswith(last):
                return text
            if time.monotonic() > until:
                raise RuntimeError(f"{self.path}/{name} was never finished; remove it if its writer is gone")
            time.sleep(0.1)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))
