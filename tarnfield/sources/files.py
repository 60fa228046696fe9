"""Files through Hadoop's file system API, so that any store Spark reaches will do."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str, stale: float = 60.0) -> bool:
        """Write a file that must not be there yet: False if another writer was first. The right to write is a lock file,
        which a writer that died loses after `stale` seconds; the content appears by a rename, whole."""
        path = self._path(name)
        self._fs.mkdirs(path.getParent())
        own = self._path(f"{name}.{id(self):x}.tmp")
        stream = self._fs.create(own, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            lock = self._path(f"{name}.lock")
            made = self._fs.createNewFile(lock)
            if not made and not self._fs.exists(path) and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > stale:
                self._fs.delete(lock, False)
                made = self._fs.createNewFile(lock)
            return bool(made and not self._fs.exists(path) and self._fs.rename(own, path))
        finally:
            self._fs.delete(own, False)

    def replace(self, name: str, text: str) -> None:
        """Write a small file, in an older one's place if there is one."""
        self._fs.mkdirs(self._path(name).getParent())
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> bool:
        self._fs.mkdirs(self._path(new).getParent())
        return self._fs.rename(self._path(old), self._path(new))
