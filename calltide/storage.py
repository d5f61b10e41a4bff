"""Small files in the shared store, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Lists, reads, writes and removes paths of any store that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(path))

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one of that name already."""
        if self._fs.exists(self._path(name)):
            return False
        try:
            out = self._fs.create(self._path(name), False)
        except Exception:  # another writer was faster
            if self._fs.exists(self._path(name)):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
