"""Tables that are replaced as a whole, of which readers always see one complete version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """Versions of a table below ``path``, each a folder of Parquet files.

    A version counts once its pointer, a small file that holds the folder's name, is there; the pointer is
    written last and never changed, so a job that dies leaves the version before it in place. The
    ``keep`` newest versions stay, so readers that began before a change can end. One writer at a time:
    a second one that writes the same version fails on the pointer.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Numbers of the versions that are complete, in order."""
        if not self._fs.exists(self._path("_versions")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path("_versions")))

    def _folder(self, version: int) -> str:
        source = self._fs.open(self._path(f"_versions/{version:012d}"))
        try:
            return source.readUTF()
        finally:
            source.close()

    def current(self) -> DataFrame | None:
        """The newest complete version; None before the first."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/{self._folder(found[-1])}") if found else None

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next version, or the given one, and let go of the oldest. A version that is there already stays as it is."""
        found = self.versions()
        number = (found[-1] + 1 if found else 0) if version is None else version
        if number in found:
            return number
        folder = f"data-{number:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        pointer = self._fs.create(self._path(f"_versions/{number:012d}"), False)
        try:
            pointer.writeUTF(folder)
        finally:
            pointer.close()
        for old in self.versions()[: -self.keep]:
            gone = self._folder(old)
            self._fs.delete(self._path(f"_versions/{old:012d}"), False)
            self._fs.delete(self._path(gone), True)
        return number
