"""Small files in any file system that Spark can reach, written and read by the driver without a job."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def put(self, name: str, text: str, overwrite: bool = False) -> None:
        """Writes a file; it is there once this returns. Without `overwrite`, one that exists is an error."""
        out = self._fs.create(self._path(f"{self.folder}/{name}"), overwrite)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def get(self, name: str) -> str | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def names(self, below: str = "") -> list[str]:
        path = self._path(f"{self.folder}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)
