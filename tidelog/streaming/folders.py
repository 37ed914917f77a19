"""Working folders that the driver and all executors see, by Spark's own file system access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A path on any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def fresh(spark: SparkSession, stem: str) -> Folder:
        """A new folder below spark.checkpoint.dir; a temporary one only where the master is local."""
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder, and executors share no temporary one")
        return Folder(spark, f"{shared}/{stem}-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix=stem)}")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(self.at(name)))

    def names(self, below: str) -> list[str]:
        if not self.exists(below):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.at(below))))

    def aged(self) -> None:
        """Makes the folder's part files a second younger each, by name, up to the youngest's age."""
        parts = [s for s in self._fs.listStatus(self._hadoop(self.path)) if s.getPath().getName().startswith("part-")]
        parts.sort(key=lambda s: s.getPath().getName())
        last = max((s.getModificationTime() for s in parts), default=0)
        for k, s in enumerate(parts):
            self._fs.setTimes(s.getPath(), last - 1000 * (len(parts) - 1 - k), -1)

    def delete(self, name: str) -> None:
        self._fs.delete(self._hadoop(self.at(name)), True)
