"""The store: one parquet table per layer under a root path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

KINDS = {"turns": schemas.TURNS, "fragments": schemas.FRAGMENTS, "vectors": schemas.VECTORS, "daily": schemas.DAILY, "topic_entries": schemas.TOPIC_ENTRIES}
PARTITIONED = {"turns": "date", "fragments": "date"}


class Store:
    """Reads and writes tables by Hadoop paths, so any file system that Spark reads will do. A table that is replaced is
    written to a new folder first and then swapped in by its pointer, so readers see the old or the new rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> str | None:
        """The folder that the newest pointer names."""
        pattern = self._fs.globStatus(self._path(f"{self.root}/{name}/_at-*"))
        found = sorted(str(s.getPath().getName()) for s in pattern or [])
        return f"{self.root}/{name}/{found[-1].split('-', 2)[2]}" if found else None

    def has(self, folder: str, form: str) -> bool:
        """Whether a folder holds files whose path under it matches the glob."""
        path = self._path(f"{folder}/{form}")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path))

    def read(self, name: str) -> DataFrame:
        folder = self._folder(name)
        if folder is None:
            return self.spark.createDataFrame([], KINDS[name])
        return self.spark.read.schema(KINDS[name]).parquet(folder)

    def append(self, name: str, rows: DataFrame) -> None:
        folder = self._folder(name)
        if folder is None:
            return self.replace(name, rows)
        self._write(name, rows, folder)

    def replace(self, name: str, rows: DataFrame) -> None:
        old = self.spark.sparkContext._jvm.System.currentTimeMillis()
        folder = f"v{uuid.uuid4().hex}"
        self._write(name, rows, f"{self.root}/{name}/{folder}")
        self._fs.create(self._path(f"{self.root}/{name}/_at-{old:015d}-{folder}")).close()

    def _write(self, name: str, rows: DataFrame, folder: str) -> None:
        fields = [x.split()[0] for x in KINDS[name].split(", ")]
        out = rows.select(*fields).write.mode("append")
        (out.partitionBy(PARTITIONED[name]) if name in PARTITIONED else out).parquet(folder)
