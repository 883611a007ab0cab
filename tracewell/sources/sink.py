"""A table that streams write: one folder a batch, and a marker that commits it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchTable:
    """Rows by the number of the batch that wrote them.

    A batch replaces its own folder and is committed by a marker that is made last. One that is killed leaves
    no marker, so nobody reads what it left; run again, it replaces it; run once more after its
    commit, it does nothing. So each batch counts once, and the table is a fold over committed batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def committed(self) -> list[int]:
        """The numbers of all committed batches; one small file each."""
        fs, target = self._fs(f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(target)) if fs.exists(target) else []

    def write(self, rows: DataFrame, batch: int, before_commit: Callable[[], None] | None = None) -> bool:
        """Write a batch, unless it is committed; whether it was written. ``before_commit`` is for tests."""
        fs, mark = self._fs(f"{self.path}/commits/{batch}")
        if fs.exists(mark):
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        if before_commit:
            before_commit()
        fs.create(mark, True).close()
        return True

    def read(self) -> DataFrame:
        """All committed rows with ``batch``."""
        found = self.committed()
        if not found:
            return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))
        paths = [f"{self.path}/rows/batch={b}" for b in found]
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*paths)
        return rows.withColumn("batch", F.col("batch").cast("long"))
