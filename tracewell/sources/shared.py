"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tracewell-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: its plan is cut, and a lost executor costs the running stage alone."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written through it go when its block ends; what is lazily made of them has to be written before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


#: Rows that a task takes at most, about, where its memory grows with them.
TASK_ROWS = 500_000


def parts_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """The partitions that ``rows`` rows are dealt to: a shuffle's usual number, or more where tasks would grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def numbered(rows: DataFrame, order: list[str], column: str = "n", first: int = 1, written=written) -> DataFrame:
    """``rows`` with ``column``, their places in ``order`` from ``first`` on. Rows are range-sorted and each
    task's share is counted, so that no task ever holds more than its share."""
    rows = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_c"))  # one row a task
    parts = parts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = rows.withColumn("_own", own).join(F.broadcast(parts), "_part")
    return rows.withColumn(column, (F.col("_own") + F.col("_before") + (first - 1)).cast("long")).drop("_part", "_own", "_before")
