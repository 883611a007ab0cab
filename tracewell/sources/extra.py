"""Other sources and sinks: graph files, session files, vectors for tests, metrics, dumps."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.tables import LINKS, NODES

VECTOR_DIM = 1024


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a graph file; a file that can't be read gives empty tables."""
    if not _exists(spark, path):
        return spark.createDataFrame([], NODES), spark.createDataFrame([], LINKS)
    raw = spark.read.schema(f"nodes array<struct<{_struct(NODES)}>>, links array<struct<{_struct(LINKS)}>>").option("mode", "PERMISSIVE").json(path, multiLine=True)
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("links").alias("l")).select("l.*")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system that Spark would use has something at ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def _struct(shape: str) -> str:
    return ", ".join(f"`{a}`: {b}" for a, b in (x.strip().split(" ", 1) for x in shape.replace("map<string,string>", "map<string;string>").split(","))).replace(";", ",")


def write_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and links as line-delimited JSON in two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")


def recent_sessions(spark: SparkSession, folder: str, n: int = 3, shared: str = "topics") -> DataFrame:
    """The ``n`` session files that changed last, without the shared store: ``path, changed_at``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("changed_at"))
    return files.where(~F.contains(F.regexp_extract("path", "([^/]+)$", 1), F.lit(shared))).orderBy(F.col("changed_at").desc(), "path").limit(n)


def seeded_vector(text: str | None, dim: int = VECTOR_DIM) -> list[float]:
    """A vector that depends on the text alone, uniform in [-1, 1]: a stand-in where there is no model."""
    seed = int.from_bytes(hashlib.md5((text or "fallback_zero").encode()).digest()[:4], "big")
    return (np.random.default_rng(seed).random(dim) * 2 - 1).tolist()


def embed(rows: DataFrame, text: str, vectors: DataFrame | None = None, dim: int = VECTOR_DIM) -> DataFrame:
    """``rows`` with ``vec``: from the table ``vectors`` (``text, vec``), else seeded by the text."""

    @F.pandas_udf("array<double>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([seeded_vector(t, dim) for t in texts])

    if vectors is None:
        return rows.withColumn("vec", made(F.col(text)))
    known = vectors.select(F.col("text").alias("_t"), F.col("vec").alias("_v")).dropDuplicates(["_t"])
    out = rows.join(known, F.col(text) == F.col("_t"), "left")
    return out.withColumn("vec", F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(made(F.col(text)))).drop("_t", "_v")


def metrics_text(values: DataFrame) -> str:
    """Gauges in the text format of metric scrapers. ``values`` (``name, help, labels, value``) is a
    handful of rows."""
    out = []
    for r in values.orderBy("name").collect():
        labels = ",".join('{}="{}"'.format(k, v.replace("\\", "\\\\").replace('"', '\\"')) for k, v in sorted((r["labels"] or {}).items()))
        out.append(f"# HELP {r['name']} {r['help']}\n# TYPE {r['name']} gauge\n{r['name']}" + (f"{{{labels}}}" if labels else "") + f" {r['value']}")
    return "\n".join(out) + "\n"


def dump(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, for debugging."""
    rows.write.mode("overwrite").json(path)


def saved(before: DataFrame, after: DataFrame) -> DataFrame:
    """What assembly saved: tokens before and after, and the share in per cent. Both have ``tokens``."""
    a, b = before.agg(F.sum("tokens").alias("before")), after.agg(F.sum("tokens").alias("after"))
    return a.crossJoin(b).select("before", "after", F.round((F.lit(1) - F.try_divide("after", "before")) * 100, 1).alias("saved_percent"))
