"""Helpers that the training-data operators share.

Intermediate tables go to ``spark.checkpoint.dir`` (shared by all executors), never to a
machine-local folder; the setting is only made here where the session has none.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few numbers a row) may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; on a cluster no other folder is sure to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tracewell-llm/{name}-{uuid.uuid4().hex}"


#: For each thread, the tables that each open :func:`leaves_nothing` or :func:`scratch` has written.
_OPEN = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage, so that a lost executor costs at most the running stage, and gives the
    planner true sizes to choose joins by.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if scopes := _scopes():
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class scratch:
    """Tables that are materialised inside the block go when it ends; :meth:`keep` writes one that
    stays (until an outer block ends, if there is one)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self):
        _scopes().append([])
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        inner = _scopes().pop()
        try:
            return materialise(df, name)
        finally:
            _scopes().append(inner)

    def __exit__(self, *_) -> None:
        for path in _scopes().pop():
            delete_path(self.spark, path)


def leaves_nothing(name: str) -> Callable:
    """For operators whose first argument and result are DataFrames: the result is written as one
    table, and all others that the operator has written are removed."""

    def around(operator: Callable) -> Callable:
        @wraps(operator)
        def run(rows: DataFrame, *args, **options) -> DataFrame:
            with scratch(rows.sparkSession) as block:
                return block.keep(operator(rows, *args, **options), name)

        return run

    return around


def quoted(name: str) -> str:
    """``name`` as a column's name, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder with the file system that Spark itself uses."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cleanup(spark: SparkSession) -> None:
    """Remove every intermediate table that these operators have left in the shared folder."""
    delete_path(spark, f"{shared_dir(spark)}/tracewell-llm")


#: How to empty each cache that this worker process keeps between tasks.
_CACHES: dict = {}


def keeps_cache(name: str, clear) -> None:
    """Name a cache of this process; ``clear`` empties it."""
    _CACHES[name] = clear


def uses_cache(name: str | None) -> None:
    """Empty all caches but one, and give freed memory back. A worker outlives its task, and a
    pipeline's stages would else fill their caches beside each other in the same process."""
    for other, clear in _CACHES.items():
        if other != name:
            clear()
    give_back()


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:  # the C library keeps freed pages otherwise; where it has no such call, it does
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a materialised, narrow table) with a broadcast hint if a count proves it small.

    Beyond the bound it comes back without a hint, and the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_order(col) -> tuple:
    """Columns that put rows in an order that doesn't depend on layout or run."""
    return F.md5(col.cast("string")), col


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an undirected graph: one row ``(id, component)`` for each node of ``edges``.

    ``edges`` has the long columns ``a`` and ``b``. Large-star and small-star steps alternate
    until nothing changes, so the number of rounds grows with the logarithm of a component's
    diameter. Each round writes its edges; no link list ever goes to the driver. Minima are
    aggregated before the shuffle, and the join back is one whose hot side Spark may split.
    A graph whose counted edges stay under ``BROADCAST_ROWS`` is solved by one task instead, in
    memory of that bound; rounds over many partitions would only cost time. An empty table gives an
    empty table.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    if now.count() <= BROADCAST_ROWS:
        return now.coalesce(1).mapInArrow(_solve, "id long, component long")
    last = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low, "u")
        after = stars.select("u", F.col("m").alias("v")).union(stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = materialise(after.where("u <> v").distinct(), name)
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if mark == last:
            break
        last = mark
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _solve(batches):
    """Components of all edges of one partition, which the caller has bounded."""
    import numpy as np
    import pyarrow as pa

    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    edges = np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1)
    ids, places = np.unique(edges, return_inverse=True)
    places = places.reshape(edges.shape)
    root = local_components(len(ids), places[0], places[1])
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[root], pa.int64())], names=["id", "component"])


def local_components(n: int, left, right):
    """Union-find over ``n`` local nodes: an array with the smallest member of each node's set."""
    import numpy as np

    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], dtype=np.int64) if n else parent


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is: from ``TOKENIZER_DIR`` if set, else the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
