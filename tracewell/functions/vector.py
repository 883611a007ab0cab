"""Vector expressions over ``array<double>`` columns, and centroids as aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or unequal lengths; null if either is null."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), value).otherwise(0.0)


#: Components of query vectors that are broadcast at most: 64 MB.
BROADCAST_COMPONENTS = 8_000_000


def meet(rows: DataFrame, vec: str, queries: DataFrame, query_vec: str, most: int = BROADCAST_COMPONENTS) -> DataFrame:
    """Each row beside each query of its length. The queries are a stated set; null vectors meet nothing.

    All vectors of a table may have one length, so the length alone is no key to deal them by. If
    the queries' size is small (it is summed first) they are broadcast and the rows stay where they are. Beyond
    that, queries are cut into blocks of that size and rows into as many parts as a shuffle has
    partitions, and every block meets every part in a task of its own.
    """
    return beside(rows, vec, queries, query_vec, F.size(query_vec), F.size(vec) == F.size(query_vec), most)


def beside(rows: DataFrame, col: str, queries: DataFrame, query_col: str, weight: Column, on: Column | None = None, most: int = BROADCAST_COMPONENTS) -> DataFrame:
    """Each row beside each query (or those that ``on`` lets meet), dealt as in :func:`meet`: by the
    values of ``col`` and ``query_col``, with ``weight`` as the size of a query."""
    on = F.lit(True) if on is None else on
    size = int(queries.agg(F.coalesce(F.sum(F.greatest(weight, F.lit(0))), F.lit(0))).first()[0])
    if size <= most:
        return rows.join(F.broadcast(queries), on)
    blocks, parts = -(-size // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_part", place(col, parts)).withColumn("_block", every(blocks))
    right = queries.withColumn("_its_block", place(query_col, blocks)).withColumn("_its_part", every(parts))
    met = left.join(right, on & (F.col("_part") == F.col("_its_part")) & (F.col("_block") == F.col("_its_block")))
    return met.drop("_part", "_block", "_its_part", "_its_block")


#: Rows of a part that a block of queries meets in one task, about, if that keeps all cores busy; components of such a part
#: at most, about (16 MB); and queries and rows whose products a task holds at once.
NEAREST_ROWS, NEAREST_COMPONENTS, TILE = 4_000, 2_000_000, (64, 8_192)
#: Products that a task of :func:`within` holds at once.
NEAREST_PRODUCTS = 2_000_000


def _matrices(table: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column by length: places and matrix; components that are null are NaN."""
    out: dict[int, list[np.ndarray]] = {}
    lists = table[name].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(starts)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[int(n)] = at, values[starts[at][:, None] + np.arange(n)]
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows beside rows, summed one after another as :func:`cosine` does; 0 for a zero vector."""
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    size = np.sqrt(total(a * a)) * np.sqrt(total(b * b))
    return np.divide(total(a * b), size, out=np.zeros(len(a)), where=size != 0)


#: What a sum of products of two unit vectors may lose in single precision, a component: twice, as a bound may lose it too.
SINGLE = 1.2e-7


def _unit(m: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; zero vectors stay."""
    return (m / np.where((d := np.linalg.norm(m, axis=1)) == 0, 1, d)[:, None]).astype(np.float32)


def _maxima(s: np.ndarray, k: int) -> np.ndarray:
    """Maxima of groups of columns, many more than ``k``: column ``j`` is of group ``j % groups``; less than a group's size at the end is left out."""
    size = 1 << (max(1, min(32, s.shape[1] // (8 * k))).bit_length() - 1)
    groups = s.shape[1] // size
    return s[:, : groups * size].reshape(len(s), size, groups).max(axis=1)


def _reached(s: np.ndarray, k: int) -> np.ndarray:
    """For each row, a value that at least ``k`` of its values reach: the ``k``-th greatest of maxima of groups, so nearly its ``k``-th greatest."""
    best = _maxima(s, k)
    return np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]


def _not_behind(of: np.ndarray, value: np.ndarray, k: int, room: float) -> np.ndarray:
    """Which values are at or above the ``k``-th greatest one of their ``of``, less ``room``; a NaN is."""
    order = np.lexsort((-value, of))
    first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else np.zeros(0, int)
    sizes = np.diff(np.r_[first, len(of)])
    kth = np.where(sizes >= k, value[order][np.minimum(first + k - 1, len(of) - 1)], -np.inf) if len(of) else np.zeros(0)
    out = np.zeros(len(of), bool)
    out[order] = ~(value[order] < np.repeat(kth - room, sizes))
    return out


def _hopeful(ws: np.ndarray, vs: np.ndarray, k: int, least: float, about: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and rows whose product may be among the ``k`` greatest of the query's: a tile of rows after
    another, and of a tile's products those of groups alone whose maximum may be."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    bound = np.full(len(ws), least)
    for i in range(0, len(vs), TILE[1]):
        s = ws @ vs[i : i + TILE[1]].T
        best = _maxima(s, k)
        groups = best.shape[1]
        size = s.shape[1] // groups
        if groups >= k:
            bound = np.maximum(bound, _reached(best, k))
        low = (bound - about).astype(np.float32)
        a, g = np.divmod(np.flatnonzero(best >= low[:, None]), groups)
        b = g[:, None] + groups * np.arange(size)
        some = s[a[:, None], b] >= low[a, None]
        a, b = np.repeat(a, some.sum(axis=1)), b[some]
        if groups * size < s.shape[1]:
            x, y = np.nonzero(s[:, groups * size :] >= low[:, None])
            a, b = np.r_[a, x], np.r_[b, y + groups * size]
        found.append((a, b + i, s[a, b]))
    a, b, s = (np.concatenate([x[j] for x in found]) for j in range(3))
    some = _not_behind(a, s, k, about)
    return a[some], b[some]


def _nearest(k: int, least: float, margin: float, schema: S.StructType):
    q_name, key, _ = schema.names

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asked = _matrices(queries, "_w") if len(queries) and len(rows) else {}
        for n, (at, v) in (_matrices(rows, "_v") if asked else {}).items():
            if n not in asked:
                continue
            q_at, w = asked[n]
            with np.errstate(all="ignore"):
                vs, ws, about = _unit(v), _unit(w), margin + SINGLE * (n + 4)
                odd = ~np.isfinite(vs).all(axis=1)  # all products with it are looked at exactly
                good, bad, vs = np.flatnonzero(~odd), np.flatnonzero(odd), vs[~odd]
                for i in range(0, len(w), TILE[0]):
                    mine = ws[i : i + TILE[0]]
                    plain = np.isfinite(mine).all(axis=1)
                    fine, strange = np.flatnonzero(plain), np.flatnonzero(~plain)
                    a, b = _hopeful(mine[fine], vs, k, least, about) if len(fine) and len(good) else (np.zeros(0, int), np.zeros(0, int))
                    a = np.r_[fine[a], np.repeat(fine, len(bad)), np.repeat(strange, len(v))] + i
                    b = np.r_[good[b], np.tile(bad, len(fine)), np.tile(np.arange(len(v)), len(strange))]
                    c = np.concatenate([_cosines(w[a[j : j + 50_000]], v[b[j : j + 50_000]]) for j in range(0, max(1, len(a)), 50_000)])
                    some = _not_behind(a, c, k, margin)
                    found.append((q_at[a[some]], at[b[some]], c[some]))
        a, b, c = (np.concatenate([x[j] for x in found]) if found else np.zeros(0) for j in range(3))
        return pa.table({q_name: queries[q_name].take(pa.array(a.astype(np.int64))), key: rows[key].take(pa.array(b.astype(np.int64))), "c": pa.array(c.astype(np.float64))})

    return run


def nearest(rows: DataFrame, key: str, vec: str, queries: DataFrame, q: str, query_vec: str, k: int, least: float = -2.0, margin: float = 1e-8) -> DataFrame:
    """The rows whose cosine with a query of their length is among its ``k`` greatest, and some more:
    ``q, key, c``. ``c`` is what :func:`cosine` gives, to the bit; vectors that hold a null or a NaN have a NaN or 0.

    Whoever ranks by ``c``, or by a rounding of it finer than ``margin``, and then by ``key`` from the least finds the same
    first ``k`` at or above ``least`` as among all pairs. All pairs are looked at, as products of blocks of queries and parts of
    the rows, a task each, in single precision with room for its loss; what leaves a task is about ``k`` rows a query, and those within the margin. Of equal vectors only the ``k`` of
    the least keys take part, so copies don't add up.
    """
    spark = rows.sparkSession
    have = rows.where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("_v"))
    asked = queries.where(F.col(query_vec).isNotNull()).select(q, F.col(query_vec).alias("_w"))
    size = lambda df, c: df.agg(F.coalesce(F.sum(F.size(c)), F.lit(0)), F.count("*")).first()
    (r_size, n), (q_size, _) = size(have, "_v"), size(asked, "_w")
    blocks = max(1, -(-int(q_size) // BROADCAST_COMPONENTS))
    busy = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    parts = max(1, -(-int(r_size) // NEAREST_COMPONENTS), min(busy, -(-n // NEAREST_ROWS)))  # queries move, and a query's first rows come back, once a part
    copy = F.row_number().over(Window.partitionBy("_hash", "_v").orderBy(key))  # vectors are compared only if their hashes are equal
    have = have.withColumn("_hash", F.xxhash64("_v")).withColumn("_copy", copy).where(F.col("_copy") <= k).drop("_copy", "_hash")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = have.withColumn("_part", place(key, parts)).withColumn("_block", every(blocks)).groupBy("_part", "_block")
    right = asked.withColumn("_block", place(q, blocks)).withColumn("_part", every(parts)).groupBy("_part", "_block")
    schema = S.StructType([asked.schema[q], have.schema[key], S.StructField("c", S.DoubleType())])
    return left.cogroup(right).applyInArrow(_nearest(k, least, margin, schema), schema)


#: Components of a block of vectors that meets another one in a task of :func:`within`: 16 MB.
BLOCK_COMPONENTS = 2_000_000


def _within(margin: float, schema: S.StructType):
    q_name, key, _ = schema.names

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asked = _matrices(queries, "_w") if len(queries) and len(rows) else {}
        least, from_, to = (x.to_numpy() for x in (queries["_least"], rows["_from"], queries["_to"]))
        for n, (at, v) in (_matrices(rows, "_v") if asked else {}).items():
            if n not in asked:
                continue
            q_at, w = asked[n]
            with np.errstate(all="ignore"):
                vs, ws, about = _unit(v), _unit(w), margin + SINGLE * (n + 4)
                step = max(1, NEAREST_PRODUCTS // len(v))
                for i in range(0, len(w), step):
                    far = ws[i : i + step] @ vs.T < (least[q_at[i : i + step]] - about).astype(np.float32)[:, None]  # a NaN isn't, and is looked at exactly
                    a, b = np.nonzero(~far)
                    some = from_[at[b]] < to[q_at[i + a]]
                    a, b = a[some], b[some]
                    found += [(q_at[i + a[j : j + 50_000]], at[b[j : j + 50_000]], _cosines(w[i + a[j : j + 50_000]], v[b[j : j + 50_000]])) for j in range(0, len(a), 50_000)]
        a, b, c = (np.concatenate([x[j] for x in found]) if found else np.zeros(0) for j in range(3))
        return pa.table({q_name: queries[q_name].take(pa.array(a.astype(np.int64))), key: rows[key].take(pa.array(b.astype(np.int64))), "c": pa.array(c.astype(np.float64))})

    return run


def within(rows: DataFrame, key: str, vec: str, since: str, queries: DataFrame, q: str, query_vec: str, until: str, least: str, margin: float = 1e-8) -> DataFrame:
    """All rows whose cosine with a query of their length is at or above the query's ``least``, or less by no more than
    ``margin``, and whose ``since`` is less than its ``until``: ``q, key, c``, with ``c`` as :func:`nearest` has it.

    For two large sides: blocks of either meet in a task each, so a row moves once a block of the other side.
    """
    spark = rows.sparkSession
    have = rows.where(F.col(vec).isNotNull()).select(key, F.col(vec).alias("_v"), F.col(since).alias("_from"))
    asked = queries.where(F.col(query_vec).isNotNull()).select(q, F.col(query_vec).alias("_w"), F.col(until).alias("_to"), F.col(least).alias("_least"))
    size = lambda df, c: df.agg(F.coalesce(F.sum(F.size(c)), F.lit(0)), F.count("*")).first()
    (r_size, n), (q_size, _) = size(have, "_v"), size(asked, "_w")
    blocks, parts = (max(1, -(-int(x) // BLOCK_COMPONENTS)) for x in (q_size, r_size))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(-(-usual // blocks), -(-n * 4 // NEAREST_ROWS)))  # small sides keep all tasks busy
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = have.withColumn("_part", place(key, parts)).withColumn("_block", every(blocks)).groupBy("_part", "_block")
    right = asked.withColumn("_block", place(q, blocks)).withColumn("_part", every(parts)).groupBy("_part", "_block")
    schema = S.StructType([asked.schema[q], have.schema[key], S.StructField("c", S.DoubleType())])
    return left.cogroup(right).applyInArrow(_within(margin, schema), schema)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x / by)


def means(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Mean vector and count per key: ``keys, mean, n``.

    Components are averaged as rows, with partial sums before the shuffle, so a key may have any
    number of vectors.
    """
    parts = rows.where(F.col(vec).isNotNull()).select(*keys, F.posexplode(vec).alias("i", "x"))
    each = parts.groupBy(*keys, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    back = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("n"))
    return back.select(*keys, F.transform("c", lambda s: s["x"]).alias("mean"), "n")


def sums(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Sums of components and counts per key, as rows ``keys, i, total, n``: state that adds up."""
    parts = rows.where(F.col(vec).isNotNull()).select(*keys, F.posexplode(vec).alias("i", "x"))
    return parts.groupBy(*keys, "i").agg(F.sum("x").alias("total"), F.count("*").alias("n"))


def mean_of_sums(found: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector and count per key of any number of :func:`sums`: ``keys, mean, n``. An incremental mean,
    (old * n + v) / (n + 1), is the same but for rounding."""
    each = found.groupBy(*keys, "i").agg((F.sum("total") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    back = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("n"))
    return back.select(*keys, F.transform("c", lambda s: s["x"]).alias("mean"), "n")


def centroids(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Unit centroid per key, null if the mean is zero: ``keys, centroid, n``."""
    found = means(rows, keys, vec)
    size = norm(F.col("mean"))
    return found.select(*keys, F.when(size > 0, scaled(F.col("mean"), size)).alias("centroid"), "n")
