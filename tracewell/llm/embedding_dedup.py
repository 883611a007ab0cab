"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its coordinates, with one correction
factor: the inner product of the vector and its code. Codes give unbiased estimates of inner
products, whose confidence bounds decide which pairs are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import connected_components, leaves_nothing, local_components, materialise, small

#: Least cosine of a link, and half the width of the confidence interval in standard errors (one
#: pair in 10**9 lies outside).
COSINE, SIGMAS = 0.98, 6.0
#: Components and rows of a block at most: two blocks are 8 MB of full vectors, far less as codes.
BLOCK_VALUES, BLOCK_ROWS = 1 << 19, 8192
SEED = 20240229


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random rotation, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (signs of the rotated vectors) and correction factors <vector, code> of unit rows."""
    rotated = unit @ turn.T
    signs = np.where(rotated >= 0, 1.0, -1.0)
    return signs.astype(np.float32), (rotated * signs).sum(axis=1) / np.sqrt(unit.shape[1])


def estimate(signs: np.ndarray, factor: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded rows and rotated unit ``queries``.

    <code, query> / <code, vector> has the mean <vector, query> over random rotations.
    """
    return (signs @ queries.T.astype(np.float32)) / np.float32(np.sqrt(signs.shape[1])) / factor[:, None].astype(np.float32)


def margin(factor: np.ndarray, dim: int, cosine: float, sigmas: float = SIGMAS) -> np.ndarray:
    """How far below a true inner product of ``cosine`` an estimate may lie.

    The error is that of the query's part at right angles to the vector, of length
    sqrt(1 - cosine**2), along a random direction of dim - 1 dimensions, times
    sqrt(1 - factor**2) / factor. It can't be more than that direction's whole length either.
    """
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * np.sqrt(1 - cosine**2)
    return np.minimum(sigmas / np.sqrt(max(dim - 1, 1)), 1.0) * spread


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square overflows; cosines stay what they are."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is stored of each row: its code in bits, its correction factor, and for its part as a
    query the rotated unit vector in steps of a byte, with the size of a step."""
    x = scaled(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    turn = rotation(x.shape[1])
    signs, factor = encode(unit, turn)
    queries = unit @ turn.T
    step = np.abs(queries).max(axis=1) / 127
    return np.packbits(signs > 0, axis=1), factor, np.rint(queries / step[:, None]).astype(np.int8), step


def candidates(bits: np.ndarray, factor: np.ndarray, queries: np.ndarray, step: np.ndarray, cosine: float):
    """Pairs (coded row, query row) whose upper confidence bound reaches ``cosine``, some queries at
    a time. A query's steps add an error of half a step in each component at most."""
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    bound = cosine - margin(factor, dim, cosine) - 1e-5
    half = np.sqrt(dim) / 2 / factor
    for at in range(0, len(queries), 512):
        own = queries[at : at + 512].astype(np.float32) * step[at : at + 512, None].astype(np.float32)
        least = bound[:, None] - half[:, None] * step[None, at : at + 512]
        i, j = np.nonzero(estimate(signs, factor, own) >= least.astype(np.float32))
        yield i, j + at


def links_between(x: np.ndarray, y: np.ndarray, cosine: float = COSINE, same: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (rows of ``x``, rows of ``y``) of cosine at least ``cosine``, and how many pairs were
    computed exactly. ``same``: ``x`` is ``y``, and each pair counts once."""
    x, y = scaled(x), scaled(y)
    bits, factor, _, _ = pack(x)
    _, _, queries, step = pack(y)
    left, right, exact = [], [], 0
    for i, j in candidates(bits, factor, queries, step, cosine):
        if same:
            i, j = i[i < j], j[i < j]
        exact += len(i)
        for k in range(0, len(i), 65536):
            a, b = x[i[k : k + 65536]], y[j[k : k + 65536]]
            true = np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b))
            hit = true >= cosine
            left.append(i[k : k + 65536][hit])
            right.append(j[k : k + 65536][hit])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), exact


_CODE = pa.schema([("key", pa.string()), ("code", pa.binary()), ("factor", pa.float64()), ("query", pa.binary()), ("step", pa.float64())])
CODE = "key string, code binary, factor double, query binary, step double"
OUT = "id long, n long, root long"


def _rows_of(column: pa.Array | pa.ChunkedArray, kind, rows: int) -> np.ndarray:
    """Equal-sized binary values as the rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _codes(batches):
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            for at in range(0, int((dims == dim).sum()), 2048):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)[at : at + 2048]))
                x = own.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                bits, factor, queries, step = pack(x)
                yield pa.RecordBatch.from_arrays([own.column("key"), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(factor), pa.array([r.tobytes() for r in queries], pa.binary()), pa.array(step)], schema=_CODE)


def _block_candidates(cosine: float):
    shape = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("block", pa.int32()), ("key", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        """Rows of two blocks (or one) that have a candidate; codes alone are looked at."""
        block, n = table["block"].to_numpy(), len(table)
        bits, queries = _rows_of(table["code"], np.uint8, n), _rows_of(table["query"], np.int8, n)
        factor, step = table["factor"].to_numpy(), table["step"].to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        hit = np.zeros(n, bool)
        for i, j in candidates(bits[first], factor[first], queries[second], step[second], cosine) if len(first) and len(second) else ():
            i, j = first[i], second[j]
            other = i != j
            hit[i[other]] = hit[j[other]] = True
        return table.select(shape.names).filter(pa.array(hit)).cast(shape)

    return run


def _block_links(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        ids, copies, block = table["id"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
        order = np.lexsort((ids, block))
        ids, copies, block = ids[order], copies[order], block[order]
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(ids), -1)[order]
        first = int((block == table["lo"][0].as_py()).sum())
        if table["lo"][0].as_py() == table["hi"][0].as_py():
            i, j, _ = links_between(x, x, cosine, same=True)
        else:
            i, j, _ = links_between(x[:first], x[first:], cosine)
            j = j + first
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        root = local_components(len(ids), i, j)
        linked = np.flatnonzero(n > 0)
        # A forest instead of all links: each linked row with the least row of its local component.
        return pa.table({"id": ids[linked], "n": n[linked], "root": ids[root[linked]]})

    return run


def usable(vec: Column) -> Column:
    """Whether a vector can link at all: finite components, not all of them zero."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda c: c != 0), F.lit(False))


@leaves_nothing("vector-result")
def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Links, components and keepers: ``vec_id, n_links, component_id, kept`` for every vector.

    Two vectors link if their labels are equal and not null, their lengths are equal and their
    cosine, in double precision, is at least ``cosine``. Equal vectors of a label become one with a
    count, and each of them is encoded once. The codes of a label are dealt by hash into blocks of
    at most about ``block_rows`` rows, and every pair of blocks is a task of bounded size, however
    large the label. It estimates all its pairs and names the rows of those whose upper confidence
    bound reaches ``cosine``. Full vectors are fetched for these rows alone; their pairs within the
    bound are computed exactly, into link counts and a spanning forest, never a list of links.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing:
    0 links and a component of their own. A null id is kept with a null component and 0 links.
    Rows that repeat an id and vector are copies that link with each other; rows that share an id but
    not a vector have the links of all of these vectors. An empty table gives an empty result.
    """
    vec = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    rows = rows.withColumn("ok", usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    keyed = rows.withColumn("key", F.when(F.col("ok"), F.md5(F.concat_ws("|", "label", F.to_json("vec")))))
    keyed = materialise(keyed, "vectors")
    nodes = keyed.where("ok").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = materialise(nodes.withColumn("dim", F.size("vec")), "vector-nodes")
    codes = materialise(nodes.select("key", "dim", "vec").mapInArrow(_codes, CODE), "vector-codes")
    rows_of = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_VALUES) / F.col("dim"))))
    blocks = materialise(nodes.groupBy("label", "dim").agg(F.count("*").alias("c")).select("label", "dim", F.ceil(F.col("c") / rows_of).cast("int").alias("blocks")), "vector-blocks")
    dealt = nodes.select("key", "label", "dim").join(codes, "key").join(small(blocks), ["label", "dim"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    near = dealt.groupBy("label", "dim", "lo", "hi").applyInArrow(_block_candidates(cosine), "label string, dim int, lo int, hi int, block int, key string")
    near = materialise(near, "vector-candidates")
    full = near.join(nodes.select("key", "id", "copies", "vec"), "key").select("label", "dim", "lo", "hi", "block", "id", "copies", "vec")
    found = materialise(full.groupBy("label", "dim", "lo", "hi").applyInArrow(_block_links(cosine), OUT), "vector-links")
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    forest = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = nodes.select(F.col("key").alias("k"), F.col("id").alias("node"), "copies")
    full = keyed.select("id", "key").join(known, F.col("key") == F.col("k"), "left").join(counts, "node", "left")
    full = full.join(forest.select(F.col("id").alias("node"), "component"), "node", "left")
    component = F.coalesce("component", "node", "id")
    links = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return full.select(F.col("id").alias("vec_id"), links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
