"""Hard-negative mining by vantage-point trees over norm-augmented vectors.

One more component makes all vectors of a block equally long, so that larger inner products are
smaller distances and a window of scores is an annulus around the anchor. A tree of vantage points
is walked nearest first inside the annulus, until the rows asked for have come.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import leaves_nothing, materialise, small

#: Positives of an anchor, negatives of a positive, and the shares of a positive's score (in
#: hundredths) between which its negatives lie.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows and components of a block of indexed rows at most, anchors of a block, rows of a leaf.
BLOCK_ROWS, BLOCK_VALUES, BLOCK_ANCHORS, LEAF = 8192, 1 << 20, 1024, 256
#: Share of the squared lengths by which rounding may move a bound.
SLACK = 1e-6
_MOST = (1 << 63) - 1


class VantageTree:
    """Rows of one block by their distances to vantage points; scores are integers and exact."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        squares = np.einsum("nd,nd->n", x, x) if len(x) else np.zeros(0)
        self.most = float(squares.max()) if len(x) else 0.0
        self.measured = self.most < 1e150
        self.order = np.arange(len(x))
        #: A node: first and last row, number of its vantage point or None, and for its two halves the
        #: node and the least and greatest distance to the vantage point.
        self.nodes: list = []
        self.vantages: list | np.ndarray = []
        if self.measured and len(x):
            self._tall = np.hstack([x, np.sqrt(np.maximum(self.most - squares, 0))[:, None]])
            self._leaf = leaf
            self._build(0, len(x))
            self.vantages = np.array(self.vantages)
            del self._tall
        else:
            self.nodes.append((0, len(x), None, ()))
        self.x, self.ids, self.labels = x[self.order], ids[self.order], labels[self.order]

    def _build(self, first: int, last: int) -> None:
        stack = [(first, last, None)]
        while stack:
            first, last, parent = stack.pop()
            at = len(self.nodes)
            if parent is not None:
                node, half = parent
                self.nodes[node][3][half][0] = at
            own = self.order[first:last]
            vantage = halves = None
            if last - first > self._leaf:
                rows = self._tall[own]
                point = rows[np.argmax(self._between(rows, rows[0]))]
                far = self._between(rows, point)
                middle = (last - first) // 2
                by = np.argpartition(far, middle)
                self.order[first:last], far = own[by], far[by]
                if far[:middle].min() < far[middle:].max():  # else nothing tells the rows apart
                    vantage = len(self.vantages)
                    self.vantages.append(point)
                    halves = [[-1, far[:middle].min(), far[:middle].max()], [-1, far[middle:].min(), far[middle:].max()]]
            self.nodes.append((first, last, vantage, halves))
            if vantage is not None:
                stack += [(first, first + middle, (at, 0)), (first + middle, last, (at, 1))]

    def _between(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        gap = rows - point
        return np.sqrt(np.einsum("nd,nd->n", gap, gap))

    def scores(self, first: int, last: int, q: np.ndarray) -> list[int]:
        x = self.x[first:last]
        if self.most * float(q @ q) < 2.0**104:  # no sum of products leaves 2**52
            return (x @ q).astype(np.int64).tolist()
        whole = [int(c) for c in q]
        return [max(-_MOST - 1, min(_MOST, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x]


class Walk:
    """Searches of one vector ``q`` in a tree, among the rows that ``fits`` marks; a leaf that several of
    them reach is scored once."""

    def __init__(self, tree: VantageTree, q: np.ndarray, fits: np.ndarray) -> None:
        self.tree, self.q, self.fits = tree, q, fits
        size = float(q @ q)
        self.measured = tree.measured and 0 < size < 1e150 and tree.most > 0
        self.scale = math.sqrt(tree.most / size) if self.measured else 1.0  # as long as the rows are
        self.slack = SLACK * tree.most
        self.leaves: dict[int, tuple[list[int], list[int]]] = {}
        if self.measured and len(tree.vantages):
            gap = tree.vantages - np.append(q * self.scale, 0.0)
            self.distances = np.sqrt(np.einsum("nd,nd->n", gap, gap)).tolist()

    def best(self, distance: float) -> float:
        """What a row at this distance scores at most."""
        return (self.tree.most - distance * distance / 2 + self.slack) / self.scale if self.measured else math.inf

    def leaf(self, node: int) -> tuple[list[int], list[int]]:
        """Negated scores and ids of a node's rows, best first."""
        if node not in self.leaves:
            first, last = self.tree.nodes[node][:2]
            own = np.flatnonzero(self.fits[first:last])
            scores, ids = self.tree.scores(first, last, self.q), self.tree.ids[first:last].tolist()
            found = sorted((-scores[i], ids[i]) for i in own.tolist())
            self.leaves[node] = [x[0] for x in found], [x[1] for x in found]
        return self.leaves[node]

    def nearest(self, low: int | None, high: int | None, k: int) -> list[tuple[int, int]]:
        """The first ``k`` rows ``(id, score)`` of those with a score from ``low`` to ``high``, higher
        scores and then smaller ids first. Nodes are opened nearest first; one whose rows lie all
        outside the annulus is never opened, and a leaf gives its rows one by one."""
        heap, out, count = [(-math.inf, 0, 0, 0, 0.0, math.inf)], [], 0
        while heap and len(out) < k:
            _, kind, number, node, near, far = heapq.heappop(heap)
            if kind:
                out.append((number, -self.leaf(node)[0][near]))
                at = near + 1
            else:
                _, _, vantage, halves = self.tree.nodes[node]
                if vantage is not None and self.measured:
                    distance = self.distances[vantage]
                    for child, least, most in halves:
                        nearer, farther = max(near, distance - most, least - distance), min(far, distance + most)
                        top = self.best(nearer)
                        if low is not None and top < low or high is not None and self.best(farther) - 2 * self.slack / self.scale > high:
                            continue
                        count += 1
                        heapq.heappush(heap, (-top if high is None else -min(top, float(high)), 0, count, child, nearer, farther))
                    continue
                at = 0 if high is None else bisect_left(self.leaf(node)[0], -high)
            scores, ids = self.leaf(node)
            if at < len(ids) and (low is None or -scores[at] >= low):
                heapq.heappush(heap, (scores[at], 1, ids[at], node, at, 0.0))
        return out


def _vectors(column, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _split(table: pa.Table):
    """The tree of a task's indexed rows, its anchors as ``(row, vector)``, ids, and labels as numbers."""
    asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
    x = _vectors(table["vec"], len(table))
    ids, labels = table["id"].to_numpy(), table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    tree = VantageTree(x[~asks], ids[~asks], labels[~asks])
    return tree, [(int(r), x[r]) for r in np.flatnonzero(asks)], ids, labels


def in_steps(x: Column, steps: int = 256) -> Column:
    """The largest whole number that ``steps * x`` reaches, as a double; what isn't finite stays so."""
    y = x.cast("double") * steps
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


POSITIVE = "anchor string, anchor_id long, positive_id long, positive_score long"


def _positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        tree, anchors, ids, labels = _split(table)
        for row, q in anchors:
            walk = Walk(tree, q, (tree.labels == labels[row]) & (tree.ids != ids[row]))
            for other, score in walk.nearest(None, None, k):
                out.append((table["anchor"][row].as_py(), int(ids[row]), other, score))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["anchor", "anchor_id", "positive_id", "positive_score"])

    return run


NEGATIVE = "anchor string, anchor_id long, positive_id long, place int, positive_score long, negative_id long, negative_score long"


def _negatives(k: int, low: int, high: int):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(table: pa.Table) -> pa.Table:
        out = []
        tree, anchors, ids, labels = _split(table)
        for row, q in anchors:
            walk, known = Walk(tree, q, tree.labels != labels[row]), {}
            for p in table["positives"][row].as_py():
                score = p["positive_score"]
                window = (-(-low * score // 100), high * score // 100)
                if window not in known:
                    known[window] = walk.nearest(*window, k) if window[0] <= window[1] else []
                for other, own in known[window]:
                    out.append((table["anchor"][row].as_py(), int(ids[row]), p["positive_id"], p["place"], score, other, own))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["anchor", "anchor_id", "positive_id", "place", "positive_score", "negative_id", "negative_score"])

    return run


@leaves_nothing("negatives-result")
def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Negatives that are nearly as close as a positive: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    ``vec_col`` holds whole numbers; a score is an inner product with the anchor, exactly. An
    anchor's positives are its first ``positives`` other rows of the same label, its negatives for
    each of them the first ``negatives`` rows of another label whose score is ``low`` to ``high`` percent
    of the positive's; higher scores come first, then smaller ids.

    All rows are dealt by hash into blocks of bounded size, each with its vantage-point tree, and
    the anchors (``is_anchor``, the stated query set) visit every block, some at a time. Only the first
    rows of a block leave it. Rows with a null id, label or vector, or a null or non-finite component
    take no part; vectors of different lengths never meet. A repeated row counts as often as it
    comes, a repeated anchor once; "other" rows have another id. A score beyond 63 bits counts
    as the nearest long. A label needs no second row; then there are no positives and no rows.
    """
    vec = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("vec") > 0))
    rows = materialise(rows.withColumn("dim", F.size("vec")), "negatives-rows")
    asked = rows.where("asks").dropDuplicates(["id", "label", "vec"]).withColumn("anchor", F.md5(F.concat_ws("|", "id", "label", F.to_json("vec"))))
    asked = materialise(asked, "negatives-anchors")

    def blocks(df: DataFrame, most: Column, name: str) -> DataFrame:
        return df.groupBy("dim").agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    most = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_VALUES) / F.first("dim"))))
    sizes = blocks(rows, most, "n").join(blocks(asked, F.lit(BLOCK_ANCHORS), "m"), "dim")
    sizes = small(materialise(sizes, "negatives-blocks"))
    kept = ["id", "label", "vec", "dim", "asks", "block", "turn", "anchor", "positives"]
    none = "array<struct<place:int,positive_id:long,positive_score:long>>"
    indexed = rows.join(sizes, "dim").withColumn("block", F.expr("pmod(xxhash64(id, vec), n)")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    indexed = indexed.withColumn("asks", F.lit(False)).withColumn("anchor", F.lit(None).cast("string")).withColumn("positives", F.lit(None).cast(none)).select(kept)

    def dealt(asking: DataFrame) -> DataFrame:
        asking = asking.join(sizes, "dim").withColumn("turn", F.expr("pmod(xxhash64(anchor), m)")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        return indexed.select(*(F.col(c).cast("long").alias(c) if c in ("block", "turn") else c for c in kept)).union(asking.select(kept)).groupBy("dim", "block", "turn")

    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = dealt(asked.withColumn("positives", F.lit(None).cast(none))).applyInArrow(_positives(positives), POSITIVE)
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = near.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))
    near = materialise(near, "negatives-positives")
    found = dealt(asked.join(near, "anchor")).applyInArrow(_negatives(negatives, low, high), NEGATIVE)
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b))::INTEGER AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 10
"""
