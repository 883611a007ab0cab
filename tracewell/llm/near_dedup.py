"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF word shingles.

Samples are banded into buckets, candidates verified by exact weighted Jaccard similarity, and
linked documents put into classes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import connected_components, fresh, leaves_nothing, materialise, quoted, small, uses_cache
from tracewell.llm.linear import token_hashes

#: Numbers that are given out stay below this.
FAR = 1 << 62
#: Words of a shingle and the least weighted Jaccard similarity of near duplicates.
WORDS, SIMILARITY = 5, 0.8
#: Samples per text: a pair at the threshold shares one of 14 bands of 4 with probability 0.9994.
BANDS, ROWS = 14, 4
#: Slots of the document frequency table (256 kB as floats), fixed whatever the corpus.
SLOTS = 1 << 16
#: Share of all documents that is added to every document frequency. So the weight of what a large
#: group of near copies shares stays within a small factor of that of rare shingles, and a copy's
#: own few changes don't outweigh it.
PRIOR = 0.2
#: Sketch bits that may differ in a candidate. At the threshold 5.6 of 56 do on average, and more
#: than 16 in 2 of 100,000 pairs. This is the only filter that can lose a link.
SKETCH_BITS = 16
#: Words of 64 bits of the maps that bound a pair's difference from below, by the least weight of the
#: shingles in them: rare ones (in up to 4 % of the documents), common ones, and all others.
MAP_WORDS, MAP_WEIGHTS = (40, 16, 8), (1.65, 1.0, 0.0)
#: Members that one task compares with a leader before the leader is sent to another task.
MEMBERS = 512

_WORD = re.compile(r"\w+")
_U = np.uint64
_P, _C1, _C2 = _U(0x100000001B3), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, bytes]:
    """Hashes of a text's shingles in order, and a 128-bit key of its sequence of words.

    Words are runs of word characters in lower case. A text of fewer words is one shingle, one
    without words has none.
    """
    h = token_hashes(_WORD.findall((text or "").lower()))
    key = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    if not len(h):
        return h, key
    k = min(words, len(h))
    out = h[: len(h) - k + 1] + _U(k)
    for j in range(1, k):
        out = out * _P + h[j : len(h) - k + 1 + j]
    return _mixed(out), key


def compact(hashes: np.ndarray) -> np.ndarray:
    """The sorted 32-bit shingles that a text is known by from here on, repeats included."""
    return np.sort((hashes >> _U(32)).astype(np.uint32))


def slots(shingle: np.ndarray) -> np.ndarray:
    """Places in the document frequency table."""
    return (shingle & np.uint32(SLOTS - 1)).astype(np.int64)


def counted(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a sorted vector, and how often each comes."""
    first = np.flatnonzero(np.concatenate([[True], vector[1:] != vector[:-1]])) if len(vector) else np.zeros(0, np.int64)
    return vector[first], np.diff(np.append(first, len(vector)))


def inverse_frequencies(counts: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p(documents / (counts + PRIOR * max(documents, 1)) if documents else np.ones(len(counts))).astype(np.float32)


def _gamma2_quantiles(n: int = 4096) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of ``n`` equal steps, by bisection."""
    q, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_R = _gamma2_quantiles().astype(np.float32)
_LNC = np.log(_gamma2_quantiles()).astype(np.float32)


def _seeds(first: int, n: int) -> np.ndarray:
    return _mixed(np.arange(first, first + n, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


_SEEDS = _seeds(1, BANDS * ROWS)


def weighted_samples(hashes: np.ndarray, weights: np.ndarray, block: int = 1024, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """One consistent sample per seed, as a hash of (shingle, quantised weight).

    Two weighted sets have equal samples with the probability of their weighted Jaccard
    similarity. For a shingle and seed, r and c are Gamma(2, 1) and b is uniform, all from one hash;
    t = floor(ln w / r + b), and the shingle with the least ln c - r (t - b + 1) is drawn.
    """
    n_seeds = len(seeds)
    best, shingle, level = np.full(n_seeds, np.inf, np.float32), np.zeros(n_seeds, np.uint64), np.zeros(n_seeds, np.float32)
    log_w = np.log(weights).astype(np.float32)
    for at in range(0, len(hashes), block):
        s, lw = hashes[at : at + block], log_w[at : at + block]
        x = seeds[:, None] * (s ^ (s >> _U(29)))[None, :]
        x ^= x >> _U(32)
        x *= _C2
        r = _R[(x >> _U(52)).view(np.int64)]
        b = ((x >> _U(16)) & _U(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(lw[None, :] / r + b)
        a = _LNC[((x >> _U(40)) & _U(0xFFF)).view(np.int64)] - r * (t - b + 1)
        i = a.argmin(axis=1)
        rows = np.arange(n_seeds)
        less = a[rows, i] < best
        best = np.where(less, a[rows, i], best)
        shingle, level = np.where(less, s[i], shingle), np.where(less, t[rows, i], level)
    return _mixed(shingle + _mixed(level.astype(np.int64).view(np.uint64) + seeds))


def signature(vector: np.ndarray, idf: np.ndarray) -> tuple[list[int], int]:
    """Band keys, and a sketch with a bit of each sample."""
    shingle, tf = counted(vector)
    drawn = weighted_samples(_mixed(shingle.astype(np.uint64) * _P + _C1), tf * idf[slots(shingle)])
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        keys = _mixed(keys * _P + drawn.reshape(BANDS, ROWS)[:, j])
    bits = int(((drawn >> _U(63)) << np.arange(len(drawn), dtype=np.uint64)).sum())
    return keys.view(np.int64).tolist(), bits - (1 << 64) if bits >> 63 else bits


def difference_map(vector: np.ndarray, idf: np.ndarray) -> tuple[list[int], float]:
    """Bit maps of a text's shingles by weight class, 64 bits to a number, and its whole weight.

    If a bit differs between two texts, one of them holds a shingle there that the other lacks. So
    the differing bits of each class, times its least weight, never exceed the weight by which the
    two texts differ.
    """
    shingle, tf = counted(vector)
    weight = idf[slots(shingle)]
    out, above = [], np.inf
    for words, least in zip(MAP_WORDS, MAP_WEIGHTS, strict=True):
        bits = np.zeros(64 * words, np.uint8)
        own = shingle[(weight >= least) & (weight < above)]
        bits[(own >> np.uint32(12)).astype(np.int64) % len(bits)] = 1
        out += np.packbits(bits).view(np.int64).tolist()
        above = least
    return out, float((tf * weight.astype(float)).sum())


def weighted_jaccard(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Of two sorted vectors."""
    (ua, ca), (ub, cb) = counted(a), counted(b)
    wa, wb = ca * idf[slots(ua)].astype(float), cb * idf[slots(ub)].astype(float)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    total = wa.sum() + wb.sum() - both
    return float(both / total) if total else 0.0


_VECTORS = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("vec", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and vector of each text, then one row with the task's table of document frequencies."""
    from pyspark import TaskContext

    uses_cache("hashes")
    counts, part = np.zeros(SLOTS + 1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(ids), 1024):
            keys, data = [], []
            for text in texts[at : at + 1024]:
                hashes, key = shingles(text.as_py())
                vector = compact(hashes)
                if len(vector):
                    counts[np.unique(slots(vector))] += 1
                    counts[SLOTS] += 1
                keys.append(key)
                data.append(vector.tobytes() if len(vector) else None)
            none = pa.nulls(len(keys))
            yield pa.RecordBatch.from_arrays([ids[at : at + 1024], pa.array(keys, pa.binary()), pa.array(data, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_VECTORS)
    yield pa.RecordBatch.from_pylist([{"part": part, "counts": counts.tobytes()}], schema=_VECTORS)


def vectors(texts: DataFrame) -> DataFrame:
    """``id, key, vec`` of each text (no vector without words) and, in rows of their own, ``part,
    counts``. Texts are read and cut into words this once; every later step reads this table."""
    return materialise(texts.select("id", "text").mapInArrow(_vectors, "id long, key binary, vec binary, part int, counts binary"), "near-vectors")


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["counts"])
    return pa.table({"part": pa.array([table["part"][0].as_py() // 64], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def document_frequencies(table: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by slot of the frequency table, over all texts of :func:`vectors`, and how many have words.

    Each task counts in a table of fixed size. Tables are added 64 at a time until 4 are left
    (2 MB at most), which the driver adds.
    """
    table = table.where("counts is not null").select("part", "counts")
    while table.count() > 4:
        table = materialise(table.groupBy(F.floor(F.col("part") / 64)).applyInArrow(_sum_counts, "part int, counts binary"), "near-counts")
    total = sum((np.frombuffer(r["counts"], np.int64) for r in table.collect()), np.zeros(SLOTS + 1, np.int64))
    return total[:SLOTS], int(total[SLOTS])


def _vector(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint32)


def _signatures(idf):
    shape = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses_cache(None)
        for batch in batches:
            found = [signature(_vector(v), idf.value) if v.is_valid else (None, None) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.int64())], schema=shape)

    return run


def _maps(idf):
    shape = pa.schema([("node", pa.int64()), ("map", pa.list_(pa.int64())), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difference_map(_vector(v), idf.value) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.float64())], schema=shape)

    return run


def _key_of(texts):
    return texts.map(lambda t: shingles(t)[1])


def _compare(idf):
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, share, b, vec in zip(batch.column("a").to_pylist(), batch.column("share").to_pylist(), batch.column("b").to_pylist(), batch.column("vec"), strict=True):
                v = np.frombuffer(vec.as_py(), np.uint32)
                if b is None:
                    leader, held = v, (a, share)
                elif held == (a, share):
                    out.append((a, b, weighted_jaccard(leader, v, idf.value)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), shape.types, strict=True)], schema=shape)

    return run


def similarities(pairs: DataFrame, known: DataFrame, idf) -> DataFrame:
    """Exact weighted Jaccard similarity of ``pairs`` (``a``, ``b``) of ``known`` (``id, vec``): ``a, b, sim``.

    Members go to their leader ``a``, at most about ``MEMBERS`` to a task for one leader, and a
    task reads them one after another, so no group is held in memory.
    """
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "near-ids")
    wanted = materialise(known.join(small(ids), "id", "left_semi").select("id", "vec").dropDuplicates(["id"]), "near-wanted")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("shares"))
    sizes = materialise(sizes, "near-leaders")
    members = pairs.join(sizes, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares"))).select("a", "share", "b")
    members = members.join(wanted, F.col("b") == F.col("id")).select("a", "share", "b", "vec")
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    leaders = leaders.join(wanted, F.col("a") == F.col("id")).select("a", "share", F.lit(None).cast("long").alias("b"), "vec")
    rows = leaders.union(members).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return materialise(rows.mapInArrow(_compare(idf), "a long, b long, sim double"), "near-similarities")


def further_pairs(labelled: DataFrame, sims: DataFrame, nodes: DataFrame, known: DataFrame, idf, similarity: float) -> DataFrame:
    """Pairs of different classes that share a bucket and that no bound rules out: ``a, b``.

    A pair is looked at in the first bucket that it shares, by band, and nowhere else. It isn't a
    link if its distances to the bucket's leader differ by more than ``1 - similarity`` (one minus
    weighted Jaccard is a metric), if one text weighs less than ``similarity`` times the other, or
    if its maps (:func:`difference_map`) differ by more than a link's weights allow. None of these
    loses a link.
    """
    bands = nodes.select("node", *[F.col("bands")[i].alias(f"b{i}") for i in range(BANDS)])
    distance = sims.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("sim")).alias("d"))
    mixed = labelled.where("class <> l_class").groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    mixed = mixed.join(labelled.where("class = l_class").select("bucket").distinct().withColumn("inside", F.lit(True)), "bucket", "left")
    mixed = materialise(mixed.where("lo <> hi or inside").select("bucket"), "near-mixed")
    open_ = labelled.join(small(mixed), "bucket").join(distance, ["leader", "node"], "left").select("bucket", "node", "sketch", "class", "d")
    open_ = materialise(open_, "near-open")
    crowd = materialise(open_.select(F.col("node").alias("id")).distinct(), "near-crowd")
    maps = known.join(small(crowd), "id", "left_semi").select("id", "vec").mapInArrow(_maps(idf), "node long, map array<long>, weight double").dropDuplicates(["node"])
    maps = materialise(maps.select("node", "weight", *[F.col("map")[i].alias(f"m{i}") for i in range(sum(MAP_WORDS))]), "near-maps")
    open_ = open_.join(maps, "node").join(bands, "node")
    open_ = open_.withColumn("band", F.coalesce(*[F.when(F.col("bucket") == F.col(f"b{i}"), F.lit(i)) for i in range(BANDS)]))
    x, y = open_.alias("x"), open_.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class") < F.col("y.class"))
    alike = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= SKETCH_BITS
    near = F.col("x.d").isNull() | F.col("y.d").isNull() | (F.abs(F.col("x.d") - F.col("y.d")) <= 1 - similarity + 1e-9)
    first = F.lit(True)
    for i in range(BANDS - 1):
        first = first & ((F.col("x.band") <= i) | (F.col(f"x.b{i}") != F.col(f"y.b{i}")))
    even = F.least("x.weight", "y.weight") >= (similarity - 1e-9) * F.greatest("x.weight", "y.weight")
    differ, at = F.lit(0.0), 0
    for words, least in zip(MAP_WORDS, (*MAP_WEIGHTS[:-1], float(inverse_frequencies(np.array([1]), 1)[0])), strict=True):
        bits = F.lit(0)
        for i in range(at, at + words):
            bits = bits + F.bit_count(F.col(f"x.m{i}").bitwiseXOR(F.col(f"y.m{i}")))
        differ, at = differ + bits * F.lit(least), at + words
    closely = differ <= (F.col("x.weight") + F.col("y.weight")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    return x.join(y, apart & alike & near & even & first & closely).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The class of near duplicates of every document: ``doc_id, class_id, class_size, kept``.

    Documents are linked if the weighted Jaccard similarity of their TF-IDF shingles is at least
    ``similarity``; classes are the connected components, named by their smallest id, and the
    document of that id is kept.

    1. Texts with the same words are one node from the start; copies never meet each other.
    2. Nodes that share a band are compared with the bucket's leader: the member that shares most
       buckets with others, which in a group of copies is the text that they come from or the like.
    3. In buckets that then hold more than one class, pairs of different classes are compared too,
       each once, unless a bound rules the link out (:func:`further_pairs`).

    Pairs inside a class are never enumerated, and no link between different texts of a shared
    bucket is lost but by the sketches. Document frequencies cover all texts in a hashed table.

    Texts without words (null, empty, punctuation) are classes of their own. Rows that repeat an
    id and a text are one document: each has a row in the result, one of them kept. Rows that share
    an id but hold different texts are compared each by its own text; classes of such texts may have
    the same name, but they count and keep their own rows. A null id gives a null class, not
    compared and kept. An empty table gives an empty result.
    """
    return _decided(docs, id_col, text_col, similarity).drop("key")


@leaves_nothing("near-decided")
def _decided(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """The result of :func:`near_dedup` with the ``key`` of each row's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = vectors(rows)
    counts, n = document_frequencies(table)
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(counts, n))
    table = table.where("key is not null").select("id", "key", "vec")
    signed = materialise(table.mapInArrow(_signatures(idf), "id long, key binary, bands array<long>, sketch long"), "near-signatures")
    known = signed.where("id is not null")
    nodes = known.where("bands is not null").groupBy("key").agg(F.min("id").alias("node"), F.min_by("bands", "id").alias("bands"), F.min_by("sketch", "id").alias("sketch"))
    nodes = materialise(nodes, "near-nodes")
    table = table.where("id is not null and vec is not null")
    # Ids that hold several texts: each text that is a node gets a number of its own, beyond all ids or
    # below them. If ids lie at both ends of what a long holds, all nodes are numbered anew.
    several = materialise(known.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("id"), "near-several")
    if not several.isEmpty():
        low, top = known.agg(F.min("id"), F.max("id")).first()
        count = F.monotonically_increasing_id()
        number = F.lit(top + 1) + count if top < FAR else F.lit(low - 1) - count if low > -FAR else count
        if -FAR >= low and top >= FAR:
            several = materialise(known.select("id").distinct(), "near-several")
        numbered = materialise(nodes.join(small(several), nodes["node"] == several["id"], "left_semi").select(F.col("node").alias("id"), "key"), "near-told")
        numbered = materialise(numbered.withColumn("number", number), "near-numbered")
        nodes = nodes.join(numbered.select("key", "number"), "key", "left").withColumn("node", F.coalesce("number", "node")).drop("number")
        nodes = materialise(nodes, "near-nodes")
        told = table.join(small(several), "id", "left_semi").join(numbered, ["id", "key"]).select(F.col("number").alias("id"), "key", "vec")
        table = table.join(small(several), "id", "left_anti").unionByName(materialise(told, "near-told"))
    placed = nodes.select("node", "sketch", F.explode("bands").alias("bucket"))
    sizes = materialise(placed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "near-sizes")
    shared = materialise(placed.join(small(sizes), "bucket"), "near-shared")
    # The member that meets most others over all its buckets is likely to be what the others are
    # copies of, and as near to them as any.
    meets = materialise(shared.groupBy("node").agg(F.sum("c").alias("meets")), "near-meets")
    central = F.max_by(F.struct("node", "sketch"), F.struct("meets", F.bitwise_not("node"))).alias("leader")
    leaders = shared.join(meets, "node").groupBy("bucket").agg(central)
    leaders = materialise(leaders.select("bucket", F.col("leader.node").alias("leader"), F.col("leader.sketch").alias("l_sketch")), "near-buckets")
    members = shared.drop("c").join(small(leaders), "bucket").where("node <> leader")
    alike = F.bit_count(F.col("sketch").bitwiseXOR(F.col("l_sketch"))) <= SKETCH_BITS
    members = materialise(members.select("bucket", "leader", "node", "sketch", alike.alias("alike")), "near-members")
    pairs = materialise(members.where("alike").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    sims = similarities(pairs, table, idf)
    links = sims.where(F.col("sim") >= similarity).select("a", "b")
    classes = materialise(connected_components(links), "near-classes")

    # Buckets that still hold several classes: the leader's own class and its members'.
    of = lambda c, out: classes.select(F.col("id").alias(c), F.col("component").alias(out))
    labelled = members.join(of("node", "n_class"), "node", "left").join(of("leader", "l_class"), "leader", "left")
    labelled = labelled.withColumn("class", F.coalesce("n_class", "node")).withColumn("l_class", F.coalesce("l_class", "leader"))
    labelled = materialise(labelled.select("bucket", "leader", "node", "sketch", "class", "l_class"), "near-labelled")
    if not labelled.where("class <> l_class").isEmpty():
        more = materialise(further_pairs(labelled, sims, nodes, table, idf, similarity), "near-more")
        more = materialise(more.join(pairs, ["a", "b"], "left_anti").join(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "near-more")
        if not more.isEmpty():
            found = similarities(more, table, idf).where(F.col("sim") >= similarity).select("a", "b")
            if not found.isEmpty():
                # The new links join classes: their graph is small, whatever the classes' sizes.
                named = found.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left")
                named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
                joined = materialise(connected_components(named), "near-joined").select(F.col("id").alias("component"), F.col("component").alias("to"))
                moved = classes.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                alone = joined.select(F.col("component").alias("id"), F.col("to").alias("component")).join(classes.select("id"), "id", "left_anti")
                classes = materialise(moved.unionByName(alone), "near-classes")

    each = known.groupBy("id", "key", F.col("bands").isNull().alias("bare")).agg(F.count("*").alias("m"))
    node_of = nodes.select(F.col("key").alias("k"), "node")
    each = each.join(node_of, (F.col("key") == F.col("k")) & ~F.col("bare"), "left").withColumn("node", F.coalesce("node", "id"))
    # A text without words has its id as class; ``bare`` tells it from a class of other texts of that id.
    each = each.join(classes.select(F.col("id").alias("node"), "component", F.lit(False).alias("bare")), ["node", "bare"], "left")
    each = materialise(each.select("id", "key", "bare", F.coalesce("component", "node").alias("class"), "m"), "near-each")
    sizes = each.groupBy(F.col("bare").alias("b"), F.col("class").alias("c")).agg(F.sum("m").alias("class_size"), F.min(F.struct("id", "key")).alias("first"))
    # Documents that are alone need no partner; the others meet one row a class.
    sizes = small(materialise(sizes.where("class_size > 1"), "near-class-sizes"))
    full = each.join(sizes, (F.col("class") == F.col("c")) & (F.col("bare") == F.col("b")), "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    mine = F.col("c").isNull() | ((F.col("id") == F.col("first.id")) & (F.col("key") == F.col("first.key")))
    class_id = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("first.id"))
    full = full.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (mine & (F.col("k") == 1)).alias("kept"), "key")
    nameless = signed.where("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "key")
    return full.unionByName(nameless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document :func:`near_dedup` keeps, with their own columns.

    Ids of which nothing is kept are left out by a list; texts that share an id with one that is
    kept are told apart by their key.
    """
    found = _decided(docs, id_col, text_col).where("doc_id is not null")
    the_id, the_key, of = fresh(docs, "id", "key", "of")
    some = found.groupBy("doc_id").agg(F.max("kept").alias("any"), F.min("kept").alias("all")).where("not all").select(F.col("doc_id").alias(the_id), "any")
    some = materialise(some, "near-dropped")
    same = lambda other: docs[id_col].cast("long") == other[the_id]
    dropped = small(some.where("not any").select(the_id))
    out = docs.join(dropped, same(dropped), "left_anti")
    partly = some.where("any").select(F.col(the_id).alias("partly"))
    texts = found.join(partly, F.col("doc_id") == F.col("partly"), "left_semi").groupBy("doc_id", "key").agg(F.max("kept").alias("kept")).where("not kept")
    texts = materialise(texts.select(F.col("doc_id").alias(the_id), F.col("key").alias(the_key)), "near-dropped-texts")
    if texts.isEmpty():
        return out
    ids = small(materialise(texts.select(the_id).distinct(), "near-dropped-ids"))
    rest = out.join(ids, same(ids), "left_semi").withColumn(of, F.pandas_udf(_key_of, "binary")(docs[text_col].cast("string")))
    rest = rest.join(texts, (rest[id_col].cast("long") == texts[the_id]) & (rest[of] == texts[the_key]), "left_anti")
    return out.join(ids, same(ids), "left_anti").unionByName(rest.select(*map(quoted, docs.columns)))
