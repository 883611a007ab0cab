"""Hashed text features and logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import keeps_cache, uses_cache

#: Log of the number of feature slots, fixed whatever the corpus.
BITS = 18
#: Hashes that a worker keeps of tokens already seen.
CACHE_TOKENS = 300_000
_WORDS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = (np.uint64(0xA5A5), np.uint64(0x5A5A))


class _Cache(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_TOKENS:
            self.clear()
        self[token] = out = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return out


_HASH = _Cache()
keeps_cache("hashes", _HASH.clear)


def token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def ngram_features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's word 1-grams and 2-grams.

    Words are runs of word characters, and of other visible characters; case counts. Two slots are
    for 2-grams that repeat a word (next to itself, or with one word between), whichever word. The
    counts of each order are scaled to length 1. An empty text has no features.
    """
    h = token_hashes(_TOKENS.findall(text or ""))
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.float64)
    slots, values = [], []
    same = [r for gap, r in zip((1, 2), _REPEAT, strict=True) for _ in range(int((h[gap:] == h[:-gap]).sum()))]
    with np.errstate(over="ignore"):
        two = (h[:-1] * np.uint64(31) + h[1:]) ^ np.uint64(0x2545F4914F6CDD1D)
    for grams in (h, np.concatenate([two, np.array(same, np.uint64)])):
        if len(grams):
            s, c = np.unique(_slots(grams, bits), return_counts=True)
            slots.append(s)
            values.append(c / np.sqrt((c * c).sum()))
    return np.concatenate(slots), np.concatenate(values)


def word_features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct words (letters only, lower case) of a text and of their first 4 and 5
    letters, with the value 1 each.

    Presence doesn't thin out with length, so a few words tell in a very long text too; beginnings
    stand for inflected forms that the labelled texts don't hold.
    """
    words = set(_WORDS.findall((text or "").lower()))
    h = token_hashes([*words, *{w[:4] + "^" for w in words if len(w) > 4}, *{w[:5] + "^" for w in words if len(w) > 5}])
    s = np.unique(_slots(h, bits))
    return s, np.ones(len(s))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class Ftrl:
    """Logistic regression with per-coordinate FTRL-proximal updates; slot ``2**bits`` is the bias,
    which the L1 weight leaves alone, and ``extra`` further dense slots follow it."""

    def __init__(self, bits: int = BITS, extra: int = 0, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-3) -> None:
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.bias = 1 << bits
        self.l1 = np.full(self.bias + 1 + extra, l1)
        self.l1[self.bias] = 0.0
        self.z, self.n = np.zeros(self.bias + 1 + extra), np.zeros(self.bias + 1 + extra)

    def _at(self, i: np.ndarray) -> np.ndarray:
        z, l1 = self.z[i], self.l1[i]
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, i: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self._at(i)
        g = weight * (sigmoid(w @ x) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def weights(self) -> np.ndarray:
        return self._at(np.arange(len(self.z)))


def with_bias(slots: np.ndarray, values: np.ndarray, bits: int = BITS, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features with the bias, and with dense extra features in the slots after it."""
    tail = np.ones(1, np.float32) if extra is None else np.concatenate([np.ones(1), extra]).astype(np.float32)
    places = (1 << bits) + np.arange(len(tail), dtype=np.int32)
    return np.concatenate([slots.astype(np.int32), places]), np.concatenate([values.astype(np.float32), tail])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels, epochs: int, positive: float = 1.0, **options) -> np.ndarray:
    """Weights after ``epochs`` passes over ``rows`` (bias included) in the order given; a row with
    label 1 counts ``positive`` times."""
    model = Ftrl(**options)
    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            model.update(i, x, float(y), positive if y else 1.0)
    return model.weights()


def pack_features(slots: np.ndarray, values: np.ndarray) -> bytes:
    return slots.astype("<i4").tobytes() + values.astype("<f4").tobytes()


def unpack_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 8
    return np.frombuffer(data, "<i4", n), np.frombuffer(data, "<f4", n, 4 * n)


def labelled_features(docs: DataFrame, labels: DataFrame, features: Callable, rows: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple]]:
    """Features and labels of at most ``rows`` labelled documents, in the order of their ids' MD5.

    ``docs`` has ``id`` and ``text``; ``labels`` has ``id`` and label columns. Ids are drawn
    first, so only the texts of the sample are turned into features and come to the driver, as
    sparse vectors. Of rows that repeat an id, the greatest labels and the least text count.
    """
    names = [c for c in labels.columns if c != "id"]
    known = labels.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(c).alias(c) for c in names]).dropna()
    sample = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(rows)
    texts = docs.join(F.broadcast(sample), "id").groupBy("id", *names).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses_cache("hashes")
        for batch in batches:
            data = [pack_features(*features(t.as_py())) for t in batch.column(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 1], pa.array(data, pa.binary())], names=["id", *names, "data"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]) + ", data binary"
    found = texts.mapInArrow(run, shape).collect()
    found.sort(key=lambda r: (hashlib.md5(str(r["id"]).encode()).hexdigest(), r["id"]))
    return [unpack_features(r["data"]) for r in found], [tuple(r[c] for c in names) for r in found]
