"""Toxicity by a classifier chain: later categories see the probabilities of earlier ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, give_back, quoted, uses_cache
from tracewell.llm.linear import BITS, labelled_features, sigmoid, train, with_bias, word_features

#: Labelled documents that the chain is fitted on at most, passes over them, and folds.
TRAIN_ROWS, EPOCHS, FOLDS = 6_000, 5, 5
#: FTRL options of each link. Words are many and few of them tell, so the L1 weight is large; toxic
#: texts are few, so a row of a category counts three times.
OPTIONS = {"alpha": 1.0, "l1": 10.0, "positive": 3.0}
THRESHOLD, MOST_BIAS = 0.5, -0.01


def categories() -> dict[str, Column]:
    """The chain's categories in order, as the label table marks them; the last one decides."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def fit_link(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], extra: int) -> np.ndarray:
    """Weights of one link. Without rows of both classes there is nothing to tell them by, and the
    link's probability is 0 for every text. The bias is kept below 0: with few labels, most of them
    positive, a text in which nothing tells is not in the category."""
    if len(set(y)) < 2:
        weights = np.zeros((1 << BITS) + 1 + extra)
        weights[1 << BITS] = -40.0
        return weights
    weights = train(rows, y, EPOCHS, extra=extra, **OPTIONS)
    weights[1 << BITS] = min(weights[1 << BITS], MOST_BIAS)
    return weights


def fit_chain(found: list[tuple[np.ndarray, np.ndarray]], labels: list[tuple]) -> list[np.ndarray]:
    """Weights of each link of the chain.

    Link ``k`` is a linear model over a text's words and the probabilities of links 0 to ``k-1``.
    In training these come from models that haven't seen the row (its fold is left out), as they
    will when texts are new; the links themselves are then fitted on all rows. Rows come in hash
    order, so every ``FOLDS``-th row makes a fold.
    """
    folds = np.arange(len(found)) % FOLDS
    earlier = np.zeros((len(found), 0))
    chain = []
    for k in range(len(labels[0]) if labels else 0):
        y = [v[k] for v in labels]
        rows = [with_bias(i, x, extra=p) for (i, x), p in zip(found, earlier, strict=True)]
        chain.append(fit_link(rows, y, k).astype("float32"))
        if k + 1 < len(labels[0]):
            out = np.zeros(len(rows))
            for fold in range(FOLDS):
                seen = [j for j in range(len(rows)) if folds[j] != fold]
                w = fit_link([rows[j] for j in seen], [y[j] for j in seen], k)
                for j in np.flatnonzero(folds == fold):
                    out[j] = sigmoid(w[rows[j][0]] @ rows[j][1])
            earlier = np.column_stack([earlier, out])
    return chain


def chain_scores(chain: list[np.ndarray], text: str | None) -> list[float]:
    i, x = word_features(text)
    p: list[float] = []
    for w in chain:
        s, v = with_bias(i, x, extra=np.array(p))
        p.append(float(sigmoid(w[s].astype(float) @ v)))
    return p


def _score(chain, names: list[str], carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses_cache("hashes")
        for batch in batches:
            p = [chain_scores(chain.value, t.as_py()) if chain.value else [0.0] * len(names) for t in batch.column(0)]
            columns = [pa.array([x[k] for x in p], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: carry + 1], *columns], names=[*batch.schema.names[: carry + 1], *names])

    return run


def with_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """The rows of ``docs`` with a probability for each category, ``p_<category>``, after them.

    The chain is fitted on a bounded sample of labelled documents that come first by the MD5 of
    their ids. Features are the distinct words of the whole text and their beginnings, hashed;
    weights (1 MB a link) are broadcast and scoring shuffles nothing.

    Null text is empty and is scored by the biases alone. Null ids and repeated rows are scored as
    they are. Without labels, or with labels of one class only, a category's probability is 0. Empty
    tables give empty results. Columns of ``docs`` may have any names but those of the
    probabilities; such a column is replaced.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = categories()
    known = labels.select(F.col(id_col).cast("long").alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(marks.values())])
    found, y = labelled_features(texts, known, word_features, TRAIN_ROWS)
    chain = docs.sparkSession.sparkContext.broadcast(fit_chain(found, y))
    del found
    give_back()
    names = [prefix + c for c in marks]
    kept = [c for c in docs.columns if c not in names]
    (text,) = fresh(docs, "text_to_score")
    rows = docs.select(F.col(quoted(text_col)).cast("string").alias(text), *map(quoted, kept))
    shape = f"{quoted(text)} string, " + "".join(f"{quoted(f.name)} {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept) + ", ".join(f"{quoted(n)} double" for n in names)
    return rows.mapInArrow(_score(chain, names, len(kept)), shape).drop(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the categories' probabilities and ``toxic`` (the last one is ``threshold`` or more)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_toxicity(rows, labels.withColumnRenamed(id_col, "doc_id"))
    return scored.select("doc_id", *[c for c in scored.columns if c.startswith("p_")], (F.col("p_toxic") >= threshold).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with their own columns, whatever their names."""
    prefix = "p_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return with_toxicity(docs, labels, prefix=prefix).where(F.col(prefix + "toxic") < threshold).select(*map(quoted, docs.columns))
