"""Text quality by hashed word n-gram logistic regression trained with FTRL updates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import uses_cache
from tracewell.llm.linear import labelled_features, ngram_features, sigmoid, train, with_bias

#: Labelled documents that the model is fitted on at most, and passes over them.
TRAIN_ROWS, EPOCHS = 6_000, 3
OUT = "doc_id long, score double, predicted int"


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learnt from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS, epochs: int = EPOCHS):
    """Weights from at most ``rows`` labelled documents that aren't held out, or None without any."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.where(~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    found, y = labelled_features(texts, known, ngram_features, rows)
    return train([with_bias(*f) for f in found], [v[0] for v in y], epochs).astype("float32") if found else None


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses_cache("hashes")
        w = weights.value
        for batch in batches:
            scores = []
            for text in batch.column(1):
                i, x = with_bias(*ngram_features(text.as_py()))
                scores.append(0.5 if w is None else float(sigmoid(w[i].astype(float) @ x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every row of ``docs``: ``doc_id, held_out, score, predicted``.

    The model sees the text alone: counts of hashed word 1-grams and 2-grams over the whole text.
    It is fitted on a bounded sample of labelled documents; its 2**18 weights (1 MB) are broadcast
    and a score is one sparse dot product, so scoring shuffles nothing.

    Null text is empty and gets the score of the bias alone; a null id isn't held out; rows that
    repeat get a score each. Without any labels every score is 0.5. An empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(weights), OUT)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
