"""Exact deduplication by 128-bit content hash, with a comparison of bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, leaves_nothing, materialise, quoted, small

#: The characters that count for nothing: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """``text`` without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:  # byte searches, several times faster than a look at each character
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


@leaves_nothing("exact-result")
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Which of equal texts stays, for each row of ``docs``.

    Texts are equal if they are identical without blanks. Of equal texts the longest original (in
    code points) stays, then the smallest id. Result: ``doc_id, keep_id, group_size, kept,
    text_sha256``, one row per row of ``docs``.

    Only hashes and ids are shuffled for all rows. Texts move for rows that share a hash with
    another row, and of those each task sends two texts a hash at most (the least and the greatest
    one, which are equal bytes unless the hash collided). Rows of a collided hash are grouped by
    the text itself.

    Null text is empty, and empty texts equal each other. A null id sorts last, and such a row is
    never preferred to one with an id. Of rows that repeat id and text one is kept. An empty table
    gives an empty result; other columns of ``docs`` don't matter, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    base = base.select("id", F.length("raw").alias("n"), normalised(F.col("raw")).alias("norm"))
    base = base.withColumn("h", content_hash(F.col("norm")))
    # Repeated rows become one with a count, so that exactly one of them can be kept.
    keys = base.select("h", "id", "n", F.unhex(F.sha2("norm", 256)).alias("sha")).groupBy("h", "id", "n", "sha").agg(F.count("*").alias("m"))
    keys = materialise(keys, "exact-keys")
    shared = materialise(keys.groupBy("h").agg(F.sum("m").alias("c")).where("c > 1").select("h"), "exact-shared")
    hit = small(shared)
    texts = base.select("h", "norm").join(hit, "h", "left_semi")
    collided = materialise(texts.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("h"), "exact-collided")
    if collided.isEmpty():
        keys = keys.withColumn("g", F.col("h"))
    else:
        # A hash that stands for several texts: its rows get a key for each text, the text itself.
        bad = base.join(small(collided), "h", "left_semi").groupBy("h", "id", "n", "norm").agg(F.count("*").alias("m"))
        bad = bad.select("h", "id", "n", F.unhex(F.sha2("norm", 256)).alias("sha"), "m", F.concat("h", F.lit(":"), "norm").alias("g"))
        keys = keys.join(small(collided), "h", "left_anti").withColumn("g", F.col("h")).unionByName(bad)
    # The greatest of (length, id known, id from the smallest) by group; partial aggregates meet a hot group's rows first.
    best = F.max(F.struct("n", F.col("id").isNotNull().alias("known"), F.bitwise_not(F.col("id")).alias("neg"))).alias("best")
    groups = materialise(keys.groupBy("g").agg(best, F.sum("m").alias("group_size")).where("group_size > 1"), "exact-groups")
    # A row that is alone with its text needs no partner; the others meet one row a group, which is
    # broadcast if there are few groups, so that a hot group's rows stay where they are.
    joined = keys.join(small(groups), "g", "left").withColumn("alone", F.col("group_size").isNull())
    keep_id = F.when(F.col("alone"), F.col("id")).otherwise(F.bitwise_not(F.col("best.neg")))
    joined = joined.select("id", "sha", "m", "n", "alone", F.coalesce("group_size", F.lit(1)).alias("group_size"), keep_id.alias("keep_id"), F.col("best.n").alias("keep_n"))
    mine = F.col("alone") | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n")))
    rows = joined.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return rows.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (mine & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their own columns.

    Rows whose id occurs once are kept by leaving the dropped ids out, a list that is broadcast
    only if a count proves it small. Rows that share an id are told apart by text.
    """
    decided = exact_dedup(docs, id_col, text_col)
    the_id, sha, k, kept_sha = fresh(docs, "id", "sha", "k", "kept_sha")
    many = materialise(decided.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(the_id)), "exact-many")
    same = lambda other: docs[id_col].cast("long").eqNullSafe(other[the_id])
    dropped = materialise(decided.where("not kept").select(F.col("doc_id").alias(the_id)).distinct(), "exact-dropped")
    dropped = small(dropped)
    out = docs.join(dropped, same(dropped), "left_anti")
    if many.isEmpty():
        return out
    many = small(many)
    rest = docs.join(many, same(many), "left_semi").withColumn(sha, F.sha2(normalised(docs[text_col]), 256))
    order = Window.partitionBy(quoted(id_col), sha).orderBy(F.length(quoted(text_col)).desc_nulls_last(), quoted(text_col))
    rest = rest.withColumn(k, F.row_number().over(order)).where(F.col(k) == 1)
    kept = decided.where("kept").select(F.col("doc_id").alias(the_id), F.col("text_sha256").alias(kept_sha))
    rest = rest.join(kept, rest[id_col].cast("long").eqNullSafe(kept[the_id]) & (rest[sha] == kept[kept_sha]), "left_semi")
    return out.join(many, same(many), "left_anti").unionByName(rest.select(*map(quoted, docs.columns)))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
