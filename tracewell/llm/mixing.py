"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the words and a schedule of relative weight over training time 0 to 1.
The integral of the schedule, times the source's target, is its cumulative demand; the inverse of
the demand at a document's place within its source is the document's training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, leaves_nothing, materialise, quoted, small

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix for each word of the input, and how often a text may be used at most.
SHARE, REPEATS = 1.5, 2
#: Schedules by the same turn as the weights: (time, relative weight) knots, linear in between.
#: A schedule is scaled to the integral 1, so it moves a source in time and keeps its target.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)),
)
#: Rows of a source that one task orders, about.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """(start, end, weight at the start, weight at the end, integral before) of a scaled schedule."""
    area = sum((t1 - t0) * (g0 + g1) / 2 for (t0, g0), (t1, g1) in zip(knots, knots[1:], strict=False))
    if knots[0][0] != 0.0 or knots[-1][0] != 1.0 or area <= 0 or min(g for _, g in knots) < 0:
        raise ValueError("a schedule runs from 0 to 1, isn't negative and has a positive integral")
    out, done = [], 0.0
    for (t0, g0), (t1, g1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, g0 / area, g1 / area, done))
        done += (t1 - t0) * (g0 + g1) / 2 / area
    return out


def invert(q: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral reaches ``q`` (0 to 1): a quadratic in each segment."""
    out = F.lit(1.0)
    for t0, t1, g0, g1, before in reversed(segments(knots)):
        slope = (g1 - g0) / (t1 - t0)
        rest = F.greatest(q - F.lit(before), F.lit(0.0))
        # g0 x + slope x^2 / 2 = rest, in the form that is stable for small slopes.
        root = F.sqrt(F.greatest(F.lit(g0 * g0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        x = F.coalesce(F.try_divide(F.lit(2.0) * rest, F.lit(g0) + root), F.lit(0.0))
        end = before + (t1 - t0) * (g0 + g1) / 2
        out = F.when(q < F.lit(end), F.lit(t0) + F.least(x, F.lit(t1 - t0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Targets from a table ``source, source_size`` (one row per source).

    ``share`` of all words is divided by weight; a target stops at ``repeats`` times its source's
    size and the excess is divided again by weight. In order of cap over weight this needs one
    pass: a source is capped if its cap over its weight is at most the level that is left.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("turn", turn.cast("int"))
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1)).withColumn("cap", F.col("source_size") * float(repeats))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("want", F.sum("source_size").over(everything) * F.lit(share))
    left = F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", F.greatest(left, F.lit(0.0)) / F.sum("w").over(after))
    rows = rows.withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
    # The first source that isn't capped has the level of all the rest.
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    rows = rows.withColumn("water", water)
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("w")))
    return rows.select("source", "source_size", "turn", target.cast("double").alias("target"))


@leaves_nothing("mix-plan")
def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """How many words the mix takes of each document, and when.

    Within a source, documents come in the order of the MD5 of their ids (ties by id, then size),
    pass after pass, until the floor of the source's target is reached; the last one is taken in
    part. So a source takes its target to the word, and no document more than ``repeats`` times
    its size. ``taken`` doesn't depend on layout or run.

    Result: ``doc_id, size, source_size, target, taken`` and ``source``, ``offset`` (words of the
    source before the document in its order) and ``position`` (training time of the first use, 0
    to 1, null if unused). One row per row of ``docs``.

    Places in a source come from two sums: over buckets of hash order (about ``bucket_rows`` rows
    each, from counted rows), then within a bucket. No task orders a whole source, however large.

    Null text has size 0; a null source is a source of its own; null ids come first in their
    source. Rows that repeat are used one after another. Empty tables give empty results.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialise(rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = materialise(sizes, "mix-sources")
    goals = source_targets(sizes.select("source", "source_size"), weights, share, repeats)
    goals = materialise(goals.alias("g").join(sizes.select(F.col("source").alias("s"), "n"), F.col("g.source").eqNullSafe(F.col("s"))).drop("s"), "mix-goals")
    share_of = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    keyed = rows.alias("r").join(goals.withColumnRenamed("source", "s"), F.col("r.source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("bucket", F.floor(share_of * F.ceil(F.col("n") / F.lit(bucket_rows))).cast("long"))
    heap = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    starts = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(heap), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("offset", F.col("start") + F.col("inside"))
    goal = F.floor("target").cast("long")
    taken = F.lit(0).cast("long")
    for p in range(repeats):
        left = goal - F.col("source_size") * F.lit(p) - F.col("offset")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    position = _position(F.col("offset"), len(weights), schedules)
    out = placed.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, position))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "offset", "position", "turn")


def _position(offset: Column, turns: int, schedules) -> Column:
    """Training time at which a source (with ``target`` and ``turn``) has yielded ``offset`` words."""
    place = F.least(F.coalesce(F.try_divide(offset.cast("double"), F.col("target")), F.lit(0.0)), F.lit(1.0))
    out = F.lit(None).cast("double")
    for k in range(turns):
        out = F.when(F.col("turn") == k, invert(place, schedules[k % len(schedules)])).otherwise(out)
    return out


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES,
) -> DataFrame:
    """The mix itself: a row of ``docs`` for each use of a document, range-sorted by training position.

    A document that is used twice comes twice. The last use of a source may be a part of its
    document: its first words, parted by single spaces, with ``chars_col`` counted anew. Documents
    that aren't used don't come; those without words never do. Rows of equal id, source and size
    are told apart by the order of their texts; only such rows are numbered, all others meet
    their places by these three alone.
    """
    plan = mix(docs, id_col, text_col, source_col, weights, share, repeats, schedules).where("size > 0")
    alike = ["doc_id", "source", "size"]
    the_id, of, size, k, *use = fresh(docs, "id", "of", "size", "k", "use_id", "use_of", "use_size", "use_k", "use_turn", "use_words", "use_position")
    own = dict(zip(use, (the_id, of, size, k), strict=False))
    turn, words, position = use[4:]
    goal = F.floor("target").cast("long")
    uses = plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    uses = uses.withColumn("words", F.least(goal - F.col("source_size") * F.col("pass") - F.col("offset"), F.col("size"))).where("words > 0")
    uses = uses.withColumn("at", _position(F.col("offset") + F.col("source_size") * F.col("pass"), len(weights), schedules))
    uses = uses.withColumn("k", F.dense_rank().over(Window.partitionBy(*alike).orderBy("offset")))
    uses = uses.select(*[F.col(c).alias(name) for c, name in zip((*alike, "k", "pass", "words", "at"), use, strict=True)])
    several = plan.groupBy(*alike).agg(F.count("*").alias("c")).where("c > 1")
    several = materialise(several.select(*[F.col(c).alias(name) for c, name in zip(alike, use, strict=False)]), "mix-several")

    rows = docs.withColumns({the_id: F.col(quoted(id_col)).cast("long"), of: F.col(quoted(source_col)).cast("string"), size: word_count(F.col(quoted(text_col)))}).where(F.col(size) > 0)
    meet = lambda left, right, names: _all(left[own[c]].eqNullSafe(right[c]) for c in names)
    if several.isEmpty():
        rows = rows.withColumn(k, F.lit(1))
    else:
        told = small(several)
        order = Window.partitionBy(the_id, of, size).orderBy(quoted(text_col))
        numbered = rows.join(told, meet(rows, told, several.columns), "left_semi").withColumn(k, F.row_number().over(order))
        rows = rows.join(told, meet(rows, told, several.columns), "left_anti").withColumn(k, F.lit(1)).unionByName(numbered)
    out = rows.join(uses, meet(rows, uses, own))
    text = F.col(quoted(text_col))
    part = F.col(words) < F.col(size)
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col(words).cast("int")))
    out = out.withColumn(text_col, F.when(part, first).otherwise(text))
    if chars_col and chars_col in docs.columns:
        chars = F.col(quoted(chars_col))
        out = out.withColumn(chars_col, F.when(part, F.length(text).cast(docs.schema[chars_col].dataType)).otherwise(chars))
    return out.orderBy(position, F.md5(F.col(the_id).cast("string")), turn).select(*map(quoted, docs.columns))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def in_training_order(plan: DataFrame) -> DataFrame:
    """The rows of :func:`mix` range-sorted by training position; unused rows come last."""
    return plan.orderBy(F.col("position").asc_nulls_last(), F.md5(F.col("doc_id").cast("string")), "doc_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][turn + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, turn
  FROM (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS turn FROM s)
), c AS (
  SELECT *, cap / w AS ratio FROM w
), l AS (
  SELECT a.source, a.ratio,
         greatest(1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(b.cap) FROM c b WHERE b.ratio < a.ratio OR (b.ratio = a.ratio AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))), 0), 0)
         / (SELECT sum(b.w) FROM c b WHERE NOT (b.ratio < a.ratio OR (b.ratio = a.ratio AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL))))) AS level
  FROM c a
), v AS (
  SELECT arg_min(level, ratio) AS water FROM l WHERE ratio > level
), g AS (
  SELECT source, source_size, turn, CASE WHEN (SELECT water FROM v) IS NULL THEN cap ELSE least(cap, (SELECT water FROM v) * w) END AS target FROM c
), o AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.turn,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken, CASE WHEN taken > 0 THEN round(CASE
    WHEN q >= 1 THEN 1
    WHEN turn = 0 THEN 2 * q / (1.5 + sqrt(2.25 - 2 * q))
    WHEN turn = 1 THEN 2 * q / (0.5 + sqrt(0.25 + 2 * q))
    WHEN q < 0.5 THEN 2 * q / (0.75 + sqrt(0.5625 + 2 * q))
    ELSE 0.5 + 2 * (q - 0.5) / (1.25 + sqrt(1.5625 - 2 * (q - 0.5))) END, 6) END AS position
FROM (SELECT *, (greatest(0, least(floor(target)::BIGINT - before, size)) + greatest(0, least(floor(target)::BIGINT - source_size - before, size)))::BIGINT AS taken,
             CASE WHEN target = 0 THEN 0.0::DOUBLE ELSE before / target END AS q FROM o)
"""
