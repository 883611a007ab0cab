"""Recall: which work objects a question brings back, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.functions import text as T
from tracewell.functions import vector as V
from tracewell.operators import graph
from tracewell.sources.shared import written


def not_own_session(rows: DataFrame, session: str | None) -> DataFrame:
    """Work objects that a session didn't contribute to; a null map counts as no contribution."""
    if not session:
        return rows
    return rows.where(~F.coalesce(F.map_contains_key("source_strands", F.lit(session)), F.lit(False)))


def in_range(questions: DataFrame, realities: DataFrame, config: Config = Config()) -> DataFrame:
    """The nearest work objects within the range: ``q, reality_id, d, rank``.

    ``questions`` has ``q, qv``; ``realities`` has ``reality_id, query_centroid``. The questions are the
    stated set; work objects are read once.
    """
    have = realities.where("query_centroid is not null").select("reality_id", "query_centroid")
    pairs = V.nearest(have, "reality_id", "query_centroid", questions, "q", "qv", config.recall_candidates, 1 - config.theta_max)
    pairs = pairs.select("q", "reality_id", F.round(1 - F.col("c"), 9).alias("d")).where(F.col("d") <= config.theta_max)
    order = Window.partitionBy("q").orderBy("d", "reality_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.recall_candidates)


def lexical(questions: DataFrame, realities: DataFrame, config: Config = Config(), most: int = V.BROADCAST_COMPONENTS) -> DataFrame:
    """Without vectors: distance by shared character pairs with name or headline: ``q, reality_id, d, rank``.

    The questions are a stated set, and every object has a distance to each. Equal ones are a class: classes of
    questions meet classes of objects, and of a class of objects those of the least ids stand for all. Classes of questions are broadcast if
    their pairs (summed first) are few; else blocks of them meet parts of the objects.
    """
    cls = lambda *texts: F.md5(F.to_json(F.array(*texts)))
    q = questions.select("q", "text", cls(F.col("text")).alias("_q"))
    r = realities.select("reality_id", "name", "hdl", cls(F.col("name"), F.col("hdl")).alias("_r"))
    both = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), T.jaccard(a, b)).otherwise(0.0)
    q_classes = q.groupBy("_q").agg(F.first("text").alias("text")).select("_q", T.character_pairs(F.col("text")).alias("qp"))
    r_classes = r.groupBy("_r").agg(F.first("name").alias("name"), F.first("hdl").alias("hdl")).select("_r", T.character_pairs(F.col("name")).alias("np"), T.character_pairs(F.col("hdl")).alias("hp"))
    parts = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r_classes = written(r_classes.repartition(parts), "recall-classes").repartition(parts)  # few rows, but each costs much
    pairs = V.beside(r_classes, "_r", q_classes, "_q", F.size("qp") + 1, most=most)
    pairs = pairs.select("_q", "_r", F.round(1 - F.greatest(both(F.col("qp"), F.col("np")), both(F.col("qp"), F.col("hp"))), 9).alias("d"))
    first = lambda df, order: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.recall_candidates)
    members = first(r.select("_r", "reality_id"), Window.partitionBy("_r").orderBy("reality_id")).drop("rank")
    best = first(pairs.join(members, "_r"), Window.partitionBy("_q").orderBy("d", "reality_id"))
    return q.select("q", "_q").join(best, "_q").select("q", "reality_id", "d", "rank")


def recall(questions: DataFrame, realities: DataFrame, links: DataFrame, decisions: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """The work objects that go with each question: ``q, reality_id, rank``.

    In range, nearest first, then their neighbours in the graph; a question's decisions pick among
    them (in this order), and without any the first few stay. Nothing in range: nothing. Questions
    without a vector, or a store without question centroids, fall back to shared character pairs.
    """
    usable = realities.where("query_centroid is not null").limit(1).count() > 0
    with_vec = questions.where("qv is not null") if usable else questions.where("false")
    budget = in_range(with_vec, realities, config).select("q", "reality_id", "rank")
    extra = graph.neighbours(links, budget.select("q", "reality_id"), realities.select("reality_id"), config.recall_neighbours)
    extra = extra.select("q", "reality_id", (F.col("pos") + config.recall_candidates + 1).alias("rank"))
    plain = lexical(questions.join(with_vec.select("q"), "q", "left_anti"), realities, config).select("q", "reality_id", "rank")
    pool = budget.unionByName(extra).unionByName(plain)
    if decisions is not None:
        decided = decisions.select("q").distinct().withColumn("decided", F.lit(True))
        pool = pool.join(decided, "q", "left").join(decisions.select("q", "reality_id").withColumn("picked", F.lit(True)), ["q", "reality_id"], "left")
        pool = pool.where("decided is null or picked").drop("decided", "picked")
    order = Window.partitionBy("q").orderBy("rank", "reality_id")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.recall_final)


def question_clouds(strands: DataFrame, mapping: DataFrame, vectors: DataFrame, distinct: bool = True) -> DataFrame:
    """Mean question vector of each work object: ``reality_id, mean, n``. ``strands`` has ``strand_id,
    query_text``; ``vectors`` has ``text, vec``. Questions of less than four characters don't count, and
    equal ones count once unless ``distinct`` is off."""
    asked = strands.join(mapping, "strand_id").select("reality_id", F.left(F.trim("query_text"), F.lit(500)).alias("text")).where(F.length("text") >= 4)
    asked = asked.distinct() if distinct else asked
    return V.means(asked.join(vectors.dropDuplicates(["text"]), "text"), ["reality_id"], "vec")


def inject_log(blocks: DataFrame, clouds: DataFrame, k: int = 3) -> DataFrame:
    """For each block's first question, the nearest clouds: ``session_id, topic_id, picked, empty``.
    ``blocks`` has ``session_id, topic_id, vec``."""
    pairs = V.meet(blocks, "vec", clouds, "mean").select("session_id", "topic_id", "reality_id", F.round(V.cosine(F.col("vec"), F.col("mean")), 9).alias("c")).where("c > 0")
    order = Window.partitionBy("session_id", "topic_id").orderBy(F.col("c").desc(), "reality_id")
    best = pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    best = best.groupBy("session_id", "topic_id").agg(F.array_sort(F.collect_list(F.struct("k", "reality_id"))).alias("p"))
    out = blocks.select("session_id", "topic_id").distinct().join(best, ["session_id", "topic_id"], "left")
    picked = F.coalesce(F.transform("p", lambda s: s["reality_id"]), F.expr("cast(array() as array<bigint>)"))
    return out.select("session_id", "topic_id", picked.alias("picked"), (F.size(picked) == 0).alias("empty"))


def themes_for(questions: DataFrame, themes: DataFrame, decisions: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Themes for each question: none of too small a cosine, then the decisions' picks or the first few."""
    if decisions is None:
        pairs = V.nearest(themes, "theme_id", "centroid", questions, "q", "qv", config.recall_final, config.negative_cosine).withColumn("c", F.round("c", 9))
    else:
        pairs = V.meet(themes.where("centroid is not null"), "centroid", questions.where("qv is not null").select("q", "qv"), "qv")
        pairs = pairs.select("q", "theme_id", F.round(V.cosine(F.col("qv"), F.col("centroid")), 9).alias("c"))
    pairs = pairs.where(F.col("c") >= config.negative_cosine)
    if decisions is not None:
        decided = decisions.select("q").distinct().withColumn("decided", F.lit(True))
        pairs = pairs.join(decided, "q", "left").join(decisions.select("q", "theme_id").withColumn("picked", F.lit(True)), ["q", "theme_id"], "left").where("decided is null or picked")
    order = Window.partitionBy("q").orderBy(F.col("c").desc(), "theme_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.recall_final).select("q", "theme_id", "c", "rank")
