"""Upkeep of work objects: health, dead sources, governance of document roots, audit and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def health(sources: Column, updated_at: Column, now: Column, has_vector: Column, has_content: Column) -> Column:
    """A score from 0 to 1: more sources, a recent update, a vector and contents make it greater."""
    days = (now - updated_at) / DAY
    by_source = F.when(sources >= 3, 1.0).when(sources == 2, 0.9).when(sources == 1, 0.7).otherwise(0.3)
    by_age = F.when((updated_at > 0) & (days > 90), 0.6).when((updated_at > 0) & (days > 30), 0.8).otherwise(1.0)
    score = by_source * by_age * F.when(has_vector, 1.0).otherwise(0.5) * F.when(has_content, 1.0).otherwise(0.3)
    return F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 3)


def score_realities(realities: DataFrame, mapping: DataFrame, now: float, flag_below: float = 0.3) -> DataFrame:
    """``reality_id, health_score, flagged, topic_count``."""
    counts = mapping.groupBy("reality_id").agg(F.count("*").alias("topic_count"))
    changes = F.exists(F.coalesce("timeline", F.expr("cast(array() as array<struct<changes:array<string>>>)")), lambda e: F.size(F.coalesce(e["changes"], F.expr("cast(array() as array<string>)"))) > 0)
    facts = F.size(F.coalesce(F.col("current_status.key_facts"), F.expr("cast(array() as array<string>)"))) > 0
    score = health(F.coalesce(F.size("source_strands"), F.lit(0)), F.coalesce("updated_at", F.lit(0.0)), F.lit(now), F.coalesce(F.size("centroid") > 0, F.lit(False)), changes | facts)
    rows = realities.join(counts, "reality_id", "left").withColumn("health_score", score)
    return rows.select("reality_id", "health_score", (F.col("health_score") < flag_below).alias("flagged"), F.coalesce("topic_count", F.lit(0)).alias("topic_count"))


def drop_dead_sources(realities: DataFrame, sessions: DataFrame) -> DataFrame:
    """Work objects whose source map names live sessions only; a missing map becomes an empty one."""
    parts = realities.where("source_strands is not null").select("reality_id", F.explode("source_strands").alias("session_id", "ids"))
    live = parts.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    maps = live.groupBy("reality_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("session_id", "ids")))).alias("_map"))
    empty = F.expr("cast(map() as map<string,array<bigint>>)")
    return realities.join(maps, "reality_id", "left").withColumn("source_strands", F.coalesce("_map", empty)).drop("_map")


def candidates(realities: DataFrame, active: DataFrame, n: int) -> DataFrame:
    """The ``n`` least recently updated objects, then without those of active sessions (in this order)."""
    oldest = realities.orderBy("updated_at", "reality_id").limit(n)
    busy = oldest.where("source_strands is not null").select("reality_id", F.explode(F.map_keys("source_strands")).alias("session_id")).join(active.select("session_id"), "session_id", "left_semi")
    return oldest.join(busy.select("reality_id").distinct(), "reality_id", "left_anti")


def write_back(realities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Objects after a refinement: facts and goals replaced where the decision has some; its changes
    (``changes``, if given) become an entry of their own at the end of the timeline."""
    more = [F.col("changes").alias("_changes")] if "changes" in decisions.columns else []
    d = decisions.select("reality_id", F.col("key_facts").alias("_facts"), F.col("open_items").alias("_goals"), *more)
    status = F.col("current_status")
    some = lambda c: F.size(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))) > 0
    new = status.withField("key_facts", F.when(some("_facts"), F.col("_facts")).otherwise(status["key_facts"])).withField("goals", F.when(some("_goals"), F.col("_goals")).otherwise(status["goals"]))
    out = realities.join(d, "reality_id", "left").withColumn("current_status", new)
    if more and "timeline" in realities.columns:
        kind = realities.schema["timeline"].dataType
        names = kind.elementType.fieldNames()
        before = F.coalesce("timeline", F.lit(None).cast(kind), F.array().cast(kind))
        seq = F.coalesce(F.array_max(F.transform(before, lambda e: e["seq"])), F.lit(0)) + 1
        entry = F.struct(*[(seq if n == "seq" else F.col("_changes") if n == "changes" else F.lit(None)).cast(kind.elementType[n].dataType).alias(n) for n in names])
        out = out.withColumn("timeline", F.when(some("_changes"), F.concat(before, F.array(entry))).otherwise(F.col("timeline")))
    return out.drop("_facts", "_goals", "_changes")


def set_filters(roots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Roots after filters were set by hand. ``wanted`` has ``root_uri, filters`` (JSON): one that is no
    object, or whose lists hold anything but texts, is refused; unknown roots are no matter."""
    part = lambda k: F.get_json_object("filters", f"$.{k}")
    texts = lambda k: part(k).isNull() | (F.startswith(F.trim(part(k)), F.lit("[")) & F.forall(F.split(F.regexp_replace(part(k), r"^\s*\[\s*|\s*\]\s*$", ""), r"\s*,\s*"), lambda x: (x == "") | F.startswith(x, F.lit('"'))))
    fine = F.startswith(F.trim("filters"), F.lit("{")) & F.json_object_keys("filters").isNotNull() & texts("include") & texts("exclude")
    new = wanted.where(fine).select("root_uri", F.col("filters").alias("_new"))
    return roots.join(new, "root_uri", "left").withColumn("filters", F.coalesce("_new", "filters")).select(*roots.columns)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows went and came between two snapshots, repeats counted: one row ``gone, added``.

    Rows of both add up to what is left of each, so none is compared with others."""
    both = before.withColumn("_n", F.lit(1)).unionByName(after.withColumn("_n", F.lit(-1))).groupBy(*before.columns).agg(F.sum("_n").alias("n"))
    return both.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).cast("long").alias("gone"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).cast("long").alias("added"))


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two snapshots differ in any row."""
    return not (before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty())


def strand_quality(strands: DataFrame) -> DataFrame:
    """One row of figures: short headlines, complete stages."""
    stages = ("现象与问题", "背景与约束", "决策与方案", "后续行动")
    full = F.lit(True)
    for s in stages:
        full = full & (F.size(F.coalesce(F.col(f"ooda.`{s}`"), F.expr("cast(array() as array<string>)"))) > 0)
    return strands.agg(F.count("*").alias("n"), F.avg(F.when(F.length("hdl") <= 30, 1.0).otherwise(0.0)).alias("short_hdl_rate"), F.avg(F.when(full, 1.0).otherwise(0.0)).alias("four_stage_rate"))


def size_distribution(mapping: DataFrame) -> DataFrame:
    """How many work objects have how many work-lines: ``size, n``."""
    return mapping.groupBy("reality_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def size_figures(mapping: DataFrame) -> DataFrame:
    sizes = mapping.groupBy("reality_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("n"), F.avg(F.when(F.col("size") == 1, 1.0).otherwise(0.0)).alias("single_ratio"), F.max("size").alias("largest"), F.avg("size").alias("mean"))


def inject_figures(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"), F.sum(F.col("empty").cast("int")).cast("long").alias("n_empty"))


def review_sample(rows: DataFrame, key: str, n: int, seed: int = 2026) -> DataFrame:
    """``n`` rows by a seeded hash: the same for every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def should_refine(turn_max: int, last_refined: int, least: int = 50) -> bool:
    return turn_max - last_refined >= least
