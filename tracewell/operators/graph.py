"""The property graph of work objects: co-occurrence edges, syncs, associations, cleaning, links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.functions import text as T
from tracewell.operators.log import insert_or_ignore
from tracewell.sources.shared import parts_for, written

#: What a node of knowledge is called, and words that say that a text builds on another.
PREFIX = "[知识]"
LINK_VERBS = ("基于", "承接", "详见", "延续", "参照")
#: Documents that only lead to others.
NAVIGATION = ("index", "readme", "changelog", "overview")
#: Relations between work objects that recall follows.
RECALL_RELATIONS = ("co_occurs_with", "shares_topic", "depends_on", "continues")
#: Words of documents' titles that are broadcast at most.
BROADCAST_WORDS = 200_000
#: Words of names that a task brings together with documents' titles, about.
TITLE_WORDS = 200_000
EVENT_KEY = ["session_id", "topic_id", "profile", "reality_a", "reality_b"]


def block_pairs(members: DataFrame) -> DataFrame:
    """All pairs a < b of distinct members of a block, once each.

    A block is a session's topic; its members are the work objects that its work-lines went into, a
    handful. Blocks of the same number in different sessions are different blocks.
    """
    ids = members.where("reality_id is not null").groupBy("session_id", "topic_id", "profile").agg(F.array_sort(F.collect_set("reality_id")).alias("ids"))
    first = ids.where(F.size("ids") > 1).select("session_id", "topic_id", "profile", "ids", F.posexplode("ids").alias("i", "reality_a"))
    later = F.slice("ids", F.col("i") + 2, F.size("ids"))
    return first.select("session_id", "topic_id", "profile", "reality_a", F.explode(later).alias("reality_b"))


def record_cooccurrences(members: DataFrame, existing: DataFrame, parts: int | None = None) -> DataFrame:
    """The pairs that aren't recorded yet: what an insert that ignores known keys would add. With ``parts``, both
    are dealt to so many tasks."""
    dealt = lambda df: df if parts is None else df.repartition(parts, *EVENT_KEY)
    return insert_or_ignore(dealt(block_pairs(members)), dealt(existing), EVENT_KEY)


def edges(events: DataFrame, profile: str | None = None, since: float | None = None, parts: int | None = None) -> DataFrame:
    """Edge weights: ``a, b, w``, the number of blocks that hold both. With ``parts``, pairs are dealt to so many tasks and
    counted there alone: most come once, so counts before the shuffle would take memory and save nothing."""
    events = events if parts is None else events.repartition(parts, "reality_a", "reality_b")
    rows = events if not profile else events.where(F.col("profile") == profile)
    rows = rows if since is None else rows.where(F.col("created_at") >= since)
    return rows.groupBy(F.col("reality_a").alias("a"), F.col("reality_b").alias("b")).agg(F.count("*").alias("w"))


def degrees(found: DataFrame) -> DataFrame:
    """The weight of each node's edges: ``id, degree``."""
    ends = found.select(F.explode(F.array("a", "b")).alias("id"), "w")
    return ends.groupBy("id").agg(F.sum("w").alias("degree"))


def block_count(events: DataFrame, profile: str | None = None) -> DataFrame:
    """How many blocks the events come from, whenever they happened."""
    rows = events if not profile else events.where(F.col("profile") == profile)
    return rows.select("session_id", "topic_id").distinct().agg(F.count("*").alias("n_blocks"))


def add_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new ones appended, but those whose source, target and relation are there."""
    return existing.unionByName(insert_or_ignore(new, existing, ["source", "target", "relation"]), allowMissingColumns=True)


def merge_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(insert_or_ignore(new, existing, ["id"]), allowMissingColumns=True)


def label(name: Column, otherwise: Column) -> Column:
    cut = F.left(F.trim(F.coalesce(name, F.lit(""))), F.lit(100))
    return F.concat(F.lit(PREFIX + " "), F.when(cut != "", cut).otherwise(otherwise))


def normal_label(text: Column) -> Column:
    return F.left(F.replace(F.lower(text), F.lit(" "), F.lit("_")), F.lit(64))


def reality_subgraph(realities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of work objects and of the work-lines they took in, and links from the latter."""
    named = label(F.col("name"), F.concat(F.lit("Reality "), F.col("reality_id").cast("string")))
    own = realities.select(
        F.concat(F.lit("reality_"), F.col("reality_id").cast("string")).alias("id"), named.alias("label"), normal_label(named).alias("norm_label"), F.lit("knowledge").alias("file_type"),
        F.lit("realities").alias("source_file"), F.lit("reality_merge").alias("_origin"), F.lit(0).cast("long").alias("community"),
    )
    sources = realities.where("source_strands is not null").select("reality_id", F.explode("source_strands").alias("sid", "strands")).select("reality_id", "sid", F.explode("strands").alias("strand"))
    nid = F.concat(F.lit("topic_"), F.col("sid"), F.lit("_S"), F.col("strand").cast("string"))
    lines = sources.select(
        nid.alias("id"), F.concat(F.lit("Strand "), F.col("sid"), F.lit("/S"), F.col("strand").cast("string")).alias("label"), F.lower(nid).alias("norm_label"), F.lit("knowledge").alias("file_type"),
        F.concat(F.lit("strand_summaries/"), F.col("sid"), F.lit("/S"), F.col("strand").cast("string")).alias("source_file"), F.lit("wiki").alias("_origin"), F.lit(0).cast("long").alias("community"),
    )
    links = sources.select(
        nid.alias("source"), F.concat(F.lit("reality_"), F.col("reality_id").cast("string")).alias("target"), F.lit("merged_into").alias("relation"), F.lit("HIGH").alias("confidence"),
        F.lit(0.95).alias("confidence_score"), F.lit(1.0).alias("weight"),
    )
    return own.unionByName(lines).dropDuplicates(["id"]), links.dropDuplicates(["source", "target", "relation"])


def sync_cooccurrences(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links after co-occurrence edges came in: a known link gets the new weight, others are added."""
    new = found.select(F.concat(F.lit("reality_"), F.col("a").cast("string")).alias("source"), F.concat(F.lit("reality_"), F.col("b").cast("string")).alias("target"), F.lit("co_occurs_with").alias("relation"), F.col("w").cast("double").alias("new_weight"))
    both = links.join(new, ["source", "target", "relation"], "full")
    others = [c for c in links.columns if c not in ("source", "target", "relation", "weight")]
    return both.select("source", "target", "relation", *others, F.coalesce("new_weight", "weight").alias("weight"))


def neighbours(links: DataFrame, budget: DataFrame, candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Work objects one link away from those of a query's budget: ``q, reality_id, pos``.

    ``links`` has ``pos`` (its order), ``source, target, relation``; ``budget`` has ``q, reality_id``, and
    ``candidates`` has ``reality_id``, with ``q`` if they differ by query. Both directions count; a
    neighbour must be a candidate and not be in the budget; the first ``limit`` by link order stay.
    """
    keys = [c for c in ("q", "reality_id") if c in candidates.columns]
    own = links.where(F.col("relation").isin(*RECALL_RELATIONS))
    rid = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^reality_([0-9]+)$', 1) as bigint)")
    own = own.select("pos", rid("source").alias("s"), rid("target").alias("t")).where("s is not null and t is not null")
    near = own.select("pos", F.col("s").alias("reality_id"), F.col("t").alias("other")).unionByName(own.select("pos", F.col("t").alias("reality_id"), F.col("s").alias("other")))
    found = budget.join(near, "reality_id").groupBy("q", "other").agg(F.min("pos").alias("pos")).withColumnRenamed("other", "reality_id")
    found = found.join(candidates.select(*keys), keys, "left_semi").join(budget.select("q", "reality_id"), ["q", "reality_id"], "left_anti")
    order = Window.partitionBy("q").orderBy("pos", "reality_id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


#: Members of a class that one row holds, about, where pairs of classes become pairs of members.
MEMBERS = 1_000


def slices(rows: DataFrame, most: int = MEMBERS) -> DataFrame:
    """The members (``cls, id``) of classes in lists of about ``most``, so that no class is one row: ``cls, ids``."""
    sizes = rows.groupBy("cls").agg(F.ceil(F.count("*") / most).alias("n"))
    placed = rows.join(sizes, "cls").select("cls", "id", F.pmod(F.xxhash64("id"), F.col("n")).alias("slice"))
    return placed.groupBy("cls", "slice").agg(F.collect_list("id").alias("ids")).drop("slice")


#: Members of classes on the left that are broadcast at most, members of one of their lists, and rows on the right that a task pairs with them, about.
BROADCAST_MEMBERS, LEFT_MEMBERS, RIGHT_ROWS = 1_000_000, 100, 20_000


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Pairs of different members of pairs of classes (``a, b``). ``left`` and ``right`` have ``cls, id``; all three are written tables.

    A left side that a count proves small is broadcast and meets each list of the right side where that lies: what is shuffled is the
    right side once, not pairs. Beyond that rows with two lists are shuffled, one for up to ``MEMBERS`` squared pairs. Either way pairs
    are made where they are used, and dealt evenly whatever a class's size.
    """
    spark = pairs.sparkSession
    own, others = (slices(side, *most).select(F.col("cls").alias(c), F.col("ids").alias(n)) for side, c, n, most in ((left, "a", "_left", (LEFT_MEMBERS,)), (right, "b", "_right", ())))
    if all(x.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS for x in (left, pairs)):
        parts = parts_for(spark, right.count(), RIGHT_ROWS)
        held = others.repartition(parts).join(F.broadcast(pairs), "b").join(F.broadcast(own), "a").drop("a", "b").coalesce(parts)
        # The last step moves nothing: generated code keeps what it makes of a row until it is done with it, and now starts anew here.
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        held = pairs.join(own, "a").join(others, "b").drop("a", "b").repartition(parts)
    held = held.withColumn(names[0], F.explode("_left")).drop("_left")
    return held.withColumn(names[1], F.explode("_right")).drop("_right").where(F.col(names[0]) != F.col(names[1]))


def link_candidates(items: DataFrame, key: str = "reality_id", text: str = "text", targets: Column | None = None) -> DataFrame:
    """Directed pairs (src, tgt) of items that share a word or CJK pair, where src says that it builds
    on something; with ``targets``, a condition on ``id``, only those whose tgt fits. Items of equal features are a class: classes meet by an inverted index on what they share,
    and their pairs are made distinct before they become pairs of items."""
    builds = F.lit(False)
    for verb in LINK_VERBS:
        builds = builds | F.contains(F.col("t"), F.lit(verb))
    rows = items.select(F.col(key).alias("id"), F.col(text).alias("t")).withColumn("fs", F.array_sort(F.array_distinct(T.mixed_pairs(F.col("t"))))).where(F.size("fs") > 0)
    rows = written(rows.select("id", builds.alias("builds"), "fs", F.md5(F.array_join("fs", "\n")).alias("cls")), "link-items")
    features = rows.groupBy("cls").agg(F.first("fs").alias("fs"), F.max("builds").alias("builds")).select("cls", "builds", F.explode("fs").alias("f"))
    met = features.where("builds").select(F.col("cls").alias("a"), "f").join(features.select(F.col("cls").alias("b"), "f"), "f").select("a", "b").distinct()
    found = expanded(written(met, "link-classes"), rows.where("builds").select("cls", "id"), rows.where(F.lit(True) if targets is None else targets).select("cls", "id"), ("src", "tgt"))
    again = not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return found.distinct() if again else found  # only an id that comes more than once can give a pair again


def relation_edges(candidates: DataFrame, decisions: DataFrame | Column) -> DataFrame:
    """Links that decisions make of candidates; pairs without a decision make none. ``decisions`` is a table
    (``src, tgt, relation``), or a rule: an expression over a candidate, which then needs no join."""
    said = candidates.withColumn("relation", decisions) if isinstance(decisions, Column) else candidates.join(decisions, ["src", "tgt"])
    made = said.where(F.col("relation").isin("depends_on", "continues"))
    node = lambda c: F.concat(F.lit("reality_"), F.col(c).cast("string"))
    return made.select(node("src").alias("source"), node("tgt").alias("target"), "relation", F.lit(1.0).alias("weight"))


def document_node(uri: Column) -> Column:
    """The node of a document's address: its first segment that is a visible Markdown file; else null."""
    name = F.try_element_at(F.filter(F.split(F.regexp_replace(uri, "/+$", ""), "/"), lambda p: p.endswith(".md") & ~p.startswith(".")), F.lit(1))
    return F.concat(F.lit("ov_doc_"), F.left(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit(48)))


def is_navigation(node: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(node), "^ov_doc_", ""), "\\.md$", "").isin(*NAVIGATION)


def reference_edges(hits: DataFrame, known: DataFrame, threshold: float | None, decisions: DataFrame | None = None, auto: float = 0.60, least_overlap: float = 0.05, top: int = 3) -> DataFrame:
    """Links from work objects to documents found for them.

    ``hits`` has ``reality_id, rank (from 0), uri, score, title, text``; ``known`` has the ids of
    document nodes. Only the first ``top`` hits, a node's first hit, nodes that exist and aren't
    navigation, and scores from the threshold count. The first hit needs the automatic score, or a
    title that shares words, or a decision; later ones need the automatic score. No threshold: probe
    only, no links.
    """
    rows = hits.where(F.col("rank") < top).withColumn("target", document_node(F.col("uri"))).where("target is not null")
    rows = rows.where(~is_navigation(F.col("target")))
    rows = rows.join(rows.groupBy("reality_id", "target").agg(F.min("rank").alias("rank")), ["reality_id", "target", "rank"], "left_semi")
    rows = rows.join(known.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    if threshold is None:
        return rows.where("false").select(F.lit("").alias("source"), "target", F.lit("references_ov").alias("relation"), F.col("score").alias("weight"))
    overlap = T.jaccard(F.array_distinct(T.mixed_pairs(F.col("text"))), F.array_distinct(T.mixed_pairs(F.coalesce("title", F.lit("")))))
    said = decisions.where("verdict = 'references'").select("reality_id", "target", F.lit(True).alias("said")) if decisions is not None else None
    rows = rows.join(said, ["reality_id", "target"], "left") if said is not None else rows.withColumn("said", F.lit(None).cast("boolean"))
    passes = (F.col("score") >= auto) | ((F.col("rank") == 0) & ((overlap >= least_overlap) | F.coalesce("said", F.lit(False))))
    rows = rows.where((F.col("score") >= threshold) & passes)
    return rows.select(F.concat(F.lit("reality_"), F.col("reality_id").cast("string")).alias("source"), "target", F.lit("references_ov").alias("relation"), F.round(F.least("score", F.lit(0.95)), 3).alias("weight"))


def pair_idf(titles: DataFrame, text: str = "title", only: DataFrame | None = None) -> DataFrame:
    """How rare each word or CJK pair is among titles: ``f, idf``; with ``only`` (``f``), of those alone."""
    pairs = titles.select(F.explode(F.array_distinct(T.mixed_pairs(F.col(text)))).alias("f"))
    pairs = pairs if only is None else pairs.join(only, "f", "left_semi")
    pairs = pairs.groupBy("f").agg(F.count("*").alias("df"))
    n = titles.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return pairs.crossJoin(F.broadcast(n)).select("f", F.ln(F.col("n") / F.col("df")).alias("idf"))


def title_matches(names: DataFrame, documents: DataFrame, least_idf: float = 2.5, least_shared: int = 2, least_score: float = 5.0) -> DataFrame:
    """Names and document titles that share enough rare words: ``id, doc, score, confidence``.

    ``names`` has ``id, title``; ``documents`` has ``doc, title``. What they share is weighed by how rare it
    is among the names; what no name holds weighs nothing. A match needs ``least_shared`` rare words, so
    only those bring names and titles together; what else they share is added to pairs that have them.
    Names are cut into words once, and of these the words that titles hold are kept.
    """
    b = documents.select("doc", F.explode(F.array_distinct(T.mixed_pairs(F.col("title")))).alias("f"))
    few = b.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    sent = F.broadcast if few else lambda x: x
    a = names.select("id", F.explode(F.array_distinct(T.mixed_pairs(F.col("title")))).alias("f"))
    a = written(a.join(sent(b.select("f").distinct()), "f", "left_semi").select("id", "f"), "title-words")
    n = names.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    idf = a.groupBy("f").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("f", F.ln(F.col("n") / F.col("df")).alias("idf"))
    weights = b.join(idf, "f")
    rare = F.col("idf") >= least_idf
    # A title meets many documents, so words are dealt by title to tasks of a bounded number, which add up their own pairs.
    a = a.repartition(parts_for(a.sparkSession, a.count(), TITLE_WORDS), "id")
    found = a.join(sent(weights.where(rare)), "f").groupBy("id", "doc").agg(F.sum("idf").alias("rare"), F.count("*").alias("valid")).where(F.col("valid") >= least_shared)
    found = written(found, "title-pairs")
    own = a.join(found.select("id").distinct(), "id", "left_semi").join(found.select("id", "doc"), "id")
    more = own.join(sent(weights.where(~rare)), ["doc", "f"]).groupBy("id", "doc").agg(F.sum("idf").alias("more"))
    scored = found.join(more, ["id", "doc"], "left").withColumn("score", F.col("rare") + F.coalesce("more", F.lit(0.0))).where(F.col("score") >= least_score)
    return scored.select("id", "doc", "score", F.round(F.least(F.col("score") / 8.0, F.lit(0.95)), 3).alias("confidence"))


#: Keywords that one automaton holds at most.
KEYWORDS = 100_000


def _find_keywords(labels: pa.Table, words: pa.Table) -> pa.Table:
    import ahocorasick

    found = ahocorasick.Automaton()
    for kw in words["kw"].to_pylist():
        found.add_word(kw, kw)
    out: list[tuple[int, str]] = []
    if len(found):
        found.make_automaton()
        for at, label in enumerate(labels["l"].to_pylist()):
            out += [(at, kw) for kw in {kw for _, kw in found.iter(label)}]
    rows = labels.take(pa.array([at for at, _ in out], pa.int64()))
    return pa.table({"k": rows["k"].cast(pa.string()), "kw": pa.array([kw for _, kw in out], pa.string())})


def keyword_hits(labels: DataFrame, words: DataFrame, most: int = KEYWORDS) -> DataFrame:
    """Which keywords each label holds: ``k, kw``. ``labels`` has ``k, l``, ``words`` has ``kw`` (distinct).

    Keywords are cut into blocks of at most about ``most`` and labels into as many parts as a shuffle has
    partitions; each block meets each part in a task, where an automaton of the block's keywords goes through each label
    once. So neither a word that all labels hold nor a common beginning is a hot key.
    """
    blocks = max(1, -(-words.count() // most))
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = labels.select("k", "l", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"))
    right = words.select("kw", F.pmod(F.xxhash64("kw"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_find_keywords, "k string, kw string")


def _kept_keywords(words: list[str], schema: pa.Schema):
    def run(batches):
        import ahocorasick

        found = ahocorasick.Automaton()
        for kw in words:
            found.add_word(kw, kw)
        if words:
            found.make_automaton()
        for batch in batches:
            kws = [sorted({kw for _, kw in found.iter(label)}) if words else [] for label in batch.column("l").to_pylist()]
            made = pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("n"), pa.array(kws, pa.list_(pa.string()))], names=["node_id", "n", "kws"])
            yield made.filter(pa.array([len(x) > 0 for x in kws], pa.bool_())).cast(schema)

    return run


def labels_read(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """``node_id, n, kws``: a label's length and the keywords that it holds, of nodes that hold any. ``nodes`` has ``node_id, l, n``.

    Keywords that a count proves few go to all tasks, and labels stay where they are; more meet labels by :func:`keyword_hits`.
    """
    if words.limit(KEYWORDS + 1).count() <= KEYWORDS:
        made = S.StructType([nodes.schema["node_id"], nodes.schema["n"], S.StructField("kws", S.ArrayType(S.StringType()))])
        return nodes.mapInArrow(_kept_keywords(sorted(r.kw for r in words.collect()), to_arrow_schema(made)), made)
    nodes = nodes.withColumn("k", F.md5("l"))
    hits = keyword_hits(nodes.groupBy("k").agg(F.first("l").alias("l")), words)
    return nodes.select("node_id", "n", "k").join(hits.groupBy("k").agg(F.array_sort(F.collect_set("kw")).alias("kws")), "k").drop("k")


def associations(themes: DataFrame, nodes: DataFrame, best: int | None = None) -> DataFrame:
    """Graph nodes whose label holds a keyword of a theme: ``theme_id, node_id, strength``, the
    strongest match of each pair. ``themes`` has ``theme_id, text``; ``nodes`` has ``id, label`` and may
    have ``_origin``: nodes that come from the themes themselves (wiki) are left out. With ``best``, only a
    theme's first ones, by :func:`strongest`.

    Distinct keywords are looked for in labels once, all at once (:func:`labels_read`); what is kept of a label are its keywords and
    their strengths. Themes of the same keywords are a class, and so are nodes of the same ones with the same strengths: classes are
    matched, and become themes and nodes at the end.
    """
    nodes = nodes.where("not _origin <=> 'wiki'") if "_origin" in nodes.columns else nodes
    themes = themes.select("theme_id", F.array_sort(F.array_distinct(T.identifier_keywords(F.col("text")))).alias("kws")).where(F.size("kws") > 0)
    themes = themes.select("theme_id", "kws", F.md5(F.array_join("kws", "\n")).alias("cls"))
    keys = themes.groupBy("cls").agg(F.first("kws").alias("kws")).select("cls", F.explode("kws").alias("kw"))
    nodes = nodes.where("label <> ''").select(F.col("id").alias("node_id"), F.lower("label").alias("l")).withColumn("n", F.length("l"))
    nodes = labels_read(nodes, keys.select("kw").distinct())
    strength = lambda kw: F.round(F.greatest(F.least(F.length(kw) / F.greatest("n", F.lit(1)), F.lit(1.0)), F.lit(0.3)), 3)
    nodes = nodes.select("node_id", F.transform("kws", lambda kw: F.struct(kw.alias("kw"), strength(kw).alias("strength"))).alias("held"))
    nodes = written(nodes.withColumn("k", F.md5(F.to_json("held"))), "label-keywords")
    hits = nodes.groupBy("k").agg(F.first("held").alias("held")).select("k", F.inline("held"))
    met = hits.join(keys, "kw").groupBy("cls", "k").agg(F.max("strength").alias("strength"))
    members = nodes.select("k", "node_id").distinct()
    if best is not None:
        members = members.withColumn("_k", F.row_number().over(Window.partitionBy("k").orderBy("node_id"))).where(F.col("_k") <= best).drop("_k")
    found = met.join(members, "k").select("cls", "node_id", "strength")
    # A node may come with several labels; then its strongest counts.
    found = found if best is None and nodes.groupBy("node_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty() else found.groupBy("cls", "node_id").agg(F.max("strength").alias("strength"))
    found = found if best is None else strongest(found, best, per="cls")
    own = themes.select("cls", "theme_id").distinct()
    few = own.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    out = found.join(F.broadcast(own) if few else own, "cls").select("theme_id", "node_id", "strength")
    again = not own.groupBy("theme_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    out = out.groupBy("theme_id", "node_id").agg(F.max("strength").alias("strength")) if again else out
    return strongest(out, best, per="theme_id") if again and best is not None else out


def strongest(found: DataFrame, n: int = 5, per: str | None = None) -> DataFrame:
    """The ``n`` strongest associations, of all or of each ``per``."""
    if per is None:
        return found.orderBy(F.col("strength").desc(), "theme_id", "node_id").limit(n)
    order = Window.partitionBy(per).orderBy(F.col("strength").desc(), "node_id")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def document_uri(path: Column, base: str = "docs://") -> Column:
    """The address of a source path under docs/; empty for any other."""
    return F.when(path.startswith("docs/"), F.concat(F.lit(base), F.regexp_replace(path, "^docs/", ""))).otherwise("")


def clean_knowledge(nodes: DataFrame, links: DataFrame, realities: DataFrame, strand_nodes: DataFrame, documents: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes and links without stale knowledge: work objects, work-lines and documents that are gone,
    retired themes, and links that then hang. Nodes of code stay whatever they are called.

    ``documents`` is None if the list of documents isn't to be had: then they stay."""
    live = realities.select(F.concat(F.lit("reality_"), F.col("reality_id").cast("string")).alias("id")).unionByName(strand_nodes.select("id"))
    ours = F.col("file_type") == "knowledge"
    kind = F.when(F.col("id").rlike("^reality_[0-9]+$") | F.col("id").rlike("^topic_.+_S[0-9]+$"), "listed").when(F.col("id").startswith("theme_"), "gone")
    if documents is not None:
        live = live.unionByName(documents.select("id"))
        kind = kind.when(F.col("id").startswith("ov_doc_"), "listed")
    marked = nodes.withColumn("_kind", F.when(ours, kind)).join(live.distinct().withColumn("_live", F.lit(True)), "id", "left")
    kept = marked.where("_kind is null or (_kind = 'listed' and _live)").select(*nodes.columns)
    ids = kept.select("id").distinct()
    left = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, left.select(*links.columns)


def filter_documents(documents: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Documents by relative path: the first segment begins with an included name (if any is given),
    and no excluded text occurs."""
    first = F.element_at(F.split("rel", "/"), 1)
    keep = F.exists(F.array(*map(F.lit, include)), lambda p: F.startswith(first, p)) if include else F.lit(True)
    drop = F.exists(F.array(*map(F.lit, exclude)), lambda p: F.contains(F.col("rel"), p)) if exclude else F.lit(False)
    return documents.where(keep & ~drop)


def foreign_profiles(hits: DataFrame, profiles: DataFrame, current: str) -> DataFrame:
    """Hits without those under another profile's folder; unknown folders are nobody's."""
    segment = F.regexp_extract("uri", "/([^/]+)/", 1)
    other = profiles.where(F.col("profile") != current).select(F.col("profile").alias("_segment")).distinct()
    return hits.withColumn("_segment", segment).join(other, "_segment", "left_anti").drop("_segment")
