"""Registered queries over the driver's tables: co-occurrence graph, candidates, recall, upkeep; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vector as V
from tracewell.operators import docs, graph, log, merge, recall, refine
from tracewell.sources import tables as S
from tracewell.sources.shared import parts_for

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- orders as blocks, their parts as work objects -----------------------------------

_MEMBERS = "m AS (SELECT DISTINCT l_suppkey::VARCHAR AS session_id, l_orderkey AS topic_id, CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS profile, l_partkey::BIGINT AS reality_id FROM lineitem_blocks)"
_BLOCKS = "lineitem_blocks AS (SELECT l_orderkey, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS l_suppkey, l_partkey FROM lineitem)"
_PAIRS = f"{_BLOCKS}, {_MEMBERS}, p AS (SELECT a.session_id, a.topic_id, a.profile, a.reality_id AS reality_a, b.reality_id AS reality_b FROM m a JOIN m b USING (session_id, topic_id, profile) WHERE a.reality_id < b.reality_id)"
_EDGES = f"{_PAIRS}, e AS (SELECT reality_a AS a, reality_b AS b, count(*) AS w FROM p GROUP BY 1, 2)"


def _parts(spark, sf_dir) -> int:
    return parts_for(spark, S.read(spark, sf_dir, "lineitem").count())


def _members(spark, sf_dir) -> DataFrame:
    # Dealt once, by order, to tasks of a bounded number of lines: all that follows of a block stays where it is.
    rows = S.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").repartition(_parts(spark, sf_dir), "l_orderkey")
    owner = rows.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("owner"))
    profile = F.when(F.col("owner") % 2 == 0, "even").otherwise("odd")
    return rows.join(owner, "l_orderkey").select(F.col("owner").cast("string").alias("session_id"), F.col("l_orderkey").alias("topic_id"), profile.alias("profile"), F.col("l_partkey").cast("long").alias("reality_id")).distinct()


def _events(spark, sf_dir) -> DataFrame:
    return graph.block_pairs(_members(spark, sf_dir)).withColumn("created_at", F.lit(0.0))


def _edges(spark, sf_dir, **only) -> DataFrame:
    return graph.edges(_events(spark, sf_dir), parts=2 * _parts(spark, sf_dir), **only)  # a line comes in about two pairs


def _node(c):
    return F.concat(F.lit("reality_"), F.col(c).cast("string"))


@query(f"WITH {_PAIRS} SELECT * FROM p")
def cooc_pairs(spark, sf_dir):
    return graph.block_pairs(_members(spark, sf_dir)).select("session_id", "topic_id", "profile", "reality_a", "reality_b")


@query(f"WITH {_PAIRS} SELECT * FROM p WHERE topic_id % 3 <> 0")  # the pairs of these blocks are known: what is new are all others
def cooc_new_pairs(spark, sf_dir):
    known = _events(spark, sf_dir).where("topic_id % 3 = 0")
    return graph.record_cooccurrences(_members(spark, sf_dir), known, 2 * _parts(spark, sf_dir)).select("session_id", "topic_id", "profile", "reality_a", "reality_b")


@query(f"WITH {_EDGES} SELECT * FROM e")
def cooc_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT reality_a AS a, reality_b AS b, count(*) AS w FROM p WHERE profile = 'even' GROUP BY 1, 2")
def cooc_edges_of_profile(spark, sf_dir):
    return _edges(spark, sf_dir, profile="even")


@query(f"WITH {_EDGES} SELECT id, sum(w)::BIGINT AS degree FROM (SELECT a AS id, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY 1")
def cooc_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT count(DISTINCT session_id || ':' || topic_id) AS n_blocks FROM p")
def cooc_blocks(spark, sf_dir):
    return graph.block_count(_events(spark, sf_dir))


# A customer's anchors and budget are the parts of the customer's own orders.
_OWN = "own AS (SELECT c_custkey AS q, l_partkey::BIGINT AS id, bool_or(o_orderstatus = 'F') AS fused FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_custkey % 50 = 0 GROUP BY 1, 2)"


def _own_parts(spark, sf_dir) -> DataFrame:
    c = S.read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("q"))
    o = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("fused"))
    parts = S.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("id"))
    return c.join(o, "q").join(parts, "l_orderkey").groupBy("q", "id").agg(F.max("fused").alias("fused"))


@query(f"""WITH {_EDGES}, {_OWN},
d AS (SELECT q, id, CASE WHEN fused THEN 0.8 ELSE 0.4 END AS wa, 0.0 AS d FROM own
  UNION ALL SELECT own.q, e2.id, CASE WHEN fused THEN 0.8 ELSE 0.4 END, 1.0 / (w + 1) FROM own JOIN (SELECT a AS anchor, b AS id, w FROM e UNION ALL SELECT b, a, w FROM e) e2 ON e2.anchor = own.id),
s AS (SELECT q, id, sum(wa::DOUBLE * d::DOUBLE) / sum(wa::DOUBLE) AS s FROM d WHERE id IN (SELECT reality_id FROM m) GROUP BY 1, 2),
r AS (SELECT q, id, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 12), id) AS rank FROM s WHERE round(s, 12) <= 0.5)
SELECT q, id, round(s, 9) AS s, rank FROM r WHERE rank <= 3""")
def s_candidates(spark, sf_dir):
    works = _members(spark, sf_dir).select(F.col("reality_id").alias("id"))
    found = merge.s_candidates(works, _own_parts(spark, sf_dir), _edges(spark, sf_dir))
    return found.select("q", "id", F.round("s", 9).alias("s"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_EDGES}, {_OWN}, l AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS pos FROM e),
n AS (SELECT q, other, min(pos) AS pos FROM own JOIN (SELECT a AS id, b AS other, pos FROM l UNION ALL SELECT b, a, pos FROM l) x USING (id) WHERE other % 2 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos, other) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.q = n.q AND own.id = n.other)) SELECT q, other AS reality_id FROM r WHERE k <= 5""")
def graph_neighbours(spark, sf_dir):
    # The edges' own order stands for their number, so that no single task numbers them all.
    links = _edges(spark, sf_dir).select(F.struct("a", "b").alias("pos"), _node("a").alias("source"), _node("b").alias("target"), F.lit("co_occurs_with").alias("relation"))
    ids = _members(spark, sf_dir).select("reality_id").distinct().where("reality_id % 2 = 0")
    return graph.neighbours(links, _own_parts(spark, sf_dir).select("q", F.col("id").alias("reality_id")), ids).select("q", "reality_id")


@query(f"""WITH {_EDGES}, old AS (SELECT 'reality_' || a AS source, 'reality_' || b AS target, 'co_occurs_with' AS relation, 0.5::DOUBLE AS weight FROM e WHERE (a + b) % 2 = 0 UNION ALL SELECT 'reality_' || a, 'reality_' || b, 'depends_on', 1.0 FROM e WHERE (a + b) % 5 = 0),
new AS (SELECT 'reality_' || a AS source, 'reality_' || b AS target, 'co_occurs_with' AS relation, w::DOUBLE AS weight FROM e)
SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, coalesce(o.relation, n.relation) AS relation, coalesce(n.weight, o.weight) AS weight FROM old o FULL JOIN new n ON o.source = n.source AND o.target = n.target AND o.relation = n.relation""")
def cooc_sync(spark, sf_dir):
    e = _edges(spark, sf_dir)
    node = lambda c: F.concat(F.lit("reality_"), F.col(c).cast("string"))
    old = e.where("(a + b) % 2 = 0").select(node("a").alias("source"), node("b").alias("target"), F.lit("co_occurs_with").alias("relation"), F.lit(0.5).alias("weight"))
    old = old.unionByName(e.where("(a + b) % 5 = 0").select(node("a").alias("source"), node("b").alias("target"), F.lit("depends_on").alias("relation"), F.lit(1.0).alias("weight")))
    return graph.sync_cooccurrences(old, e).select("source", "target", "relation", "weight")


# -- titles: parts as work objects, documents' first words as titles --------------------------------

_WORDS = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z]{{2,}}'), lambda w: lower(w)))"


@query(f"""WITH t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS f FROM documents), n AS (SELECT greatest(count(*), 1) AS n FROM documents)
SELECT f, round(ln(n::DOUBLE / count(*)), 9) AS idf FROM t CROSS JOIN n GROUP BY f, n""")
def pair_idf(spark, sf_dir):
    titles = S.read(spark, sf_dir, "documents").select(F.col("text").alias("title"))
    return graph.pair_idf(titles).select("f", F.round("idf", 9).alias("idf"))


@query(f"""WITH nm AS (SELECT doc_id AS id, text AS title FROM documents), dt AS (SELECT item_id AS doc, text AS title FROM benchmark),
a AS (SELECT id, unnest({_WORDS.format('title')}) AS f FROM nm), b AS (SELECT doc, unnest({_WORDS.format('title')}) AS f FROM dt),
idf AS (SELECT f, ln((SELECT count(*) FROM nm)::DOUBLE / count(*)) AS idf FROM a GROUP BY f),
s AS (SELECT a.id, b.doc, sum(idf) AS score, sum(CASE WHEN idf >= 2.5 THEN 1 ELSE 0 END) AS valid FROM a JOIN idf USING (f) JOIN b USING (f) GROUP BY 1, 2)
SELECT id, doc, round(score, 6) AS score, round(least(score / 8, 0.95), 3) AS confidence FROM s WHERE valid >= 2 AND score >= 5""")
def title_matches(spark, sf_dir):
    names = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    found = graph.title_matches(names, S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.col("text").alias("title")))
    return found.select("id", "doc", F.round("score", 6).alias("score"), "confidence")


@query("""WITH k AS (SELECT DISTINCT p_partkey AS theme_id, unnest(list_concat(list_transform(regexp_extract_all(p_name, '[A-Z][a-z]{2,}'), lambda w: lower(w)), regexp_extract_all(lower(p_name), '[a-z_][a-z0-9_]{2,}'))) AS kw FROM part WHERE p_partkey % 50 = 0),
l AS (SELECT doc_id AS id, concat_ws(' ', source, lang, p_name, text) AS label FROM documents LEFT JOIN part ON p_partkey = doc_id)
SELECT theme_id, id AS node_id, max(round(greatest(least(length(kw)::DOUBLE / length(label), 1.0), 0.3), 3)) AS strength FROM k JOIN l ON contains(lower(label), kw) GROUP BY 1, 2""")
def associations(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("doc_id"), "p_name")
    nodes = S.read(spark, sf_dir, "documents").join(names, "doc_id", "left").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang", "p_name", "text").alias("label"))
    return graph.associations(p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("theme_id"), F.col("p_name").alias("text")), nodes)


@query(f"""WITH {_EDGES}, nodes AS (SELECT 'reality_' || p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'code' ELSE 'knowledge' END AS file_type FROM part UNION ALL SELECT 'theme_' || i, 'knowledge' FROM range(0, 20) t(i)),
kept AS (SELECT id FROM nodes WHERE file_type <> 'knowledge' OR id IN (SELECT 'reality_' || reality_id FROM m WHERE reality_id % 3 <> 0))
SELECT 'reality_' || a AS source, 'reality_' || b AS target FROM e WHERE 'reality_' || a IN (SELECT id FROM kept) AND 'reality_' || b IN (SELECT id FROM kept)""")
def knowledge_cleanup(spark, sf_dir):
    nodes = S.read(spark, sf_dir, "part").select(_node("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, "code").otherwise("knowledge").alias("file_type"))
    nodes = nodes.unionByName(spark.range(20).select(F.concat(F.lit("theme_"), F.col("id").cast("string")).alias("id"), F.lit("knowledge").alias("file_type")))
    links = _edges(spark, sf_dir).select(_node("a").alias("source"), _node("b").alias("target"))
    live = _members(spark, sf_dir).where("reality_id % 3 <> 0").select("reality_id").distinct()
    _, left = graph.clean_knowledge(nodes, links, live, spark.createDataFrame([], "id string"), None)
    return left


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 100 = 0 AS builds, p_name AS text FROM part), f AS (SELECT DISTINCT id, builds, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda w: lower(w))) AS f FROM t)
SELECT DISTINCT a.id AS src, b.id AS tgt FROM f a JOIN f b USING (f) WHERE a.builds AND a.id <> b.id UNION SELECT a.id, b.id FROM t a JOIN t b ON a.builds AND b.builds AND a.id <> b.id""")
def link_candidates(spark, sf_dir):
    names = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("reality_id"), F.concat(F.when(F.col("p_partkey") % 100 == 0, "基于 ").otherwise(""), "p_name").alias("text"))
    return graph.link_candidates(names)


# -- recall ----------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"""WITH {_E}, p AS (SELECT a.vec_id AS q, b.vec_id AS reality_id, round(1 - list_cosine_similarity(a.v, b.v), 9) AS d FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, reality_id) AS rank FROM p WHERE d <= 0.5) SELECT q, reality_id, round(d, 6) AS d, rank FROM r WHERE rank <= 15""")
def theta_topk(spark, sf_dir):
    e = S.read(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    found = recall.in_range(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("v").alias("qv")), e.select(F.col("vec_id").alias("reality_id"), F.col("v").alias("query_centroid")))
    return found.select("q", "reality_id", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


_CP = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(f"""WITH q AS (SELECT p_partkey AS q, replace(replace(lower(p_name), ' ', ''), '-', '') AS t FROM part WHERE p_partkey % 50 = 0), n AS (SELECT p_partkey AS reality_id, replace(replace(lower(p_name), ' ', ''), '-', '') AS t, replace(replace(lower(p_type || ' ' || p_brand), ' ', ''), '-', '') AS h FROM part),
f AS (SELECT q, {_CP.format('t')} AS qp FROM q), g AS (SELECT reality_id, {_CP.format('t')} AS np, {_CP.format('h')} AS hp FROM n),
p AS (SELECT q, reality_id, round(1 - greatest(coalesce(len(list_intersect(qp, np))::DOUBLE / nullif(len(list_distinct(list_concat(qp, np))), 0), 0), coalesce(len(list_intersect(qp, hp))::DOUBLE / nullif(len(list_distinct(list_concat(qp, hp))), 0), 0)), 9) AS d FROM f CROSS JOIN g),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, reality_id) AS rank FROM p) SELECT q, reality_id, round(d, 6) AS d, rank FROM r WHERE rank <= 15""")
def lexical_recall(spark, sf_dir):
    p = S.read(spark, sf_dir, "part")
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("text"))
    r = p.select(F.col("p_partkey").alias("reality_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("hdl"))
    return recall.lexical(q, r).select("q", "reality_id", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_E}, c AS (SELECT label AS reality_id, i, avg(v[i]) AS m, count(*) AS n FROM e, range(1, 65) t(i) WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT reality_id::BIGINT AS reality_id, round(sum(m), 6) AS total, max(n) AS n FROM c GROUP BY 1""")
def question_clouds(spark, sf_dir):
    e = S.read(spark, sf_dir, "embeddings").where("label is not null")
    text = F.concat(F.lit("question "), F.col("vec_id").cast("string"))
    strands = e.select(F.col("vec_id").alias("strand_id"), text.alias("query_text"))
    mapping = e.select(F.col("vec_id").alias("strand_id"), F.col("label").cast("long").alias("reality_id"))
    clouds = recall.question_clouds(strands, mapping, e.select(text.alias("text"), V.doubles(F.col("embedding")).alias("vec")))
    return clouds.select("reality_id", F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "n")


@query(f"""WITH {_E}, c0 AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) WHERE label IS NOT NULL GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM c0 GROUP BY 1),
p AS (SELECT vec_id, c.label, round(list_cosine_similarity(e.v, c.c), 9) AS s FROM e CROSS JOIN c WHERE vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM p WHERE s > 0)
SELECT vec_id::VARCHAR AS session_id, label::BIGINT AS picked_id FROM r WHERE k <= 3""")
def inject_log(spark, sf_dir):
    e = S.read(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    clouds = V.means(e.where("label is not null").select(F.col("label").cast("long").alias("reality_id"), "v"), ["reality_id"], "v")
    blocks = e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("session_id"), F.lit(1).cast("long").alias("topic_id"), F.col("v").alias("vec"))
    return recall.inject_log(blocks, clouds).select("session_id", F.explode("picked").alias("picked_id"))


# -- merge and upkeep -------------------------------------------------------------------------------


@query("""SELECT o_custkey::VARCHAR AS session_id, o_orderkey AS strand_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def unmerged_strands(spark, sf_dir):
    strands = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("strand_id"))
    mapped = S.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("strand_id")).distinct().join(strands, "strand_id")
    return merge.unmerged(strands, mapped).select("session_id", "strand_id")


@query("""SELECT o_custkey::VARCHAR AS session_id, year(o_orderdate)::BIGINT AS topic_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'completed' ELSE 'skip' END AS status FROM orders GROUP BY 1, 2""")
def strand_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("skip")
    strands = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.year("o_orderdate").cast("long").alias("topic_id"), status.alias("status"))
    return merge.block_status(strands)


@query("""WITH r AS (SELECT o_custkey AS c, o_orderkey, o_orderpriority, (o_orderkey % 9)::BIGINT AS t FROM orders),
k AS (SELECT c, min(t * 100000000 + o_orderkey) AS lo, max(t * 100000000 + o_orderkey) AS hi, count(*) AS n_strands FROM r GROUP BY 1)
SELECT k.c::VARCHAR AS session_id, 1::BIGINT AS topic_id, a.o_orderpriority AS name, b.o_orderpriority AS hdl, k.n_strands FROM k JOIN r a ON a.c = k.c AND a.t * 100000000 + a.o_orderkey = k.lo JOIN r b ON b.c = k.c AND b.t * 100000000 + b.o_orderkey = k.hi""")
def block_to_reality(spark, sf_dir):
    strands = S.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"), F.lit(1).cast("long").alias("topic_id"), F.col("o_orderkey").alias("strand_id"), F.col("o_orderpriority").alias("hdl"),
        F.array((F.col("o_orderkey") % 9).cast("long")).alias("turns"),
    )
    return merge.blocks_to_realities(strands)


@query("""WITH h AS (SELECT s_suppkey, s_suppkey % 5 AS n, (1000 - s_suppkey % 150) * 86400.0 AS u, s_suppkey % 3 <> 0 AS vec, s_suppkey % 4 <> 0 AS content FROM supplier)
SELECT s_suppkey, round((CASE WHEN n >= 3 THEN 1.0 WHEN n = 2 THEN 0.9 WHEN n = 1 THEN 0.7 ELSE 0.3 END)::DOUBLE * CASE WHEN (86400000.0 - u) / 86400 > 90 THEN 0.6 WHEN (86400000.0 - u) / 86400 > 30 THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN vec THEN 1.0 ELSE 0.5 END::DOUBLE * CASE WHEN content THEN 1.0 ELSE 0.3 END::DOUBLE, 3) AS health_score FROM h""")
def health_score(spark, sf_dir):
    k = F.col("s_suppkey")
    score = refine.health(k % 5, (F.lit(1000) - k % 150) * 86400.0, F.lit(86400000.0), k % 3 != 0, k % 4 != 0)
    return S.read(spark, sf_dir, "supplier").select("s_suppkey", score.alias("health_score"))


@query("""WITH s AS (SELECT o_custkey AS r, count(*) AS size FROM orders GROUP BY 1) SELECT size, count(*) AS n FROM s GROUP BY 1""")
def size_distribution(spark, sf_dir):
    return refine.size_distribution(S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reality_id")))


@query("""WITH s AS (SELECT o_custkey AS r, count(*) AS size FROM orders GROUP BY 1) SELECT count(*) AS n, avg(CASE WHEN size = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS single_ratio, max(size) AS largest, avg(size) AS mean FROM s""")
def size_figures(spark, sf_dir):
    return refine.size_figures(S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reality_id")))


@query("""WITH e AS (SELECT user_id::VARCHAR AS session_id, (event_id // 100)::BIGINT AS turn, event_id AS seq, event_type AS request_id, event_id % 3 <> 0 AS own FROM events),
n AS (SELECT *, CASE WHEN own AND lag(own) OVER w AND request_id = lag(request_id) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY session_id, turn ORDER BY seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session_id, turn ORDER BY seq) AS island FROM n)
SELECT session_id, turn, min(seq) AS seq, min(request_id) AS request_id, string_agg(seq::VARCHAR, chr(10) || chr(10) ORDER BY seq) AS elm FROM i GROUP BY session_id, turn, island""")
def request_islands(spark, sf_dir):
    i = F.col("event_id")
    rows = S.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.floor(i / 100).alias("turn"), i.alias("seq"), F.col("event_type").alias("request_id"), F.when(i % 3 != 0, "assistant").otherwise("user").alias("role"), i.cast("string").alias("elm"))
    return log.merge_split_rows(rows).select("session_id", "turn", "seq", "request_id", "elm")


@query("""SELECT DISTINCT page_id::VARCHAR || '.md' AS path, l AS link FROM (SELECT page_id, trim(unnest(regexp_extract_all(t, '\\]\\(([^)]+)\\)', 1))) AS l FROM (SELECT page_id, regexp_replace(html, 'href="/?([^"]*)"', '](\\1)', 'g') AS t FROM pages))
WHERE l <> '' AND NOT regexp_matches(l, '^(<|https?://|mailto:|viking://|#|data:)') AND trim(regexp_extract(l, '^([^#?]*)', 1)) <> ''""")
def page_links(spark, sf_dir):
    text = F.regexp_replace("html", 'href="/?([^"]*)"', "]($1)")
    files = S.read(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    return docs.links(files).select("path", "link").distinct()


@query("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 72) || '…' || right(text, 47) END AS short FROM documents""")
def head_tail(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", T.head_tail(F.col("text")).alias("short"))


@query("""WITH c AS (SELECT doc_id, text, substr(text, 1, 150) AS cut FROM documents), p AS (SELECT *, trim(regexp_extract(cut, '^((?s:.*)[。！？.!?])', 1)) AS s, trim(regexp_extract(cut, '^((?s:.*)[，；;,:：])', 1)) AS k FROM c)
SELECT doc_id, CASE WHEN length(text) <= 150 THEN text WHEN s <> '' THEN s WHEN k <> '' THEN k ELSE regexp_replace(trim(cut), '[,，;；:：.\\s]+$', '') END AS head FROM p""")
def safe_truncate(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", T.safe_truncate(F.col("text"), 150).alias("head"))
