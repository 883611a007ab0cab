"""Registered queries over the driver's tables: log, segmentation, grading and retrieval; each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import vector as V
from tracewell.operators import history, log, search, topics
from tracewell.sources import tables as S
from tracewell.sources.shared import numbered, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The log that :func:`tracewell.sources.tables.turn_log` makes, in SQL.
LOG = """
l0 AS (
  SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS ordinal
  FROM conversations WHERE role <> 'system'
), l1 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, ordinal ORDER BY turn, text) - 1 AS seq FROM l0 WHERE ordinal > 0
), l2 AS (
  SELECT *, max(CASE WHEN role = 'assistant' THEN seq END) OVER (PARTITION BY conv_id, ordinal) AS last_seq FROM l1
), log AS (
  SELECT conv_id::VARCHAR AS session_id, ordinal::BIGINT AS turn, seq::BIGINT AS seq, role, coalesce(text, '') AS elm,
         coalesce(role = 'assistant' AND seq = last_seq, false) AS fin,
         CASE WHEN role = 'user' THEN text WHEN role = 'assistant' AND seq = last_seq THEN text END AS fct, substr(text, 1, 100) AS hdl
  FROM l2
)
"""

_FEATURES = "list_distinct(regexp_extract_all(lower(elm), '[a-z_][a-z0-9_]*|[0-9]+'))"

#: Topics of every session by stepping through its turns (these tables hold no CJK text and no forced phrase).
SEGMENTS = f"""
u AS (
  SELECT session_id, turn, elm, {_FEATURES} AS f, length(trim(elm)) <= 5 AS short,
         regexp_matches(lower(elm), 'topic switch|switching gears|shift topics|moving on|change of subject') AS forced
  FROM log WHERE seq = 0 AND role = 'user'
), st AS (
  SELECT session_id, turn, 1 AS topic, 2 AS next, f, false AS is_switch FROM u WHERE turn = 1
  UNION ALL
  SELECT u.session_id, u.turn,
         CASE WHEN u.forced THEN st.next WHEN u.short THEN st.topic
              WHEN len(list_intersect(u.f, st.f)) / nullif(len(list_distinct(list_concat(u.f, st.f))), 0)::DOUBLE >= 0.04 THEN st.topic ELSE st.next END,
         CASE WHEN u.forced THEN st.next + 1 WHEN u.short THEN st.next
              WHEN len(list_intersect(u.f, st.f)) / nullif(len(list_distinct(list_concat(u.f, st.f))), 0)::DOUBLE >= 0.04 THEN st.next ELSE st.next + 1 END,
         CASE WHEN u.forced THEN u.f WHEN u.short THEN st.f
              WHEN len(list_intersect(u.f, st.f)) / nullif(len(list_distinct(list_concat(u.f, st.f))), 0)::DOUBLE >= 0.04 THEN list_distinct(list_concat(st.f, u.f)) ELSE u.f END,
         CASE WHEN u.forced THEN true WHEN u.short THEN false
              ELSE NOT coalesce(len(list_intersect(u.f, st.f)) / nullif(len(list_distinct(list_concat(u.f, st.f))), 0)::DOUBLE >= 0.04, false) END
  FROM st JOIN u ON u.session_id = st.session_id AND u.turn = st.turn + 1
), seg AS (
  SELECT session_id, turn, topic::INT AS topic_id, is_switch FROM st
)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.turn_log(S.read(spark, sf_dir, "conversations"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _log(spark, sf_dir).where("seq = 0 and role = 'user'")
    return topics.segment(users.select("session_id", "turn", F.col("elm").alias("message"), "fct"))


@query(f"WITH RECURSIVE {LOG}, {SEGMENTS} SELECT * FROM seg")
def topic_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"""WITH RECURSIVE {LOG}, {SEGMENTS}, lagged AS (
  SELECT *, lag(topic_id) OVER (PARTITION BY session_id ORDER BY turn) AS closed FROM seg
), n AS (SELECT session_id, topic_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM seg GROUP BY ALL)
SELECT l.session_id, l.turn AS switch_turn, l.closed AS topic_id, l.topic_id AS opened, n.n_turns, n.first_turn, n.last_turn
FROM lagged l JOIN n ON n.session_id = l.session_id AND n.topic_id = l.closed WHERE l.is_switch""")
def topic_switches(spark, sf_dir):
    found = topics.switches(_segments(spark, sf_dir))
    return found.select("session_id", "switch_turn", "topic_id", "opened", F.size("turns").cast("long").alias("n_turns"), F.array_min("turns").alias("first_turn"), F.array_max("turns").alias("last_turn"))


@query(f"""WITH RECURSIVE {LOG}, {SEGMENTS}, m AS (SELECT session_id, max(turn) AS turn FROM seg GROUP BY 1), o AS (SELECT seg.session_id, seg.topic_id FROM seg JOIN m USING (session_id, turn))
SELECT session_id, topic_id, count(*) AS n_turns FROM seg JOIN o USING (session_id, topic_id) GROUP BY ALL""")
def open_blocks(spark, sf_dir):
    return topics.open_blocks(_segments(spark, sf_dir)).select("session_id", "topic_id", F.size("turns").cast("long").alias("n_turns"))


@query(f"WITH {LOG} SELECT session_id, turn, seq, role, elm FROM log")
def session_scan(spark, sf_dir):
    return _log(spark, sf_dir).select("session_id", "turn", "seq", "role", "elm")


@query(f"""WITH {LOG}, f AS (SELECT session_id, turn + 1 AS turn, arg_max(fct, seq) AS p FROM log WHERE fin GROUP BY 1, 2)
SELECT t.session_id, t.turn, CASE WHEN t.turn > 0 THEN coalesce(f.p, '') ELSE '' END AS prev_fct FROM (SELECT DISTINCT session_id, turn FROM log) t LEFT JOIN f USING (session_id, turn)""")
def prev_fin(spark, sf_dir):
    return log.previous_summary(_log(spark, sf_dir))


@query(f"""WITH {LOG}, f AS (SELECT session_id, turn, seq AS fin_seq, coalesce(lag(seq) OVER (PARTITION BY session_id, turn ORDER BY seq), -1) AS last FROM log WHERE fin)
SELECT f.session_id, f.turn, f.fin_seq, l.seq, l.role FROM f JOIN log l ON l.session_id = f.session_id AND l.turn = f.turn
WHERE l.role = 'user' OR (l.seq > f.last AND l.seq <= f.fin_seq)""")
def incremental_frame(spark, sf_dir):
    return log.incremental_frames(_log(spark, sf_dir)).select("session_id", "turn", "fin_seq", "seq", "role")


@query(f"WITH {LOG} SELECT session_id, turn, arg_min(elm, seq) AS question FROM log WHERE role = 'user' GROUP BY 1, 2")
def first_questions(spark, sf_dir):
    return log.first_questions(_log(spark, sf_dir))


@query(f"""WITH {LOG}, u AS (SELECT DISTINCT session_id, turn FROM log WHERE role = 'user'), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM u)
SELECT session_id, turn FROM r WHERE k <= 2""")
def tail_turns(spark, sf_dir):
    return log.tail_turns(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT session_id, max(turn) AS max_turn FROM log GROUP BY 1")
def max_turn(spark, sf_dir):
    return log.max_turns(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT coalesce(sum(m), 0)::BIGINT AS global_turn_max FROM (SELECT max(turn) AS m FROM log GROUP BY session_id)")
def global_turn_max(spark, sf_dir):
    return log.global_turn_max(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT session_id, count(*) AS rows FROM log GROUP BY 1 HAVING count(*) > 3")
def discover_sessions(spark, sf_dir):
    return log.discover_sessions(_log(spark, sf_dir))


@query(f"""WITH RECURSIVE {LOG}, {SEGMENTS}
SELECT seg.session_id, seg.topic_id, arg_min(substr(trim(log.elm), 1, 500), seg.turn) AS query FROM seg JOIN log ON log.session_id = seg.session_id AND log.turn = seg.turn
WHERE log.seq = 0 AND log.role = 'user' AND trim(log.elm) <> '' GROUP BY 1, 2""")
def block_first_query(spark, sf_dir):
    return log.block_first_query(_log(spark, sf_dir), _segments(spark, sf_dir))


@query(f"""WITH {LOG} SELECT session_id, turn, '[事务 #' || turn || ']' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' || elm ELSE 'Assistant: ' || elm END, chr(10) ORDER BY seq) AS frame FROM log GROUP BY 1, 2""")
def transaction_frames(spark, sf_dir):
    return log.frames(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT session_id, turn, seq, ((length(elm) + coalesce(length(hdl), 0)) // 4)::BIGINT AS tokens FROM log")
def token_estimate(spark, sf_dir):
    return _log(spark, sf_dir).select("session_id", "turn", "seq", T.token_estimate(F.col("elm"), F.col("hdl")).alias("tokens"))


@query("""SELECT conv_id, n, round(CASE WHEN n <= 5000 THEN 0.0 WHEN n >= 20000 THEN 0.3 ELSE (n - 5000) / 15000.0 * 0.3 END, 9)::DOUBLE AS pressure
FROM (SELECT conv_id, (sum(length(text)) * 8)::BIGINT AS n FROM conversations GROUP BY 1)""")
def pressure_by_length(spark, sf_dir):
    rows = S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) * 8).alias("n"))
    return rows.select("conv_id", "n", F.round(topics.water_pressure(F.col("n")), 9).alias("pressure"))


_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_]+|[^\\x00-\\x7f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{1680}}]')"


@query(f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents WHERE trim(text) <> ''), p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY 1""")
def token_stats(spark, sf_dir):
    return search.token_stats(S.read(spark, sf_dir, "documents"), "doc_id", "text")


def _bm25(spark, sf_dir, k: int):
    return search.bm25_best(S.read(spark, sf_dir, "documents"), S.read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k)


_BM25 = f"""
t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents WHERE trim(text) <> ''),
p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2),
dl AS (SELECT doc_id, len({_TOKENS.format('text')}) AS dl FROM documents WHERE trim(text) <> ''),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT q.item_id AS q, p.doc_id AS doc, sum(q.times * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * dl.dl / s.avgdl))) AS score
  FROM q JOIN p USING (token) JOIN df USING (token) JOIN dl ON dl.doc_id = p.doc_id CROSS JOIN s GROUP BY 1, 2)
"""


@query(f"""WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) - 1 AS rank FROM bm WHERE score > 0)
SELECT q, doc, round(score, 4) AS score, rank FROM r WHERE rank < 10""")
def bm25_topk(spark, sf_dir):
    scores = _bm25(spark, sf_dir, 10).withColumn("r6", F.round("score", 6))
    return search.ranked(scores, "r6", limit=10).select("q", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_COS = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
cs AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0)
"""


def _cosines(spark, sf_dir, best: int):
    e = S.read(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    return search.cosine_scores(e, asked, "vec_id", "embedding", "vec_id", "embedding", best).withColumn("score", F.round("score", 6))


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) - 1 AS rank FROM cs) SELECT q, doc, score, rank FROM r WHERE rank < 10")
def cosine_topk(spark, sf_dir):
    return search.ranked(_cosines(spark, sf_dir, 10), "score", limit=10).select("q", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25}, h AS (SELECT b.item_id AS q, count(bm.doc) AS bm25_hits FROM benchmark b LEFT JOIN bm ON bm.q = b.item_id AND bm.score > 0 GROUP BY 1)
SELECT q, bm25_hits, least(CASE WHEN bm25_hits >= 5 THEN 6 WHEN bm25_hits >= 2 THEN 4 ELSE 2 END, 10)::INT AS bm25_k,
       least(10 - least(CASE WHEN bm25_hits >= 5 THEN 6 WHEN bm25_hits >= 2 THEN 4 ELSE 2 END, 10), 3)::INT AS vec_k FROM h""")
def dynamic_slots(spark, sf_dir):
    hits = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q")).join(_bm25(spark, sf_dir, 1).select("q", F.col("hits").alias("bm25_hits")), "q", "left")
    hits = hits.withColumn("bm25_hits", F.coalesce("bm25_hits", F.lit(0).cast("long")))
    s = search.allocation(F.col("bm25_hits"), F.lit(3), F.lit(10))
    return hits.select("q", "bm25_hits", s["bm25"].alias("bm25_k"), s["vec"].alias("vec_k"))


@query(f"""WITH {_COS}, a AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) - 1 AS rank FROM cs),
b AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY abs(q - doc), doc) - 1 AS rank FROM cs),
l AS (SELECT q, 0 AS list, rank, doc FROM a WHERE rank < 6 UNION ALL SELECT q, 1, rank, doc FROM b WHERE rank < 4),
f AS (SELECT q, doc, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM l GROUP BY 1, 2)
SELECT q, doc, round(score, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, first) - 1 AS rank FROM f""")
def rrf_fusion(spark, sf_dir):
    a = search.ranked(_cosines(spark, sf_dir, 6), "score", limit=6).select("q", F.lit(0).alias("list"), "rank", "doc")
    # A row's nearest four by number are among the four places before and after it, of the vectors of its length.
    rows = S.read(spark, sf_dir, "embeddings").where("embedding is not null").select(F.size("embedding").alias("len"), F.col("vec_id").alias("doc"))
    placed = written(numbered(rows, ["len", "doc"]), "vector-places")
    asked = placed.where("doc % 50 = 0").select(F.col("doc").alias("q"), "len", F.explode(F.sequence(F.col("n") - 4, F.col("n") + 4)).alias("n"))
    b = search.ranked(asked.join(placed, ["len", "n"]).withColumn("near", -F.abs(F.col("q") - F.col("doc"))), "near", limit=4).select("q", F.lit(1).alias("list"), "rank", "doc")
    return search.fuse(a.unionByName(b)).select("q", "doc", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_BM25}, b AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) - 1 AS rank FROM bm WHERE score > 0),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT x.vec_id AS q, y.vec_id AS doc, list_cosine_similarity(x.v, y.v) AS score FROM e x JOIN benchmark ON item_id = x.vec_id JOIN e y ON len(x.v) = len(y.v) JOIN documents ON doc_id = y.vec_id),
v AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, doc) - 1 AS rank FROM c),
h AS (SELECT item_id AS q, (SELECT count(*) FROM b WHERE b.q = item_id) AS bh, (SELECT count(*) FROM c WHERE c.q = item_id) AS vh FROM benchmark),
sl AS (SELECT q, CASE WHEN bh >= 5 THEN 6 WHEN bh >= 2 THEN 4 ELSE 2 END AS bk, vh FROM h),
l AS (SELECT b.q, 0 AS list, b.rank, b.doc FROM b JOIN sl USING (q) WHERE b.rank < sl.bk UNION ALL SELECT v.q, 1, v.rank, v.doc FROM v JOIN sl USING (q) WHERE v.rank < least(10 - sl.bk, sl.vh)),
f AS (SELECT q, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, first) - 1 AS rank FROM f)
SELECT q, doc, round(score, 9) AS score, rank FROM r WHERE rank < 10""")
def hybrid_retrieve(spark, sf_dir):
    docs = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    vectors = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding").join(docs, "doc")
    asked = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"))
    lookups = S.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")).join(asked, "q")
    cosines = search.cosine_scores(vectors, lookups, "doc", "embedding", "q", "qv", best=10).withColumn("score", F.round("score", 12))
    return search.retrieve(_bm25(spark, sf_dir, 10).withColumn("score", F.round("score", 6)), cosines, asked).select("q", "doc", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _geometry(spark, sf_dir):
    e = S.read(spark, sf_dir, "embeddings").where("label is not null").select("label", V.doubles(F.col("embedding")).alias("v"))
    return topics.topic_geometry(e, [], "label", "v")


_GEOMETRY = """
x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
c0 AS (SELECT label, i, avg(v[i]) AS m FROM x, range(1, 65) t(i) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS norm FROM c0 GROUP BY 1),
mi AS (SELECT x.label, max(1 - list_cosine_similarity(x.v, c.c)) AS m FROM x JOIN c USING (label) GROUP BY 1),
ne AS (SELECT a.label, min(1 - list_cosine_similarity(a.c, b.c)) AS nearest FROM c a JOIN c b ON b.label < a.label GROUP BY 1),
geo AS (SELECT c.label, c.c, CASE WHEN mi.m > 0 THEN mi.m ELSE 0.05 END AS max_intra, coalesce(ne.nearest, 0) AS nearest FROM c LEFT JOIN mi USING (label) LEFT JOIN ne USING (label))
"""


@query(f"WITH {_GEOMETRY} SELECT label, round(max_intra, 6) AS max_intra, round(nearest, 6) AS nearest FROM geo")
def topic_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir).select("label", F.round("max_intra", 6).alias("max_intra"), F.round("nearest", 6).alias("nearest"))


@query("""SELECT label, i::INT AS i, round(m / norm, 6) AS x FROM (SELECT label, i, avg(v[i + 1]) AS m, sqrt(sum(avg(v[i + 1]) * avg(v[i + 1])) OVER (PARTITION BY label)) AS norm
FROM (SELECT label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL), range(0, 64) t(i) GROUP BY 1, 2)""")
def label_centroids(spark, sf_dir):
    return _geometry(spark, sf_dir).select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query(f"""WITH {_GEOMETRY}, q AS (SELECT vec_id, v FROM x), r AS (
  SELECT q.vec_id, geo.label, round(1 - list_cosine_similarity(q.v, geo.c), 9) AS d,
         round(CASE WHEN nearest > 0 THEN CASE WHEN max_intra > 0 THEN least(max_intra, nearest / 2) ELSE nearest / 2 END ELSE max_intra END, 9) AS r0 FROM q CROSS JOIN geo
) SELECT vec_id, label, CASE WHEN d <= CASE WHEN r0 <= 0 THEN 0.05 ELSE r0 END / 2 THEN 'Act' WHEN d <= CASE WHEN r0 <= 0 THEN 0.05 ELSE r0 END THEN 'Rel' ELSE 'Far' END AS grade FROM r""")
def radius_grades(spark, sf_dir):
    asked = S.read(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", V.doubles(F.col("embedding")).alias("qv"))
    geo = _geometry(spark, sf_dir)
    # Topics are one row a label, and small enough to broadcast by their summed components, or else dealt in blocks.
    return V.beside(asked, "vec_id", geo, "centroid", F.size("centroid")).select("vec_id", "label", topics.radius_grade(F.col("qv"), F.col("centroid"), F.col("max_intra"), F.col("nearest"), F.lit(False)).alias("grade"))


def _graded(spark, sf_dir):
    """Segments with a grade for each closed topic: by its age in topics, for want of vectors."""
    seg = _segments(spark, sf_dir)
    top = seg.groupBy("session_id").agg(F.max("topic_id").alias("top"))
    rows = seg.join(top, "session_id").withColumn("age", F.col("top") - F.col("topic_id"))
    grade = F.when(F.col("age") == 0, "Act").when(F.col("age") == 1, "Rel").otherwise("Far")
    return rows.select("session_id", "turn", grade.alias("grade"))


_HISTORY = f"""{LOG}, {SEGMENTS}, top AS (SELECT session_id, max(topic_id) AS top FROM seg GROUP BY 1),
g AS (SELECT seg.session_id, seg.turn, CASE WHEN top - topic_id = 0 THEN 'Act' WHEN top - topic_id = 1 THEN 'Rel' ELSE 'Far' END AS grade FROM seg JOIN top USING (session_id)),
tl AS (SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 2 AS tail FROM (SELECT DISTINCT session_id, turn FROM log WHERE role = 'user')),
h AS (SELECT log.*, coalesce(g.grade, 'Act') AS grade, coalesce(tl.tail, false) AS tail FROM log LEFT JOIN g USING (session_id, turn) LEFT JOIN tl USING (session_id, turn))"""


@query(f"""WITH RECURSIVE {_HISTORY} SELECT session_id, turn, seq, role,
CASE WHEN tail THEN 'Elm' WHEN role = 'user' OR fin THEN CASE grade WHEN 'Act' THEN 'Elm' WHEN 'Rel' THEN 'Fct' ELSE 'Hdl' END ELSE CASE grade WHEN 'Act' THEN 'Fct' ELSE 'Hdl' END END AS level
FROM h WHERE tail OR role = 'user' OR fin OR grade <> 'Far'""")
def history_levels(spark, sf_dir):
    turns = _log(spark, sf_dir)
    return history.levels(turns, _graded(spark, sf_dir)).select("session_id", "turn", "seq", "role", "level")


_CONTENT = """CASE level WHEN 'Elm' THEN elm WHEN 'Fct' THEN coalesce(fct, '') ELSE CASE WHEN head = '' THEN '略' ELSE head END END"""


@query(rf"""WITH RECURSIVE {_HISTORY}, lv AS (SELECT *, CASE WHEN tail THEN 'Elm' WHEN role = 'user' OR fin THEN CASE grade WHEN 'Act' THEN 'Elm' WHEN 'Rel' THEN 'Fct' ELSE 'Hdl' END ELSE CASE grade WHEN 'Act' THEN 'Fct' ELSE 'Hdl' END END AS level,
CASE WHEN length(coalesce(hdl, '')) <= 150 THEN coalesce(hdl, '') END AS head FROM h WHERE tail OR role = 'user' OR fin OR grade <> 'Far')
SELECT session_id, count(*)::INT AS n_messages, string_agg(turn || '/' || seq || ' ' || role || ': ' || {_CONTENT}, chr(10) ORDER BY turn, seq) AS history FROM lv GROUP BY 1""")
def history_assembly(spark, sf_dir):
    found = history.assemble(_log(spark, sf_dir), _graded(spark, sf_dir))
    line = lambda m: F.concat(m["turn"].cast("string"), F.lit("/"), m["seq"].cast("string"), F.lit(" "), m["role"], F.lit(": "), m["content"])
    return found.select("session_id", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", line), "\n").alias("history"))


_DELTAS = """d AS (SELECT user_id::VARCHAR AS session_id, strftime(ts, '%Y%m%d') AS request_id, event_id, CASE WHEN ascii(event_type) % 2 = 0 THEN 'reasoning' ELSE 'text' END AS kind, floor(abs(value))::BIGINT AS chars FROM events)"""


@query(f"""WITH {_DELTAS} SELECT session_id, request_id, count(*) AS chunk_count, coalesce(sum(CASE WHEN kind = 'reasoning' THEN chars END), 0)::BIGINT AS reasoning_chars, coalesce(sum(CASE WHEN kind = 'text' THEN chars END), 0)::BIGINT AS text_chars FROM d GROUP BY 1, 2""")
def stream_counters(spark, sf_dir):
    from tracewell.streaming import counters

    return counters.count_deltas(S.stream_events(S.read(spark, sf_dir, "events")))


@query(f"""WITH {_DELTAS}, e AS (SELECT *, CASE WHEN kind = 'text' THEN chars END AS t, CASE WHEN kind = 'reasoning' THEN chars END AS r FROM d)
SELECT session_id, request_id, coalesce(max(r), 0)::BIGINT AS reasoning_chars, coalesce(max(t), 0)::BIGINT AS text_chars, arg_max(kind, event_id) AS model,
CASE WHEN arg_max(chars % 7, event_id) = 0 THEN 'failed' ELSE 'completed' END AS status FROM e GROUP BY 1, 2""")
def llm_call_fold(spark, sf_dir):
    d = S.stream_events(S.read(spark, sf_dir, "events"))
    null = lambda t: F.lit(None).cast(t)
    events = d.select(
        "session_id", "request_id", F.col("event_id").alias("event_no"), F.lit("patch").alias("kind"), null("long").alias("turn"), null("string").alias("provider"), F.col("kind").alias("model"),
        null("long").alias("messages_count"), null("long").alias("input_chars"), F.when(F.col("kind") == "reasoning", F.col("chars")).alias("reasoning_chars"),
        F.when(F.col("kind") == "text", F.col("chars")).alias("text_chars"), F.lit(1).alias("chunk_count"), null("string").alias("tool_calls_json"), null("string").alias("usage_json"),
        null("string").alias("finish_kind"), null("long").alias("duration_ms"), null("string").alias("failure_json"), null("string").alias("status"),
        (F.col("chars") % 7 != 0).alias("finished"), null("string").alias("error"),
    )
    return log.current_calls(events).select("session_id", "request_id", "reasoning_chars", "text_chars", "model", "status")


@query("""WITH e AS (SELECT user_id::VARCHAR AS session_id, (event_id % 20)::BIGINT AS turn, event_id, event_type AS elm, CASE WHEN event_id % 3 = 0 THEN props END AS fct FROM events),
i AS (SELECT *, CASE WHEN elm IS DISTINCT FROM lag(elm) OVER w THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY session_id, turn ORDER BY event_id)),
j AS (SELECT *, sum(new) OVER (PARTITION BY session_id, turn ORDER BY event_id) AS island FROM i),
l AS (SELECT session_id, turn, max(island) AS island FROM j GROUP BY 1, 2)
SELECT j.session_id, j.turn, 0::BIGINT AS seq, arg_max(j.elm, j.event_id) AS elm, arg_max(j.fct, CASE WHEN j.fct IS NOT NULL THEN j.event_id END) AS fct FROM j JOIN l USING (session_id, turn, island) GROUP BY 1, 2""")
def turn_current(spark, sf_dir):
    e = S.read(spark, sf_dir, "events")
    events = e.select(
        F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 20).cast("long").alias("turn"), F.lit(0).cast("long").alias("seq"), F.col("event_id").alias("event_no"),
        F.lit("write").alias("kind"), F.col("event_type").alias("elm"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("fct"), F.lit(None).cast("string").alias("hdl"), F.lit(0.0).alias("written_at"),
    )
    return log.current_turns(events).select("session_id", "turn", "seq", "elm", "fct")


@query(r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{ff00}-\x{ffef}]') AS c, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*|[0-9]+') AS w FROM documents)
SELECT doc_id, len(list_distinct(list_concat(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i::INT] || c[(i + 1)::INT])), w)))::INT AS n_features FROM c""")
def topic_feature_counts(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.size(T.topic_features(F.col("text"))).alias("n_features"))
