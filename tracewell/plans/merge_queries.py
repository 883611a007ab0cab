"""Registered queries of the merge of work-lines into work objects as a whole; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.functions import vector as V
from tracewell.operators import history, merge
from tracewell.sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Three neighbouring vectors are a block of work-lines, every 25th vector is an object that is there; parts give the contents.
# The SQL steps through the blocks one by one; each step carries all objects and the mapping so far.
_RUN = """e AS (SELECT vec_id, vec_id // 3 AS b, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
o AS (SELECT list({'id': vec_id, 'v': v} ORDER BY vec_id) AS objs, max(vec_id) AS top FROM e WHERE vec_id % 25 = 0),
k AS (SELECT row_number() OVER (ORDER BY b) AS n, list({'s': vec_id, 'v': v} ORDER BY vec_id) AS ss FROM e WHERE vec_id % 25 <> 0 GROUP BY b),
r AS (
  SELECT 0::BIGINT AS n, objs, top, []::STRUCT(strand_id BIGINT, reality_id BIGINT, made BOOLEAN)[] AS m FROM o
  UNION ALL
  SELECT n, list_concat(objs, list_transform(fresh, lambda x, i: {'id': top + i, 'v': x.v})), top + len(fresh),
    list_concat(m, list_transform(f, lambda x: {'strand_id': x.s, 'reality_id': coalesce(x.t, top + list_position(list_transform(fresh, lambda y: y.s), x.s)), 'made': x.t IS NULL}))
  FROM (SELECT *, list_filter(f, lambda x: x.t IS NULL) AS fresh FROM (
    SELECT k.n, r.objs, r.top, r.m, list_transform(k.ss, lambda s: {'s': s.s, 'v': s.v, 't': CASE WHEN s.s % 5 <> 0 THEN
      list_sort(list_filter(list_transform(r.objs, lambda x: {'d': 1 - list_cosine_similarity(s.v, x.v), 'id': x.id}), lambda x: x.d <= 0.65))[1:3][(s.s % 2 + 1)::BIGINT].id END}) AS f
    FROM r JOIN k ON k.n = r.n + 1))
), mp AS (SELECT unnest(m, max_depth := 2) FROM (SELECT m FROM r ORDER BY n DESC LIMIT 1))"""
_FOR_QUERIES = Config(s_keep=0.65)  # the tables' vectors lie far apart


def _strands(spark, sf_dir) -> DataFrame:
    parts = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name", "p_type", "p_brand")
    rows = S.read(spark, sf_dir, "embeddings").where("embedding is not null and vec_id % 25 <> 0").join(parts, "vec_id", "left")
    block, none = F.floor(F.col("vec_id") / 3), F.expr("cast(array() as array<string>)")
    ooda = F.struct(F.array("p_name", "p_type").alias("现象与问题"), none.alias("背景与约束"), none.alias("决策与方案"), none.alias("后续行动"))
    vec = V.doubles(F.col("embedding"))
    return rows.select(
        block.alias("block_no"), F.col("vec_id").alias("strand_id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("session_id"), block.alias("topic_id"), F.array(-F.col("vec_id")).alias("turns"),
        F.concat(F.lit("line "), F.col("vec_id").cast("string")).alias("hdl"), ooda.alias("ooda"), F.when(F.col("vec_id") % 4 == 0, F.array("p_brand")).alias("changes"), vec.alias("centroid"), vec.alias("query_vec"),
    )


def _merged(spark, sf_dir) -> merge.Merged:
    rows = S.read(spark, sf_dir, "embeddings").where("embedding is not null and vec_id % 25 = 0")
    null = lambda t: F.lit(None).cast(t)
    objects = rows.select(
        F.col("vec_id").alias("reality_id"), F.lit("old").alias("name"), F.lit("").alias("hdl"), null(S.STATUS).alias("current_status"), null(S.TIMELINE).alias("timeline"),
        null("map<string,array<bigint>>").alias("source_strands"), V.doubles(F.col("embedding")).alias("centroid"), null("array<double>").alias("query_centroid"), null("bigint").alias("query_count"),
    )
    decide = lambda found: found.select("strand_id").distinct().select("strand_id", F.when(F.col("strand_id") % 5 != 0, "merge").otherwise("new").alias("action"), (F.col("strand_id") % 2).alias("target"))
    return merge.merge_in_waves(_strands(spark, sf_dir), objects, decide, _FOR_QUERIES)


@query(f"WITH RECURSIVE {_RUN} SELECT strand_id, reality_id FROM mp")
def merged_blocks(spark, sf_dir):
    return _merged(spark, sf_dir).mapping.select("strand_id", "reality_id")


@query(f"""WITH RECURSIVE {_RUN}, j AS (SELECT mp.*, strand_id // 3 AS b, p_name, p_type, CASE WHEN strand_id % 4 = 0 THEN p_brand END AS change, 's' || label AS session, embedding::DOUBLE[] AS v FROM mp JOIN embeddings ON vec_id = strand_id LEFT JOIN part ON p_partkey = vec_id),
i AS (SELECT reality_id, b, item, min((-strand_id, pos)) AS first FROM (SELECT reality_id, b, strand_id, unnest([p_name, p_type]) AS item, unnest([1, 2]) AS pos FROM j) WHERE trim(item) <> '' GROUP BY 1, 2, 3),
s AS (SELECT reality_id, list(item ORDER BY b, first)[1:5] AS items FROM i GROUP BY 1),
g AS (SELECT reality_id, b, bool_or(made) AS made, string_agg(change, '+' ORDER BY -strand_id) FILTER (change IS NOT NULL) AS changes, arg_max(p_name, strand_id) AS p_name, arg_max(p_type, strand_id) AS p_type FROM j GROUP BY 1, 2),
t AS (SELECT reality_id, string_agg(coalesce(CASE WHEN made THEN p_name || ' ' || p_type ELSE p_name END, '') || coalesce('/' || changes, ''), ';' ORDER BY b) AS line FROM g GROUP BY 1),
c AS (SELECT reality_id, count(*) AS query_count, sum(list_sum(v)) / count(*) AS middle, count(DISTINCT session) AS sessions FROM j GROUP BY 1)
SELECT reality_id, query_count, round(middle, 9) AS middle, sessions, coalesce(array_to_string(items, '|'), '') AS state, line FROM c LEFT JOIN s USING (reality_id) JOIN t USING (reality_id)""")
def merged_objects(spark, sf_dir):
    rows = _merged(spark, sf_dir).realities.where("query_count > 0")
    entry = lambda e: F.when(e["changes"].isNotNull(), F.concat(F.lit("/"), F.array_join(e["changes"], "+"))).otherwise(F.concat(F.lit(";"), e["overview"]))
    line = F.substring(F.array_join(F.transform("timeline", entry), ""), 2, 1_000_000_000)
    return rows.select("reality_id", "query_count", F.round(F.aggregate("query_centroid", F.lit(0.0), lambda a, b: a + b), 9).alias("middle"), F.size("source_strands").cast("long").alias("sessions"), F.array_join("current_status.current_state", "|").alias("state"), line.alias("line"))


# Conversations whose log lacks every third message, unless it is the last of a user's; the request holds all that users said.
@query("""WITH c AS (SELECT conv_id, turn, role, trim(text, ' ') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system'),
u AS (SELECT conv_id, max(n) FILTER (role = 'user') AS last FROM c GROUP BY 1),
k AS (SELECT c.*, n % 3 <> 0 OR role <> 'user' OR n = last AS kept FROM c JOIN u USING (conv_id)),
p AS (SELECT *, coalesce(max(CASE WHEN kept AND role = 'user' THEN n END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN kept THEN n ELSE before END, CASE WHEN kept THEN 0 ELSE 1 END, n) AS place FROM p)
SELECT conv_id::VARCHAR AS session_id, place, role, md5(text) AS text FROM o""")
def aligned_users(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = S.read(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").cast("string").alias("session_id"), F.row_number().over(order).alias("n"), "role", F.trim("text").alias("content"))
    user = F.col("role") == "user"
    last = F.max(F.when(user, F.col("n"))).over(Window.partitionBy("session_id"))
    said = F.array_sort(F.collect_list(F.when(user, F.struct("n", "content"))))
    requests = rows.groupBy("session_id").agg(F.transform(said, lambda m: m["content"]).alias("texts"))
    held = rows.withColumn("last", last).where((F.col("n") % 3 != 0) | ~user | (F.col("n") == F.col("last")))
    messages = held.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "content"))).alias("messages"))
    found = history.align_users(messages, requests).select("session_id", F.posexplode("messages").alias("place", "m"))
    return found.select("session_id", (F.col("place") + 1).cast("long").alias("place"), "m.role", F.md5("m.content").alias("text"))
