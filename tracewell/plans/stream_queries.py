"""Registered queries that play the driver's tables back as streams, with the SQL of what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.functions import vector as V
from tracewell.operators import log
from tracewell.sources import tables as S
from tracewell.sources.shared import new_path
from tracewell.sources.sink import BatchTable
from tracewell.streaming import stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _deltas(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "reasoning").otherwise("text")
    e = S.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.floor(F.col("event_id") / 2000).cast("string").alias("request_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.floor(F.abs("value")).cast("long").alias("chars"))


# Every event comes twice, in three batches that have nothing to do with its time.
@query("""WITH d AS (SELECT user_id AS session_id, (event_id // 2000)::BIGINT AS request_id, event_id, event_type, floor(abs(value))::BIGINT AS chars FROM events), s AS (SELECT session_id, request_id, max(CASE WHEN event_type = 'view' THEN event_id END) AS s FROM d GROUP BY 1, 2)
SELECT d.session_id::VARCHAR AS session_id, d.request_id::VARCHAR AS request_id, count(*) AS chunk_count, sum(CASE WHEN event_type = 'click' THEN chars ELSE 0 END)::BIGINT AS reasoning_chars, sum(CASE WHEN event_type <> 'click' THEN chars ELSE 0 END)::BIGINT AS text_chars
FROM d JOIN s USING (session_id, request_id) WHERE event_type <> 'view' AND (s IS NULL OR event_id > s) GROUP BY 1, 2""")
def streamed_counters(spark, sf_dir):
    twice = _deltas(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("turn", F.xxhash64("event_id", "copy"))
    stream = stateful.replay(twice, "deltas", 3, "turn").drop("copy", "turn")
    table = BatchTable(spark, new_path(spark, "counters"), stateful.COUNTERS)
    stateful.run_to(table, stateful.counted_stream(stream, lateness="3650 days"), "counters", "update")
    return stateful.newest(table.read())


# Users are sessions in four shards; each shard holds five, for six hours. A use begins a life if the session's last use is
# longer ago, or five others were used since.
@query("""WITH u AS (SELECT user_id % 4 AS shard, user_id, event_id, ts, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, lag(ts) OVER w AS before, lag(n) OVER w AS m FROM u WINDOW w AS (PARTITION BY user_id ORDER BY n)),
c AS (SELECT p.shard, p.n, count(DISTINCT o.user_id) AS others FROM p JOIN u o ON o.shard = p.shard AND o.n > p.m AND o.n < p.n GROUP BY 1, 2)
SELECT user_id::VARCHAR AS session_id, count(*) AS lives FROM p LEFT JOIN c USING (shard, n) WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR OR coalesce(others, 0) >= 5 GROUP BY 1""")
def streamed_sessions(spark, sf_dir):
    uses = S.read(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("int").alias("shard"), F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    table = BatchTable(spark, new_path(spark, "sessions"), stateful.LIVES)
    stateful.run_to(table, stateful.session_lives(stateful.replay(uses, "uses", 3, "ts"), Config(session_ttl_s=21_600), most=5), "sessions")
    return table.read().where("what = 'new'").groupBy("session_id").agg(F.count("*").alias("lives"))


# Vectors come in three batches; each leaves sums and counts, and the first is written again.
@query("""WITH c AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT label, i, avg(x) AS x FROM c GROUP BY 1, 2) SELECT m.label, round(sum(x), 9) AS total, round(sqrt(sum(x * x)), 9) AS length, any_value(n) AS n FROM m JOIN (SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1) k ON k.label = m.label GROUP BY 1""")
def streamed_centroids(spark, sf_dir):
    rows = S.read(spark, sf_dir, "embeddings").where("label is not null and embedding is not null").select("vec_id", "label", V.doubles(F.col("embedding")).alias("vec"))
    table = BatchTable(spark, new_path(spark, "centroids"), "label int, i int, total double, n long")
    sums = lambda batch: V.sums(batch, ["label"], "vec")
    stateful.run_to(table, stateful.replay(rows, "vectors", 3, "vec_id"), "centroids", each=sums)
    table.write(sums(rows), table.committed()[0])  # again: nothing comes of it
    found = V.mean_of_sums(table.read().drop("batch"), ["label"])
    total = lambda f: F.aggregate("mean", F.lit(0.0), f)
    return found.select("label", F.round(total(lambda a, x: a + x), 9).alias("total"), F.round(F.sqrt(total(lambda a, x: a + x * x)), 9).alias("length"), "n")


# Line items map suppliers' parts to orders in three batches; the newest item of a key stays (of two with one number, the greater), and an earlier batch comes again.
@query("SELECT l_partkey AS strand_id, l_suppkey::BIGINT AS profile, max(l_orderkey * 10 + l_linenumber) AS event_no, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber, l_quantity)) AS reality_id FROM lineitem GROUP BY 1, 2")
def streamed_map(spark, sf_dir):
    rows = S.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("strand_id"), F.col("l_suppkey").cast("long").alias("profile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_no"), F.col("l_quantity").alias("reality_id"))
    table = BatchTable(spark, new_path(spark, "map"), ", ".join(f"{n} {t}" for n, t in rows.dtypes))
    keyed = lambda df: log.latest(df.withColumn("_e", F.struct("event_no", "reality_id")), ["strand_id", "profile"], "_e").select("strand_id", "profile", "event_no", "reality_id")
    stateful.run_to(table, stateful.replay(rows, "items", 3, "strand_id"), "map", each=keyed)
    table.write(keyed(rows), table.committed()[0])
    return keyed(table.read().drop("batch"))
