"""Rules of the engine on literal rows, with SQL that states what they give; compared in ``test_literals.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import docs, graph, log, merge, refine
from tracewell.sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _rows(spark, literal):
    return spark.sql(f"SELECT * FROM {literal}")


_SAYINGS = """(VALUES (1, '换话题吧，看看别的'), (2, '好的'), (3, 'Switching Gears now'), (4, '   ok   '), (5, '这里不对，Fixed it'), (6, 'a plain message of some length'), (7, ''), (8, '根因是配置'), (9, 'prefix of it'), (10, '我们说回正事')) AS t(id, text)"""


@query(f"""SELECT id, regexp_matches(lower(text), '换话题|聊点别的|另一个|说回|下一个问题|还有一个问题|再问一个|别提|不管|换个话题|不说这个|回到正题|说重点|topic switch|switching gears|shift topics|moving on|change of subject') AS forced,
length(trim(text)) <= 5 AS confirmatory, regexp_matches(lower(text), '修正|纠正|更正|推翻|误解|误判|不对|错误诊断|失败原因|根因|修复|incorrect|wrong|fix') AS correction FROM {_SAYINGS}""")
def message_signals(spark, sf_dir):
    t = F.col("text")
    return _rows(spark, _SAYINGS).select("id", T.is_forced(t).alias("forced"), T.is_confirmatory(t).alias("confirmatory"), T.has_correction(t).alias("correction"))

_MIXED = """(VALUES (1, '部署 Spark 集群 on k8s_node, 升级到 3.5'), (2, '数据湖表格式 Iceberg 与 Delta'), (3, 'nothing CJK Here_too'), (4, '一'), (5, '')) AS t(id, text)"""


@query(r"""WITH r AS (SELECT id, unnest(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+')) AS run FROM """ + _MIXED + r"""),
p AS (SELECT id, substr(run, i::INT, 2) AS f FROM r, range(1, 100) t(i) WHERE i < length(run) UNION ALL SELECT id, lower(w) AS f FROM (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS w FROM """ + _MIXED + """)) SELECT id, f, count(*) AS n FROM p GROUP BY 1, 2""")
def mixed_pairs(spark, sf_dir):
    return _rows(spark, _MIXED).select("id", F.explode(T.mixed_pairs(F.col("text"))).alias("f")).groupBy("id", "f").agg(F.count("*").alias("n"))


@query(r"""WITH c AS (SELECT id, regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{ff00}-\x{ffef}]') AS c, lower(text) AS low FROM """ + _MIXED + r"""),
f AS (SELECT id, unnest(c) AS f FROM c UNION SELECT id, c[i::INT] || c[(i + 1)::INT] FROM c, range(1, 100) t(i) WHERE i < len(c) UNION SELECT id, unnest(regexp_extract_all(low, '[a-z_][a-z0-9_]*|[0-9]+')) FROM c) SELECT id, f FROM f""")
def topic_features(spark, sf_dir):
    return _rows(spark, _MIXED).select("id", F.explode(T.topic_features(F.col("text"))).alias("f"))


@query(r"""SELECT id, unnest(list_distinct(list_concat(list_concat(list_transform(regexp_extract_all(text, '[A-Z][a-z]{2,}'), lambda w: lower(w)), regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{2,}')), regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2}')))) AS kw FROM """ + _MIXED)
def link_keywords(spark, sf_dir):
    return _rows(spark, _MIXED).select("id", F.explode(T.identifier_keywords(F.col("text"))).alias("kw"))

_ANCHORED = """(VALUES (1, 'On 2024-05-06 we read 12.5 GB from data/in.json with Spark'), (2, 'the plan and 300 ms'), (3, ''), (4, '耗时 20 分钟, see https://x.org/a?b=1')) AS t(id, text)"""


@query("""SELECT * FROM (VALUES (1, '2024-05-06'), (1, '12.5 gb'), (1, 'data/in.js'), (1, 'read'), (1, 'spark'), (1, 'data'), (1, 'json'), (2, 'plan'), (2, '300 ms'), (4, '20 分钟'), (4, 'https://x.org/a?b=1'), (4, 'https')) AS t(id, anchor)""")
def lexical_anchors(spark, sf_dir):
    return _rows(spark, _ANCHORED).select("id", F.explode(T.anchors(F.col("text"))).alias("anchor"))

_REPEATS = "(VALUES (1, 'abc|cba|abd|  |xyz|zyxx'), (2, ''), (3, 'same|same')) AS t(id, items)"


@query("SELECT * FROM (VALUES (1, 0, 'abc'), (1, 1, 'abd'), (1, 2, 'xyz'), (3, 0, 'same')) AS t(id, i, item)")
def near_equal_items(spark, sf_dir):
    return _rows(spark, _REPEATS).select("id", F.posexplode(T.greedy_distinct(F.split("items", "\\|"))).alias("i", "item"))

_PROVIDERS = """(VALUES (1, ' acme ', 'gpt-4', ''), (2, '', 'gpt-4', ''), (3, '', 'claude-x', ''), (4, '', 'm', 'http://localhost:1/v1'), (5, '', 'm', ''), (6, '', '', 'https://openrouter.ai'), (7, '', 'deepseek-r1', 'http://127.0.0.1')) AS t(id, provider, model, base)"""


@query("SELECT * FROM (VALUES (1, 'acme'), (2, 'openai'), (3, 'anthropic'), (4, 'local'), (5, 'unknown'), (6, 'openrouter'), (7, 'deepseek')) AS t(id, found)")
def providers(spark, sf_dir):
    return _rows(spark, _PROVIDERS).select("id", log.infer_provider(F.col("provider"), F.col("model"), F.col("base")).alias("found"))

_LINES = """(VALUES (1, 's', 1, 'skip this', 'a', 'f', 3), (2, 's', 1, 'first', 'a|b', '', 2), (3, 's', 1, 'second', '', 'f', 5), (4, 's', 2, 'empty', '', '', 1), (5, 't', 1, 'alone', 'x', '', 9)) AS t(strand_id, session_id, topic_id, hdl, seen, facts, turn)"""


def _split(c):
    return F.filter(F.split(c, "\\|"), lambda x: x != "")


def _lines(spark):
    none = F.expr("cast(array() as array<string>)")
    ooda = F.struct(_split("seen").alias("现象与问题"), none.alias("背景与约束"), none.alias("决策与方案"), none.alias("后续行动"))
    return _rows(spark, _LINES).select("strand_id", "session_id", "topic_id", "hdl", ooda.alias("ooda"), _split("facts").alias("key_facts"), F.array("turn").alias("turns"))


@query(f"WITH k AS (SELECT * FROM {_LINES} WHERE hdl NOT LIKE 'skip%' AND (seen <> '' OR facts <> '')) SELECT session_id, topic_id, arg_min(hdl, turn) AS name, arg_max(hdl, turn) AS hdl, count(*) AS n_strands FROM k GROUP BY 1, 2")
def blocks_with_content(spark, sf_dir):
    return merge.blocks_to_realities(_lines(spark))


@query(f"SELECT strand_id, left(hdl, 60) AS name, len(list_filter(str_split(seen, '|'), lambda x: x <> ''))::INT AS n_state, array_to_string(list_filter(str_split(seen, '|'), lambda x: x <> '')[1:2], ' ') AS overview FROM {_LINES}")
def created_objects(spark, sf_dir):
    return merge.create_fallback(_lines(spark)).select("strand_id", "name", F.size("current_status.current_state").alias("n_state"), "overview")


@query(f"SELECT strand_id, hdl AS title, array_to_string(list_filter(str_split(seen, '|'), lambda x: x <> '')[1:3], '；') AS overview FROM {_LINES}")
def created_themes(spark, sf_dir):
    made = merge.theme_create_fallback(_lines(spark))
    return made.select("strand_id", "title", merge.pad_overview(F.col("overview"), F.col("ooda")).alias("overview"))


@query(f"SELECT topic_id AS theme_id, '归并: ' || string_agg(hdl, '；' ORDER BY strand_id) AS timeline_overview FROM {_LINES} GROUP BY 1 UNION ALL SELECT 9, ''")
def merged_theme_lines(spark, sf_dir):
    lines = _lines(spark).select(F.col("topic_id").alias("theme_id"), "strand_id", "hdl")
    themes = lines.select("theme_id").distinct().unionByName(spark.sql("SELECT 9 AS theme_id"))
    return merge.theme_merge_fallback(themes, lines)

_SECTIONS = """(VALUES (1, 'a|b|c|d|e|f', 'g'), (2, 'Spark 3 GB|plain', 'Spark 3 GB|new words'), (3, '', 'x'), (4, 'alpha beta gamma delta', 'omega'), (5, 'one|two|three', ' ONE |four| |five')) AS t(id, old, new)"""


@query("""SELECT * FROM (VALUES (1, 'a|b|c|d|e', 'trivial_shrink', 'g', 1.0::DOUBLE), (2, 'Spark 3 GB|plain|Spark 3 GB|new words', 'low_anchor_coverage', 'new words', 0.6666666666666666::DOUBLE), (3, 'x', NULL, 'x', 1.0::DOUBLE),
(4, 'alpha beta gamma delta|omega', 'low_anchor_coverage', 'omega', 0.0::DOUBLE), (5, 'one|two|three| ONE |four', 'low_anchor_coverage', 'four|five', 0.0::DOUBLE)) AS t(id, merged, guard, added, coverage)""")
def section_rules(spark, sf_dir):
    old, new = _split("old"), F.filter(F.split("new", "\\|"), lambda x: x != "")
    return _rows(spark, _SECTIONS).select(
        "id", F.array_join(merge.merge_fallback(old, new), "|").alias("merged"), merge.merge_guard(old, new).alias("guard"), F.array_join(merge.fresh_items(old, new, 5), "|").alias("added"), merge.anchor_coverage(old, new).alias("coverage")
    )


@query("""SELECT * FROM (VALUES (1, 'plain words 2024-01-02|Alpha beta|Gamma|a|c', 'current_state'), (2, 'a|b', '')) AS t(id, current_state, oversized)""")
def section_limits(spark, sf_dir):
    rows = spark.sql("SELECT id, named_struct('current_state', split(t, '\\\\|'), 'key_facts', array('x'), 'goals', array('g'), 'context', cast(array() as array<string>)) AS status FROM (VALUES (1, 'a|Alpha beta|plain words 2024-01-02|c|d|Gamma|b'), (2, 'a|b')) AS t(id, t)")
    kept = merge.enforce_limits(F.col("status"))["current_state"]
    return rows.select("id", F.array_join(kept, "|").alias("current_state"), F.array_join(merge.oversized(F.col("status")), "|").alias("oversized"))

_BUILDS = """(VALUES (1, '本方案基于 Spark 数据湖'), (2, '数据湖 设计'), (3, 'spark tuning notes'), (4, '详见 tuning'), (5, 'unrelated')) AS t(reality_id, text)"""


@query("SELECT * FROM (VALUES ('reality_1', 'reality_2', 'depends_on', 1.0::DOUBLE), ('reality_4', 'reality_3', 'continues', 1.0::DOUBLE)) AS t(source, target, relation, weight)")
def relation_edges(spark, sf_dir):
    said = _rows(spark, "(VALUES (1, 2, 'depends_on'), (1, 3, 'none'), (4, 3, 'continues'), (2, 1, 'depends_on')) AS t(src, tgt, relation)")
    return graph.relation_edges(graph.link_candidates(_rows(spark, _BUILDS)), said)


@query("SELECT * FROM (VALUES (1, 2), (1, 3), (4, 3)) AS t(src, tgt)")
def building_pairs(spark, sf_dir):
    return graph.link_candidates(_rows(spark, _BUILDS))


@query("SELECT * FROM (VALUES ('reality_1', 'ov_doc_a.md', 0.8::DOUBLE), ('reality_1', 'ov_doc_c.md', 0.7::DOUBLE), ('reality_2', 'ov_doc_b.md', 0.5::DOUBLE), ('reality_3', 'ov_doc_a.md', 0.55::DOUBLE), ('reality_4', 'ov_doc_b.md', 0.95::DOUBLE)) AS t(source, target, weight)")
def document_references(spark, sf_dir):
    hits = _rows(spark, """(VALUES (1, 0, 'd://r/A.md', 0.8, '', 'work on spark'), (1, 1, 'd://r/b.md', 0.5, '', 'work on spark'), (1, 2, 'd://r/c.md', 0.7, '', 'work on spark'), (1, 3, 'd://r/b.md', 0.9, '', 'work on spark'),
      (2, 0, 'd://r/b.md', 0.5, 'spark work', 'work on spark'), (2, 1, 'd://r/readme.md', 0.9, '', ''), (3, 0, 'd://r/a.md', 0.55, 'other', 'work on spark'), (4, 0, 'd://r/b.md', 0.99, '', ''), (5, 0, 'd://r/unknown.md', 0.9, '', ''), (6, 0, 'd://r/b.md', 0.5, 'zzz', 'work')) AS t(reality_id, rank, uri, score, title, text)""")
    known = _rows(spark, "(VALUES ('ov_doc_a.md'), ('ov_doc_b.md'), ('ov_doc_c.md'), ('ov_doc_readme.md')) AS t(id)")
    said = _rows(spark, "(VALUES (3, 'ov_doc_a.md', 'references'), (6, 'ov_doc_b.md', 'none')) AS t(reality_id, target, verdict)")
    found = graph.reference_edges(hits.withColumn("score", F.col("score").cast("double")), known, 0.45, said)
    return found.select("source", "target", "weight")

_KEYED = "(VALUES (1, 'Spark Shuffle service'), (2, 'iceberg table'), (3, 'xy')) AS t(theme_id, text)"


@query("SELECT * FROM (VALUES (1, 'n1', 0.5::DOUBLE), (1, 'n2', 0.636::DOUBLE), (2, 'n4', 0.833::DOUBLE)) AS t(theme_id, node_id, strength)")
def code_associations(spark, sf_dir):
    nodes = _rows(spark, "(VALUES ('n1', 'my_spark_x', 'code'), ('n2', 'ShuffleJoin', 'code'), ('n3', 'spark', 'wiki'), ('n4', 'Tables', CAST(NULL AS STRING)), ('n5', '', 'code')) AS t(id, label, _origin)")
    return graph.strongest(graph.associations(_rows(spark, _KEYED), nodes), 5)

_TREE = "(VALUES (CAST(NULL AS {0}), 'a'), ('a', 'b'), ('b', 'c'), ('c', 'a'), ('b', 'd'), ('d', 'e'), ('z', 'y')) AS t(parent, child)"


@query("WITH RECURSIVE t AS (SELECT * FROM " + _TREE.format("VARCHAR") + "), r AS (SELECT child AS node, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.child, r.level + 1 FROM r JOIN t ON t.parent = r.node WHERE r.level < 6) SELECT node, min(level) AS level FROM r GROUP BY 1")
def document_tree(spark, sf_dir):
    return docs.tree_rows(_rows(spark, _TREE.format("STRING")))


@query("SELECT 1::BIGINT AS strand_id, 2 AS n_turns, 1 AS n_seen, 0.5::DOUBLE AS first, 2 AS n_changes UNION ALL SELECT 2, 0, NULL, NULL, 0")
def decoded_strands(spark, sf_dir):
    rows = [(1, "s", '[3, 4]', '{"现象与问题": ["x"]}', "[0.5, 1]", '["a", "b"]', "active"), (2, "s", "bad", "null", "", None, None), (3, "s", "[]", "{}", "[]", "[]", "discarded"), (4, "t", "[]", "{}", "[]", "[]", "active")]
    stored = spark.createDataFrame(rows, "strand_id long, session_id string, turns string, ooda_json string, centroid_json string, changes_json string, status string")
    d = S.load_strands(stored, "s")
    return d.select("strand_id", F.size("turns").alias("n_turns"), F.when(F.col("ooda").isNotNull(), F.size("ooda.`现象与问题`")).alias("n_seen"), F.try_element_at("centroid", F.lit(1)).alias("first"), F.size("changes").alias("n_changes"))


@query("SELECT 1::BIGINT AS id, 'reality' AS kind, 1 AS n_timeline, 2 AS n_sources, 'f' AS fact UNION ALL SELECT 2, 'reality', 0, 0, NULL UNION ALL SELECT 1, 'theme', 1, 1, 'f' UNION ALL SELECT 2, 'theme', 0, 0, NULL")
def decoded_objects(spark, sf_dir):
    shape = "id long, s string, t string, m string, c string"
    r = spark.createDataFrame([(1, '{"key_facts": ["f"]}', '[{"seq": 1, "overview": "o"}]', '{"a": [1], "b": []}', "[1]"), (2, "{", None, "[]", "null")], shape)
    r = S.load_realities(r.select(F.col("id").alias("reality_id"), F.col("s").alias("current_status_json"), F.col("t").alias("timeline_json"), F.col("m").alias("source_strands"), F.col("c").alias("centroid_json"), F.col("c").alias("query_centroid_json")))
    t = spark.createDataFrame([(1, '["f"]', '[{"seq": 1}]', '{"a": [1]}', "[1]"), (2, "x", "y", None, "z")], shape)
    t = S.load_themes(t.select(F.col("id").alias("theme_id"), F.lit("{}").alias("ooda_json"), F.col("s").alias("key_facts_json"), F.col("s").alias("open_items_json"), F.col("s").alias("changes_json"), F.col("t").alias("timeline_json"), F.col("m").alias("source_strands"), F.col("c").alias("centroid_json")))
    out = lambda d, k, name, fact: d.select(F.col(k).alias("id"), F.lit(name).alias("kind"), F.size("timeline").alias("n_timeline"), F.size("source_strands").alias("n_sources"), fact.alias("fact"))
    return out(r, "reality_id", "reality", F.try_element_at("current_status.key_facts", F.lit(1))).unionByName(out(t, "theme_id", "theme", F.try_element_at("key_facts", F.lit(1))))


@query("""SELECT * FROM (VALUES (1, 2), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0)) AS t(id, n)""")
def tree_answers(spark, sf_dir):
    rows = [(1, '[{"a": 1}, {"b": 2}, 3]'), (2, '{"items": [{"a": 1}]}'), (3, '{"result": {"files": [{"a": 1}]}}'), (4, '{"result": [{"a": 1}, "x"]}'), (5, '{"entries": {"a": 1}}'), (6, "not json")]
    return spark.createDataFrame(rows, "id int, payload string").select("id", F.size(S.tree_entries(F.col("payload"))).alias("n"))


@query("SELECT 5::BIGINT AS n, 1.0::DOUBLE AS short_hdl_rate, 0.0::DOUBLE AS four_stage_rate")
def line_quality(spark, sf_dir):
    return refine.strand_quality(_lines(spark))
