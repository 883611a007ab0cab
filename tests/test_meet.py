"""Queries beside rows of their vectors' length, broadcast or in blocks; retrieval over small corpora."""

import pytest
from pyspark.sql import functions as F

from tracewell.config import Config
from tracewell.functions import vector as V
from tracewell.operators import recall, search


@pytest.mark.parametrize("most", [10**6, 7, 1])
def test_every_pair_of_a_length_meets_once(spark, most):
    rows = spark.createDataFrame([(i, [float(i)] * (2 + i % 2)) for i in range(12)] + [(99, None)], "id long, v array<double>")
    queries = spark.createDataFrame([(i, [1.0 + i] * (2 + i % 3)) for i in range(9)] + [(98, None)], "q long, w array<double>")
    got = sorted((r.id, r.q) for r in V.meet(rows, "v", queries, "w", most).collect())
    assert got == sorted((i, q) for i in range(12) for q in range(9) if i % 2 == q % 3)
    assert V.meet(rows, "v", queries.where("false"), "w", most).count() == 0 and V.meet(rows.where("false"), "v", queries, "w", most).count() == 0


@pytest.mark.parametrize("most", [10**6, 3])
def test_lexical_recall_in_blocks(spark, most):
    objects = spark.createDataFrame([(i, "abcdef"[: i % 7], "xyz") for i in range(20)] + [(50, None, None)], "reality_id long, name string, hdl string")
    asked = spark.createDataFrame([(1, "abcd"), (2, "yz"), (3, ""), (4, None)], "q long, text string")
    pairs = lambda t: {t[i : i + 2] for i in range(len(t or "") - 1)}
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    want = []
    for q, text in [(1, "abcd"), (2, "yz"), (3, ""), (4, None)]:
        all_of_it = [(round(1 - max(alike(pairs(text), pairs("abcdef"[: i % 7])), alike(pairs(text), pairs("xyz"))), 9), i) for i in range(20)] + [(1.0, 50)]
        want += [(q, i, d, k) for k, (d, i) in enumerate(sorted(all_of_it)[: Config().recall_candidates], 1)]
    got = sorted((r.q, r.reality_id, r.d, r["rank"]) for r in recall.lexical(asked, objects, most=most).collect())
    assert got == sorted(want)


def test_tools_and_topics_are_retrieved(spark):
    tools = spark.createDataFrame([("grep", "search text in files", [1.0, 0.0]), ("make", "build a project", [0.0, 1.0]), ("none", "", None)], "tool string, text string, vec array<double>")
    queries = spark.createDataFrame([(1, "search files", [0.9, 0.1]), (2, "zzz", None)], "q long, text string, vec array<double>")
    got = [(r.q, r.doc, r["rank"]) for r in search.retrieve_tools(tools, queries).orderBy("q", "rank").collect()]
    assert got == [(1, "grep", 0), (1, "make", 1)] and search.retrieve_tools(tools.where("false"), queries).count() == 0
    topics = tools.select(F.length("tool").cast("long").alias("topic_id"), "text", F.col("vec").alias("centroid"), (F.col("tool") == "make").alias("is_bg")).where("text <> ''")
    assert {(r.q, r.topic_id) for r in search.retrieve_topics(topics, queries).collect()} == {(1, 4)}
