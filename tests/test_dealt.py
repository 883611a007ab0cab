"""Work that is dealt to more tasks as its rows grow."""

from tracewell.operators import graph, merge
from tracewell.sources import shared


def test_pairs_are_dealt_to_tasks_of_a_bounded_number(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shared.parts_for(spark, 10) == usual and shared.parts_for(spark, 10 * usual * shared.TASK_ROWS + 1) == 10 * usual + 1
    members = spark.createDataFrame([(f"s{i % 7}", i % 20, "p", i * i % 31) for i in range(300)], "session_id string, topic_id long, profile string, reality_id long")
    events = graph.block_pairs(members)
    rows = lambda df: sorted(map(tuple, df.collect()))
    few, many = graph.edges(events), graph.edges(events, parts=9)
    assert rows(few) == rows(many) and many._jdf.queryExecution().toString().count("partial_count") <= few._jdf.queryExecution().toString().count("partial_count")
    assert "REPARTITION_BY_NUM, [plan_id" in many._jdf.queryExecution().toString() and ", 9)" in many._jdf.queryExecution().toString()
    known = events.where("topic_id % 3 = 0")
    assert rows(graph.record_cooccurrences(members, known, 9)) == rows(graph.record_cooccurrences(members, known)) == rows(events.where("topic_id % 3 <> 0"))


def test_titles_are_dealt_by_their_words(spark, monkeypatch):
    names = spark.createDataFrame([(i, f"{'abcdef'[i % 6] * 3} {'ghijklm'[i % 7] * 3} common") for i in range(200)], "id long, title string")
    titles = spark.createDataFrame([(i, f"{'abcdef'[i % 6] * 3} {'ghijklm'[i % 7] * 3} common") for i in range(20)], "doc long, title string")
    match = lambda: sorted(map(tuple, graph.title_matches(names, titles, 1.5, 2, 3.0).collect()))
    want = match()
    monkeypatch.setattr(graph, "TITLE_WORDS", 50)
    assert match() == want and len(want) > 50


def test_edges_are_made_once(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 1)], "a long, b long, w long").groupBy("a", "b").agg({"w": "sum"}).withColumnRenamed("sum(w)", "w")
    works = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    anchors = spark.createDataFrame([(1, 2, True)], "q long, id long, fused boolean")
    found = merge.s_candidates(works, anchors, edges)
    assert [(r.id, r.s, r["rank"]) for r in found.orderBy("rank").collect()] == [(2, 0.0, 1), (1, 0.25, 2), (3, 0.5, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [a#") == 1
