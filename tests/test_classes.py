"""Operators that let classes of equal rows meet, with copies."""

from tracewell.functions import vector as V
from tracewell.operators import graph, merge, recall


def test_equal_texts_are_compared_once(spark, monkeypatch):
    met, beside = [], V.beside
    monkeypatch.setattr(V, "beside", lambda rows, col, queries, *rest, **more: (met.append((rows.count(), queries.count())), beside(rows, col, queries, *rest, **more))[1])
    objects = spark.createDataFrame([(i, ["abc", "bcd"][i % 2], None) for i in range(100)], "reality_id long, name string, hdl string")
    asked = spark.createDataFrame([(i, "abc") for i in range(10)], "q long, text string")
    rows = recall.lexical(asked, objects).collect()
    assert met == [(2, 1)] and len(rows) == 150
    assert {r.q: 0 for r in rows}.keys() == set(range(10)) and sorted(r.reality_id for r in rows if r.q == 3) == list(range(0, 30, 2)) and {r.d for r in rows} == {0.0}


def test_best_associations_of_copies(spark):
    themes = spark.createDataFrame([(i, ["alpha beta", "gamma"][i % 2]) for i in range(6)], "theme_id long, text string")
    nodes = spark.createDataFrame([(f"n{i:02}", ["alpha", "beta gamma", "none"][i % 3]) for i in range(30)] + [("n00", "alpha alpha")], "id string, label string")
    every = graph.associations(themes, nodes)
    assert every.count() == 3 * 20 + 3 * 10 and every.where("theme_id = 0 and node_id = 'n00'").first().strength == 1.0
    want = {tuple(r) for r in graph.strongest(every, 3, per="theme_id").select("theme_id", "node_id", "strength").collect()}
    assert {tuple(r) for r in graph.associations(themes, nodes, best=3).select("theme_id", "node_id", "strength").collect()} == want and len(want) == 18


def test_vectors_by_their_number(spark, monkeypatch):
    lines = [("a", "s", 1, 1, 10), ("b", "s", 1, 2, 20), ("c", "s", 1, 3, 30), ("d", "s", 2, 1, 10), ("e", "s", 2, None, 10), ("f", "s", 1, 9, 40)]
    rows = spark.createDataFrame(lines, "strand_id string, session_id string, topic_id long, vec_id long, reality_id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, centroid array<double>")
    for most in (10**6, 1):
        monkeypatch.setattr(V, "BROADCAST_COMPONENTS", most)
        got = {r.strand_id: (r.reality_id, r.how) for r in merge.match_strands(rows.drop("reality_id"), rows, None, vectors=vectors).collect()}
        assert got == {"a": (10, "matched"), "b": (20, "matched"), "c": (10, "matched"), "d": (10, "direct"), "e": (10, "direct")}
