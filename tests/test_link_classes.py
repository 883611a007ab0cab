"""Links between items of few distinct texts: classes meet, not items."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracewell.operators import graph

TEXTS = ["red box 基于", "blue box", "red ring", "green", "", None, "box red 基于"]


@pytest.mark.parametrize("most", [2, 1000])
def test_pairs_of_items_by_classes(spark, monkeypatch, most):
    monkeypatch.setattr(graph.slices, "__defaults__", (most,))
    rows = [(i, TEXTS[i % 7]) for i in range(35)]
    words = lambda t: set((t or "").replace("基于", "").split())
    want = {(a, b) for (a, s), (b, t) in itertools.product(rows, rows) if a != b and "基于" in (s or "") and (words(s) & words(t) or "基于" in (t or ""))}
    items = spark.createDataFrame(rows, "reality_id long, text string")
    found = graph.link_candidates(items)
    got = [tuple(r) for r in found.select("src", "tgt").collect()]
    assert len(got) == len(want) and set(got) == want
    again = graph.link_candidates(items.union(spark.createDataFrame([(0, "green"), (0, "red 基于")], items.schema)))
    assert again.count() == again.distinct().count()


def test_copies_of_texts_are_not_shuffled_as_pairs(spark):
    """What is made distinct are pairs of classes: no aggregate stands above the lists of members."""
    plan = graph.link_candidates(spark.createDataFrame([(1, "a box 基于"), (2, "box")], "reality_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_left") < plan.index("Aggregate")


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_lists_of_members_are_not_shuffled_as_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "BROADCAST_MEMBERS", held)
    monkeypatch.setattr(graph, "LEFT_MEMBERS", 2)
    rows = [(i if i % 9 else None, TEXTS[i % 3]) for i in range(30)]
    found = graph.link_candidates(spark.createDataFrame(rows, "reality_id long, text string"))
    words = lambda t: set(t.split()) - {"基于"}
    want = {(a, b) for (a, s), (b, t) in itertools.product(rows, rows) if None not in (a, b) and a != b and "基于" in s and (words(s) & words(t) or "基于" in t)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[plan.index("Generate explode(_left") : plan.index("Join")]
    assert ("true" in above) == (held == 0)


def test_targets_are_chosen_before_pairs(spark):
    items = spark.createDataFrame([(i, TEXTS[i % 3]) for i in range(12)], "reality_id long, text string")
    every = {tuple(r) for r in graph.link_candidates(items).collect()}
    assert {tuple(r) for r in graph.link_candidates(items, targets=F.col("id") % 2 == 0).collect()} == {p for p in every if p[1] % 2 == 0} != every
