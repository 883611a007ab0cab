"""Keywords in labels: a label is read once and its text goes nowhere."""

import pytest

from tracewell.operators import graph


@pytest.mark.parametrize("few", [0, 100])
def test_labels_are_read_once_and_stay(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "KEYWORDS", few)
    monkeypatch.setattr(graph.keyword_hits, "__defaults__", (2,))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    labels = ["alpha", "Beta x", "alpha and beta " * 40, "none", "", None, "alpha"]
    nodes = spark.createDataFrame([(f"n{i:02}", labels[i % 7]) for i in range(28)], "id string, label string").mapInArrow(counted, "id string, label string")
    themes = spark.createDataFrame([(1, "alpha"), (2, "beta alpha"), (3, "gamma"), (4, "alpha")], "theme_id long, text string")
    want = set()
    for i in range(28):
        low = (labels[i % 7] or "").lower()
        for t, kws in ((1, ["alpha"]), (2, ["beta", "alpha"]), (4, ["alpha"])):
            if held := [kw for kw in kws if low and kw in low]:
                want.add((t, f"n{i:02}", max(round(max(min(len(kw) / len(low), 1.0), 0.3), 3) for kw in held)))
    found = graph.associations(themes, nodes)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    if few:
        assert read.value == 28
