"""Ownership of addresses and governance of roots on literal cases, and against brute force."""

import random

from pyspark.sql import functions as F

from tracewell.operators import graph, roots

URIS = [(1, "docs://a/.hidden.md/My Plan.md/part"), (2, "docs://a/README.md"), (3, "docs://a/none.txt"), (4, "docs://x/Changelog.md/"), (5, "docs://ab/z.md"), (6, None)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def nodes(spark):
    return spark.createDataFrame([(f"n{i}", {"uri": u}) for i, u in URIS], "id string, metadata map<string,string>")


def links(spark):
    return spark.createDataFrame([(f"n{i}", r) for i, _ in URIS for r in ("references_ov", "trace")], "target string, relation string")


def test_document_nodes(spark):
    node = graph.document_node(F.col("uri"))
    got = {r.id: (r.node, r.nav) for r in frame(spark, URIS, "id int, uri string").select("id", node.alias("node"), graph.is_navigation(node).alias("nav")).collect()}
    assert got == {1: ("ov_doc_my_plan.md", False), 2: ("ov_doc_readme.md", True), 3: (None, None), 4: ("ov_doc_changelog.md", True), 5: ("ov_doc_z.md", False), 6: (None, None)}


def test_references_and_scores_of_roots(spark):
    own = frame(spark, [("docs://a", True), ("docs://x/", False), ("docs://q", False)], "root_uri string, enabled boolean")
    assert {r.root_uri: r.refs for r in roots.references_per_root(links(spark), nodes(spark), own).collect()} == {"docs://a": 3, "docs://x/": 1, "docs://q": 0}
    hits = frame(spark, [(0, "docs://x/1", 0.4), (1, "docs://x", 0.6), (3, "docs://x/2", 0.9), (0, "docs://xy/1", 0.8), (0, "docs://a/1", 0.7)], "query_no int, uri string, score double")
    assert {r.root_uri: r.top_score for r in roots.top_scores(own, hits).collect()} == {"docs://a": None, "docs://x/": 0.6, "docs://q": 0.0}


def test_owner_is_the_longest_root(spark, monkeypatch):
    draw = random.Random(2)
    some = lambda: "/".join(draw.choice(["", "a", "b", "ab", "a b"]) for _ in range(draw.randrange(1, 6)))
    uris, own = {some() for _ in range(300)}, {some() for _ in range(40)}
    table = frame(spark, [(u,) for u in uris] + [(None,)], "uri string")
    want = {}
    for u in uris:
        held = [r for r in own if u == r.rstrip("/") or u.startswith(r.rstrip("/") + "/")]
        want[u] = set(held)
    for most in (roots.BROADCAST_ROOTS, 3):
        monkeypatch.setattr(roots, "BROADCAST_ROOTS", most)
        got = {}
        for r in roots.owning_roots(table, frame(spark, [(r,) for r in own], "root_uri string")).collect():
            got.setdefault(r.uri, set()).add(r.root_uri)
        assert got == {u: h for u, h in want.items() if h}
        for r in roots.owner(table, frame(spark, [(r,) for r in own], "root_uri string")).collect():
            assert len(r.root_uri) == max(map(len, want[r.uri]))


DECIDED = [
    (1, "new", "enable"), (2, "on", "enable"), (3, "off", "enable"), (4, "off2", "enable"), (5, "on", "disable"), (6, "gone", "remove"), (7, "gone", "enable"), (8, "phantom", "enable"),
    (9, "odd", "archive"), (10, "  ", "remove"), (11, None, "remove"), (12, "off2", "keep"), (13, " kept ", "keep"),
]
BEFORE = [("on", True, "seed", 1.0, 1.0), ("off", False, "seed", 1.0, 1.0), ("off2", False, "seed", 1.0, 1.0), ("gone", True, "seed", 1.0, 1.0), ("odd", True, "seed", 1.0, 1.0), ("kept", True, "seed", 1.0, 1.0)]


def governed(spark, found=("new", "on"), graph_there=True, decided=DECIDED, cap=3):
    hits = frame(spark, [(0, "new/1", 0.4), (0, "off/2", 0.3)], "query_no int, uri string, score double")
    docs = spark.createDataFrame([("d", {"uri": "on/x"})], "id string, metadata map<string,string>")
    refs = spark.createDataFrame([("d", "references_ov")], "target string, relation string")
    own = frame(spark, BEFORE, "root_uri string, enabled boolean, origin string, added_at double, last_seen double")
    return roots.govern(own, frame(spark, [(f,) for f in found], "root_uri string"), frame(spark, decided, "ord int, root_uri string, action string"), refs if graph_there else None, docs, hits, 9.0, cap)


def state(g):
    return {r.root_uri: r.enabled for r in g.roots.collect()}


def test_decisions_count_in_order_and_as_a_set(spark):
    g = governed(spark)
    # The enabling of "on" takes one of three places, so "off2" keeps; "gone" is gone when it is named again.
    assert state(g) == {"new": True, "on": False, "off": True, "off2": False, "odd": True, "kept": True}
    assert {r.ord: r.done for r in g.log.collect()} == {1: "enable", 2: "enable", 3: "enable", 4: "keep", 5: "disable", 6: "remove", 7: "skip", 8: "skip", 12: "keep", 13: "keep"}
    assert g.changed.first().changed
    known = {r.root_uri: r for r in g.evidence.collect()}
    assert known["on"].refs == known["on"].docs == 1 and known["on"].top_score is None and known["on"].there and not known["on"].is_new
    assert known["new"].top_score == 0.4 and known["new"].is_new and not known["off"].there
    seen = {r.root_uri: (r.origin, r.added_at, r.last_seen) for r in g.roots.collect()}
    assert seen["new"] == ("refine_probe", 9.0, 9.0) and seen["on"] == ("seed", 1.0, 9.0) and seen["off"] == ("seed", 1.0, 1.0)


def test_nothing_is_done_without_probe_graph_or_decisions(spark):
    before = {r[0]: r[1] for r in BEFORE}
    assert state(governed(spark, found=())) == before
    for g in (governed(spark, graph_there=False), governed(spark, decided=[(1, "on", "burn"), (2, None, "remove")])):
        assert state(g) == before | {"new": False} and not g.changed.first().changed
