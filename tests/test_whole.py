"""Queries use whole keys and whole texts: small tables that hold what a fold or a cut would lose."""

import itertools
import os
import random
from collections import Counter

import pytest
from compare import TABLES, compare
from conftest import SF

from tracewell.plans import registry

#: Parts that are equal modulo 500, in and across orders: order, supplier, part.
LINES = [(1, 4, 7), (1, 3, 507), (1, 9, 1007), (2, 2, 7), (2, 2, 1507), (3, 6, 507), (3, 6, 1507), (3, 8, 20), (4, 5, 20), (4, 5, 520)]
GRAPH = ["cooc_pairs", "cooc_new_pairs", "cooc_edges", "cooc_edges_of_profile", "cooc_degree", "cooc_blocks", "cooc_sync", "knowledge_cleanup", "s_candidates", "graph_neighbours"]


def folder_with(spark, folder, **tables):
    """The smallest tables with some of them replaced."""
    for t in TABLES:
        if t in tables:
            tables[t].toPandas().to_parquet(f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def orders_of_far_parts(spark, tmp_path_factory):
    orders = sorted({o for o, _, _ in LINES})
    return folder_with(
        spark, tmp_path_factory.mktemp("parts"),
        lineitem=spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_partkey long"),
        orders=spark.createDataFrame([(o, 50 * (1 + o % 2), "OF"[o % 2]) for o in orders], "o_orderkey long, o_custkey long, o_orderstatus string"),
        customer=spark.createDataFrame([(50,), (100,), (101,)], "c_custkey long"),
        part=spark.createDataFrame([(p,) for p in sorted({p for _, _, p in LINES})], "p_partkey long"),
    )


def brute_edges():
    blocks = {}
    for order, _, part in LINES:
        blocks.setdefault(order, set()).add(part)
    return Counter(p for b in blocks.values() for p in itertools.combinations(sorted(b), 2))


def test_parts_are_nodes_of_their_own(spark, orders_of_far_parts):
    want = brute_edges()
    got = {(r.a, r.b): r.w for r in registry.queries()["cooc_edges"](spark, orders_of_far_parts).collect()}
    assert got == want and (7, 507) in got and (20, 520) in got


@pytest.mark.parametrize("name", GRAPH)
def test_whole_graph_query(spark, orders_of_far_parts, name):
    said = compare(spark, name, orders_of_far_parts, registry.queries(), registry.oracle_sql())
    assert "match" in said and not said.startswith(f"{name}: 0 rows"), said


def test_titles_match_beyond_80_characters(spark, tmp_path):
    filler = "the same opening words stand in front of every text here and so they weigh little " * 2
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(120)]
    docs = [(i, filler + " ".join(words[4 * i : 4 * i + 4])) for i in range(30)]
    items = [(i, "zzz " + " ".join(words[4 * i : 4 * i + 4])) for i in range(0, 30, 3)]
    at = folder_with(spark, tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    q = registry.queries()
    assert {(r.id, r.doc) for r in q["title_matches"](spark, at).collect()} == {(i, i) for i in range(0, 30, 3)}
    assert {r.f for r in q["pair_idf"](spark, at).collect()} == {w for _, t in docs for w in t.split() if len(w) > 1}
    for name in ("pair_idf", "title_matches"):
        assert "match" in compare(spark, name, at, q, registry.oracle_sql())


def test_every_labelled_vector_is_graded(spark):
    want = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("label is not null").collect()}
    assert {r.vec_id for r in registry.queries()["radius_grades"](spark, SF).collect()} == want
    assert "match" in compare(spark, "radius_grades", SF, registry.queries(), registry.oracle_sql())


def test_final_answers_are_whole(spark):
    texts = {r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'").collect()}
    q = registry.queries()
    got = [r.prev_fct for r in q["prev_fin"](spark, SF).collect() if r.prev_fct]
    assert max(map(len, got)) > 200 and set(got) <= texts
    assert "match" in compare(spark, "prev_fin", SF, q, registry.oracle_sql())
