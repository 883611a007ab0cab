"""The queries of this subpackage and the pipeline's stages."""

import re

import pytest
from compare import compare

import corpus_pipeline
from tracewell.llm import exact_dedup, mixing, near_dedup, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert "match" in compare(spark, name, SF, queries.queries(), queries.oracle_sql())


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_effect(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = rows.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, SF)
        if name != "packing":
            rows = rows.cache()
            assert rows.columns == columns
            seen[name] = [r.doc_id for r in rows.collect()]
        if name == "toxicity":
            clean = [i for i, t in labels.items() if t == 0]
            assert len(set(clean) - set(seen[name])) <= 0.02 * len(clean) and len(seen[name]) < before.count()
        elif name == "exact_dedup":
            assert sorted(seen[name]) == sorted(r.doc_id for r in exact_dedup.exact_dedup(before).where("kept").collect())
        elif name == "near_dedup":
            assert sorted(seen[name]) == sorted(r.doc_id for r in near_dedup.near_dedup(before).where("kept").collect())
        elif name == "mixing":
            words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows.collect())
            assert words == sum(r.taken for r in mixing.mix(before).collect())
        else:
            assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
            assert {r.doc_id for r in rows.collect()} == set(seen["mixing"])
