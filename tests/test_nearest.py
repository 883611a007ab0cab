"""The nearest vectors of queries by blocks of products, against all pairs one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import vector as V
from tracewell.operators import search


@pytest.mark.parametrize("sizes", [(8_000_000, 4_000), (6, 5)])
def test_nearest_equals_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(V, "BROADCAST_COMPONENTS", sizes[0])
    monkeypatch.setattr(V, "NEAREST_ROWS", sizes[1])
    draw = random.Random(5)
    some = [[float(draw.randrange(-3, 4)) for _ in range(3 + i % 2)] for i in range(60)] + [[0.0, 0.0, 0.0], [math.nan, 1.0, 2.0], [None, 1.0, 2.0], [], None]
    rows = spark.createDataFrame([(i, some[i % len(some)]) for i in range(400)], "id long, v array<double>")
    queries = rows.where("id % 9 = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    pairs = V.meet(rows, "v", queries, "w").select("q", "id", V.cosine(F.col("w"), F.col("v")).alias("c"))
    first = lambda d: sorted(map(str, d.where("c >= 0.2").withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.col("c").desc(), "id"))).where("k <= 4").collect()))
    plain = pairs.where("not isnan(c)")
    got = V.nearest(rows, "id", "v", queries, "q", "w", 4, 0.2)
    assert first(got.where("not isnan(c)")) == first(plain) and got.count() < pairs.count() / 4


def test_searches_give_few_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(300)], "id long, v array<double>")
    assert search.cosine_scores(rows, rows.where("id < 3"), "id", "v", "id", "v", best=10).count() == 30


def test_near_ties_survive_single_precision(spark):
    draw = random.Random(7)
    vec = lambda near: [1.0] + [0.5 + (draw.random() * 1e-7 if near else draw.gauss(0, 0.2)) for _ in range(7)]
    rows = spark.createDataFrame([(i, vec(i % 3 > 0)) for i in range(1500)], "id long, v array<double>")
    queries = rows.where("id % 100 = 1").select(F.col("id").alias("q"), F.col("v").alias("w"))
    first = lambda d: sorted(map(str, d.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.round("c", 15).desc(), "id"))).where("k <= 5").collect()))
    want = V.meet(rows, "v", queries, "w").select("q", "id", V.cosine(F.col("w"), F.col("v")).alias("c"))
    assert first(V.nearest(rows, "id", "v", queries, "q", "w", 5)) == first(want)


def test_a_bound_that_is_always_reached():
    draw = np.random.default_rng(3)
    for n, k in ((7, 7), (500, 3), (4_000, 10), (999, 30)):
        s = draw.normal(size=(20, n)).astype(np.float32)
        bound, exact = V._reached(s, k), np.sort(s, axis=1)[:, n - k]
        assert (bound <= exact).all() and ((s >= bound[:, None]).sum(axis=1) <= 2 * k + 5).all()


def test_rows_that_are_nearly_alike_stay_in_their_task(spark):
    rows = spark.createDataFrame([(i, [1.0, i * 1e-6, 0.0, 0.0]) for i in range(1, 600)], "id long, v array<double>")
    queries = spark.createDataFrame([(0, [0.0, 1.0, 0.0, 0.0])], "q long, w array<double>")
    got = V.nearest(rows, "id", "v", queries, "q", "w", 5)
    assert sorted(r.id for r in got.collect()) == [595, 596, 597, 598, 599]


def test_copies_are_told_apart_by_their_hashes(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(90)], "id long, v array<double>")
    got = V.nearest(rows, "id", "v", rows.where("id = 0").select(F.col("id").alias("q"), F.col("v").alias("w")), "q", "w", 4)
    assert sorted(r.id for r in got.collect()) == [0, 3, 6, 9] and "_hash" in got._jdf.queryExecution().optimizedPlan().toString()
