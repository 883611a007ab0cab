"""Near duplicates of rows that share an id but hold different texts."""

import collections
import random

import pytest

from tracewell.llm import near_dedup


def test_near_dedup_tells_texts_of_an_id_apart(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(4))
    near = lambda t, i: t.replace(t.split()[i], "changed")
    rows = [(5, a), (5, b), (2, near(a, 100)), (7, near(b, 100)), (8, c), (8, near(c, 50)), (8, "!!!"), (9, d), (9, d), (5, "?")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    text_of = {t: n for n, t in enumerate(t for _, t in rows)}
    got = collections.Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dedup.near_dedup(table).collect())
    assert got[5, 2, 2, False] == 1 and got[2, 2, 2, True] == 1  # a
    assert got[5, 5, 2, True] == 1 and got[7, 5, 2, False] == 1  # b, which isn't like a
    assert got[8, 8, 2, True] == 1 and got[8, 8, 2, False] == 1 and got[8, 8, 1, True] == 1 and got[5, 5, 1, True] == 1
    assert got[9, 9, 2, True] == 1 and got[9, 9, 2, False] == 1 and sum(got.values()) == len(rows)
    kept = collections.Counter((r.doc_id, r.text) for r in near_dedup.keep_one(table).collect())
    assert (5, a) not in kept and kept[2, near(a, 100)] == 1 and kept[5, b] == 1 and (7, near(b, 100)) not in kept
    assert kept[8, c] + kept[8, near(c, 50)] == 1 and kept[8, "!!!"] == kept[5, "?"] == 1 and kept[9, d] == 2 and len(text_of) == len(rows) - 1


@pytest.mark.parametrize("ends", [((1 << 63) - 1,), (-(1 << 63),), (-(1 << 63), (1 << 63) - 1), ()])
def test_ids_at_the_ends_of_long(spark, ends):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4)]
    near = lambda t: t.replace(t.split()[40], "changed")
    rows = [(5, texts[0]), (5, texts[1]), (6, near(texts[0])), (7, near(texts[1])), (8, texts[2])] + [(e, near(texts[2])) for e in ends]
    got = collections.Counter((r.doc_id, r.class_size) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = collections.Counter({(5, 2): 2, (6, 2): 1, (7, 2): 1, (8, 1 + len(ends)): 1} | {(e, 1 + len(ends)): 1 for e in ends})
    assert got == want
    assert near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3
