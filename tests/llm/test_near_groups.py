"""Large groups of texts that are alike but mostly of different classes."""

import numpy as np
import pytest

from tracewell.llm import near_dedup


def group(n=600, length=120, seed=5):
    """Copies of one text with 0 to 14 words changed, and copies of those."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 3000, length)]
    texts, made = [], 0
    for k in range(n):
        copy = list(base if k < n // 2 else texts[int(rng.integers(0, n // 2))])
        for i in rng.choice(length, int(rng.integers(0, 15 if k < n // 2 else 4)), replace=False):
            copy[i] = f"z{made}"
            made += 1
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def all_similarities(vectors, idf):
    """Weighted Jaccard of all pairs from a dense table of weights (each shingle counts once or more)."""
    shingles, place = np.unique(np.concatenate(vectors), return_inverse=True)
    owner = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    counts = np.zeros((len(vectors), len(shingles)), np.int16)
    np.add.at(counts, (owner, place), 1)
    weight = idf[near_dedup.slots(shingles)].astype(float)
    total = counts @ weight
    both = np.stack([np.minimum(counts, row) @ weight for row in counts])
    return both / (total[:, None] + total[None, :] - both)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = group()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    counts, n = near_dedup.document_frequencies(near_dedup.vectors(table.selectExpr("doc_id as id", "text")))
    idf = near_dedup.inverse_frequencies(counts, n)
    return table, [near_dedup.compact(near_dedup.shingles(t)[0]) for _, t in rows], idf


def test_classes_equal_those_of_all_pairs(corpus):
    table, vectors, idf = corpus
    sim = all_similarities(vectors, idf)
    assert sim[3, 40] == pytest.approx(near_dedup.weighted_jaccard(vectors[3], vectors[40], idf))
    label = np.arange(len(vectors))
    while True:
        least = np.where(sim >= 0.8, label[None, :], len(label)).min(axis=1)
        if (least == label).all():
            break
        label = least
    assert 100 < len(set(label.tolist())) < 550  # many classes in shared buckets
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_maps_never_exceed_the_difference(corpus):
    _, vectors, idf = corpus
    rng = np.random.default_rng(0)
    skewed = rng.uniform(float(near_dedup.inverse_frequencies(np.array([1]), 1)[0]), float(near_dedup.inverse_frequencies(np.array([0]), 1)[0]), near_dedup.SLOTS).astype(np.float32)
    least = (*near_dedup.MAP_WEIGHTS[:-1], float(near_dedup.inverse_frequencies(np.array([1]), 1)[0]))
    ends = np.cumsum((0, *near_dedup.MAP_WORDS))
    for weights in (idf, skewed):
        maps = [near_dedup.difference_map(v, weights) for v in vectors[:120]]
        for i in range(0, 120, 3):
            for j in range(i):
                differ = [bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(maps[i][0], maps[j][0], strict=True)]
                bound = sum(w * sum(differ[a:b]) for w, a, b in zip(least, ends, ends[1:], strict=False))
                s, whole = near_dedup.weighted_jaccard(vectors[i], vectors[j], weights), maps[i][1] + maps[j][1]
                assert bound <= whole * (1 - s) / (1 + s) + 1e-6
