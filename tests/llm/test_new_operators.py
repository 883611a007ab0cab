"""Substring dedup, hard negatives and the Merkle manifest against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives, merkle, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- substring dedup -------------------------------------------------------------------------------


def brute_substrings(rows, least):
    first, docs = {}, []
    for i, text in rows:
        words = WORD.findall(text or "")
        docs.append((i, words))
        for s in range(len(words) - least + 1):
            place = (i is None, i or 0, s)
            key = tuple(words[s : s + least])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, words in docs:
        gone = set()
        for s in range(len(words) - least + 1):
            if first[tuple(words[s : s + least])] < (i is None, i or 0, s):
                gone.update(range(s, s + least))
        out.append((i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out, key=str)


def passages(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    shared = [" ".join(draw.choice(words) for _ in range(draw.randrange(15, 90))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(draw.randrange(0, 60)))]
        parts += [draw.choice(shared) for _ in range(draw.randrange(3))]
        draw.shuffle(parts)
        rows.append((i * 7, draw.choice([" ", "\n", "\t\x0b "]).join(parts)))
    rows += [(4000, rows[5][1]), (4001, rows[5][1].replace(" ", "\n")), (4002, None), (4003, ""), (4004, " \n\r"), (None, rows[6][1]), (4005, "é " * 45), (4006, "x" + chr(0xA0) + "y " + "z" + chr(0x1F) + "q"), (4005, "ü " * 45)]
    rows += [(4007, rows[7][1]), (4007, rows[7][1]), (4008, "same " * 300), (5000, shared[0]), (-3, shared[0])]
    return rows


@pytest.mark.parametrize("least", [20, 8])
def test_substrings_equal_brute_force(spark, least):
    rows = passages(least)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "id", "txt", "p", "n", "o", "spans", "names")})
    got = substring_dedup.substring_dedup(table.repartition(5), least=least).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_substrings(rows, least)
    for r in got:
        assert sum(x.length for x in r.spans) == r.n_removed and all(x.length >= least for x in r.spans)


def test_substrings_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(empty, least=21)


def test_names_do_not_depend_on_blocks_and_pieces(monkeypatch):
    text = ("alpha beta " * 40 + "x" * 500 + "  é数据 alpha").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 30, 30, len(text)])
    starts = substring_dedup.word_starts(data, offsets)
    whole = substring_dedup.word_names(data, starts)
    monkeypatch.setattr(substring_dedup, "BLOCK", 64)
    substring_dedup._tables.cache_clear()
    assert (substring_dedup.word_names(data, starts) == whole).all()
    substring_dedup._tables.cache_clear()
    words = [text[a:b].split()[0] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    assert len(set(zip(words, whole.tolist(), strict=True))) == len(set(words)) == len(set(whole.tolist()))

    def windows(piece):
        """Windows of one long text that a task settles or sends on."""
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([1], pa.int32()), pa.array([" ".join(f"{i % 83}.{i % 7}" for i in range(900))])], names=["id", "txt", "text"])
        held = set()
        for out in substring_dedup._anchors(20)(iter([batch])):
            for r in out.to_pylist():
                p = r["spot"] & 0xFFFFFFFF
                assert r["spot"] >> 32 == 1
                if r["names"] is None:
                    held |= set(range(p, p + r["halves"]))
                else:
                    held |= {p - r["names"][0] + j for j in range(len(r["names"]) // substring_dedup.NAME)}
        return held

    assert windows(1 << 20) == windows(100) == set(range(881))


# -- hard negatives --------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor):
    rows = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, label, q in {(i, lab, tuple(v)) for i, lab, v in rows if is_anchor(i)}:
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scored = [(clip(sum(int(x) * int(y) for x, y in zip(q, v, strict=True))), i, lab) for i, lab, v in rows if len(v) == len(q)]
        for p, i, lab in sorted((x for x in scored if x[2] == label and x[1] != a), key=lambda x: (-x[0], x[1]))[:5]:
            fits = sorted(((s, j) for s, j, other in scored if other != label and 30 * p <= 100 * s <= 90 * p), key=lambda x: (-x[0], x[1]))[:10]
            out += [(a, i, k, j, p, s) for k, (s, j) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_negatives_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(c) for c in draw.integers(-200, 200, 6)], int(draw.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[7][1], i % 4) for i in range(300)]  # many copies of one vector
    rows += [(2000, None, 1), (2010, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (2020, [float("nan")] * 6, 1), (2030, [float("inf")] + [0.0] * 5, 2), (2040, [], 1), (2050, [0.0] * 6, 1), (2060, rows[3][1], None)]
    rows += [(None, rows[3][1], 1), (2070, [5.0, 4.0], 1), (2071, [5.0, 3.0], 1), (2072, [2.0, 3.0], 2), (2080, [3.0, 1.0], 9), (400, rows[4][1], 2), (400, rows[4][1], 2)]
    rows += [(3000, [2.0**30 + 1] * 3, 1), (3001, [2.0**30 + 3] * 3, 1), (3002, [2.0**29 + 1] * 3, 2)]  # sums that doubles can't hold
    rows += [(3010, [2.0**70] * 4, 1), (3011, [2.0**70] * 4, 1), (3012, [1e300] * 4, 2), (3013, [1e-300] * 4, 2)]  # nor longs
    table = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("id", "vec", "dim", "block", "turn", "asks", "n", "m", "anchor", "place")})
    got = hard_negatives.hard_negatives(table.repartition(3), F.col("vec_id") % 10 == 0, block_rows=150).collect()
    want = brute_negatives([(i, lab, v) for i, v, lab in rows], lambda i: i % 10 == 0)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == want
    assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_opens_only_the_annulus():
    draw = np.random.default_rng(5)
    x = np.floor(draw.standard_normal((3000, 3)) * 256)
    tree = hard_negatives.VantageTree(x, np.arange(3000), np.zeros(3000), leaf=32)
    looked = []
    scores = tree.scores
    tree.scores = lambda first, last, q: looked.append(last - first) or scores(first, last, q)
    true = x @ x[0]
    top = int(np.sqrt((x * x).sum(axis=1).max() * true[0]))
    for low, high, most in ((None, None, 1500), (1000, 40_000, 2999), (-5000, 0, 2999), (top + 1, 2 * top, 0), (10**7, None, 0)):
        looked.clear()
        want = sorted((-int(s), i) for i, s in enumerate(true) if (low is None or s >= low) and (high is None or s <= high))[:7]
        assert hard_negatives.Walk(tree, x[0], np.ones(3000, bool)).nearest(low, high, 7) == [(i, -s) for s, i in want]
        assert sum(looked) <= most


def test_steps_keep_what_is_not_finite(spark):
    row = spark.createDataFrame([([0.5, -0.001, float("nan"), float("inf"), None, 1e300],)], "v array<double>").select(F.transform("v", lambda x: hard_negatives.in_steps(x)).alias("v")).first().v
    assert row[:2] == [128.0, -1.0] and np.isnan(row[2]) and row[3:5] == [float("inf"), None] and row[5] == 256e300


# -- the Merkle manifest ---------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_tree(leaves):
    """The root, and for each leaf its siblings from the bottom up."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            paths[i].append(("L" if place % 2 else "R") + nodes[other] if other < len(nodes) else "")
        nodes = [sha(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0] if nodes else None, paths


def brute_manifest(rows):
    leaf = lambda r, n: sha(field(r[0]), field(r[3]), field(r[2]), field(n), field(r[1]))
    langs = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[4] + 1 if bad else r[4])))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs = {x: brute_tree([r[2] for r in sorted(langs[x])]) for x in names}
    root, tops = brute_tree([subs[x][0] for x in names])
    out = []
    for x, top in zip(names, tops, strict=True):
        for r, path in zip(sorted(langs[x]), subs[x][1], strict=True):
            path, fold = path + top, r[3]
            for s in path:
                fold = sha(s[1:], fold) if s[:1] == "L" else sha(fold, s[1:])
            out.append((r[1] if r[0] else None, r[2], subs[x][0], root, sha(*(s[1:] for s in path)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 12])
def test_manifest_equals_brute_force(spark, depth):
    rows = [(i, f"text {i}", "en", "a", i) for i in range(37)] + [(i, f"té {i}", "fr", None, None) for i in range(100, 108)]
    rows += [(500, "one", "de", "b", 3), (501, None, None, None, None), (None, "no id", "en", "a", 5), (None, "", "en", "a", 0), (3, "text 3", "en", "a", 3), (3, "text 3", "en", "a", 3), (502, "x" * 100_000, "z\U0001f642", "a", 1), (503, "y", "z￿", "a", 1), (504, "y", "", "a", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("id", "key", "h", "idx", "path", "tampered", "checked", "leaf", "root")})
    got = merkle.document_manifest(table.repartition(3), depth=depth).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str) == brute_manifest(rows)


def test_manifest_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.document_manifest(empty).count() == 0
    (row,) = merkle.document_manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)).collect()
    assert row.leaf == row.subroot == row.root and row.path == [] and row.verified
