"""The training-data operators against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import common, embedding_dedup, exact_dedup, html_text, linear, mixing, near_dedup, packing, quality, token_counts, toxicity, warc
from tracewell.llm.common import connected_components, new_path, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
#: Nulls in every column, empty and blank texts, ties, a repeated row, a shared id, a very long text.
ROWS = [
    (1, "one two three four five six", "en", "a", 27), (2, "one  two three\tfour five six", "en", "b", 28), (3, "onetwothreefourfivesix", None, "b", 22), (4, None, None, None, None),
    (5, "", "en", "a", 0), (6, " \t\n\x0b\x0c\r", "en", "a", 6), (7, LONG, "en", "b", len(LONG)), (7, LONG, "en", "b", len(LONG)), (None, "no id here at all", "en", None, 17),
    (9, "é ü 数据 🙂 no-break space", "fr", "c", 20), (9, "other text for the same id", "en", "c", 26), (10, "...!!!???", "en", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, DOCS)
    extra = {c: F.lit(i) for i, c in enumerate(("id", "size", "key", "node", "h", "norm", "a", "b", "rank", "offset", "position", "kept", "label", "c", "k"))}
    return rows.withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def blanks_out(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


# -- exact dedup -----------------------------------------------------------------------------------


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[blanks_out(r[1])].append(r)
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        seen = False
        for r in members:
            keep = r[0] == best[0] and len(r[1] or "") == len(best[1] or "") and not seen
            seen |= keep
            out.append((r[0], best[0], len(members), keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hashed", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_dedup(docs, hashed):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs, content_hash=hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute_exact(ROWS)


def test_rows_are_kept_whatever_their_columns_are_called(spark):
    rows = [(1, "a b"), (2, "ab"), (1, "other"), (3, "other "), (None, "x"), (None, "y")]
    clash = ("__id", "__sha", "__k", "__kept", "__key", "__of", "id", "sha", "k", "kept_sha", "key", "of", "any")
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(clash)})
    for kept in (exact_dedup.keep_rows(table), near_dedup.keep_one(table)):
        assert kept.columns == table.columns
        assert all(tuple(r[c] for c in clash) == tuple(range(len(clash))) for r in kept.collect())
    assert sorted(r.text for r in exact_dedup.keep_rows(table).collect()) == ["a b", "other ", "x", "y"]


def test_exact_keep_rows(docs, empty):
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(str(r.doc_id) for r in kept.collect()) == collections.Counter(str(r[0]) for r in brute_exact(ROWS) if r[3])
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_rows(empty).count() == 0


# -- mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        unit = left / sum(w[s] for s in free)
        for s in list(free):
            add = min(unit * w[s], 2 * sizes[s] - target[s])
            target[s] += add
            left -= add
            if target[s] >= 2 * sizes[s] - 1e-9:
                free.discard(s)
    return target


def test_targets_against_water_filling(spark):
    rng = np.random.default_rng(2)
    for _ in range(3):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.integers(0, 1000, 7))} | {None: int(rng.integers(1, 900))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(brute_targets(sizes), rel=1e-9, abs=1e-6)


def test_mix(docs, empty):
    rows = mixing.mix(docs, bucket_rows=2).collect()
    assert len(rows) == len(ROWS) and sum(r.size for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == math.floor(own[0].target + 1e-9) and all(0 <= r.taken <= 2 * r.size for r in own)
        order = sorted(own, key=lambda r: (hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest(), r.doc_id or 0, r.size, r.offset))
        at = 0
        for r in order:
            assert r.offset == at
            at += r.size
    again = mixing.mix(docs.repartition(3), bucket_rows=4096).collect()
    key = lambda r: str((r.doc_id, r.size, r.taken, r.offset))
    assert sorted(map(key, rows)) == sorted(map(key, again)) and mixing.mix(empty).count() == 0


def test_schedule_inverse(spark):
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        parts = mixing.segments(knots)

        def integral(t, parts=parts):
            return sum((min(t, b) - a) * (g + (g + (h - g) * (min(t, b) - a) / (b - a))) / 2 for a, b, g, h, _ in parts if t > a)

        assert integral(1.0) == pytest.approx(1.0)
        got = spark.range(1, 40).select((F.col("id") / 40).alias("q")).select("q", mixing.invert(F.col("q"), knots).alias("t")).collect()
        assert all(integral(r.t) == pytest.approx(r.q, abs=1e-9) for r in got)


def test_mixed_documents(spark, docs, empty):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    goal = {r.source: math.floor(r.target + 1e-9) for r in mixing.mix(docs).collect()}
    assert dict(words) == {s: n for s, n in goal.items() if n} and mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_documents_uses_each_row_as_planned(spark, seed):
    """Ids, sources and sizes that repeat, null ids and sources, and columns with any names."""
    rng = np.random.default_rng(seed)
    rows = [(None if x < 2 else int(x), " ".join(f"t{k}w{j}" for j in range(int(rng.integers(0, 5)))), [None, "a", "b"][int(rng.integers(3))]) for k, x in enumerate(rng.integers(0, 12, 60))]
    rows += rows[:6]
    clash = ("id", "of", "size", "k", "use_id", "use_k", "__id", "__k", "__doc", "__row", "pass", "words", "at", "position")
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(i) for i, c in enumerate(clash)})
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns
    got = out.collect()
    assert all(tuple(r[c] for c in clash) == tuple(range(len(clash))) for r in got)
    plan = mixing.mix(table).collect()
    per = lambda it: {k: v for k, v in it.items() if v}
    have, want = collections.Counter(), collections.Counter()
    for r in got:
        have[r.doc_id, r.source] += len(r.text.split())
    for r in plan:
        want[r.doc_id, r.source] += r.taken
    assert per(have) == per(want)
    whole = collections.Counter(" ".join(r.text.split()) for r in got)
    copies = collections.Counter(t for _, t, _ in rows)
    assert all(n <= 2 * copies[t] for t, n in whole.items() if t in copies)
    cut = [t for t in whole if t not in copies]
    assert len(cut) <= 6 and all(any(t2.startswith(t + " ") for t2 in copies) for t in cut)


# -- tokens and packing ----------------------------------------------------------------------------


def best_split(word, scores, byte_score):
    marked = "▁" + word
    best = [(0.0, 0)] + [None] * len(marked)
    for d in range(1, len(marked) + 1):
        options = [(best[j][0] + scores[marked[j:d]], -(-best[j][1] + 1)) for j in range(d) if marked[j:d] in scores]
        if marked[d - 1] not in scores:
            n = len(marked[d - 1].encode())
            options.append((best[d - 1][0] + n * byte_score, best[d - 1][1] - n))
        best[d] = max(options)
    return -best[-1][1]


def test_token_counts(docs, empty, monkeypatch):
    scores, byte_score = token_counts.piece_scores("piece_bpe_32k.model")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs.where("length(text) < 1000 or text is null")).collect()))
    want = sorted((r[0] or 0, len((r[1] or "").split()), sum(best_split(w, scores, byte_score) for w in (r[1] or "").split())) for r in ROWS if len(r[1] or "") < 1000)
    assert got == want and token_counts.token_counts(empty).count() == 0
    monkeypatch.setattr(token_counts, "TRIE_WORDS", 3)
    trie = token_counts.Trie(scores, byte_score)
    words = ["hello", "help", "helpful", "hello", "x" * 300, "naïve", "数据"]
    assert [trie.count([w]) for w in words] == [best_split(w, scores, byte_score) for w in words]
    trie.clear()
    trie.count(["help", "helpful", "helps", "hel"])
    assert len(trie.best) == len("▁helpful") + len("s") + 1  # shared prefixes are scored once
    assert trie.count(words * 2) == 2 * sum(best_split(w, scores, byte_score) for w in words)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    whole = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in ROWS]
    rows = packing.pack(docs.repartition(3)).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
    for (doc_id, n), own in pieces.items():
        texts = [w for w, r in zip(whole, ROWS, strict=True) if r[0] == doc_id and len(w) == n]
        assert sum(r.length for r in own) == n * len(texts)
        at = 0
        for r in sorted(own, key=lambda r: r.start) if len(texts) == 1 else []:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + r.length], "<u4").tobytes())
            at += r.length
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_word_encoder_equals_the_tokenizer():
    enc = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"), limit=5000)
    odd = "Hello, World's İstanbul ΑΣ Σ. don't <|endoftext|> a<|startoftext|>b ǅ ŉ é H̱ \x1cab x y 12ab ²³ naïve! ß k ﬁ \x85z ,,. _a_ the%%% UPPER!!"
    for text in (odd, *[r[1] or "" for r in ROWS[:6]], odd * 3):
        assert enc.encode(text)[:-1].tolist() == enc.encode(text.encode())[:-1].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_packer_keeps_few_windows_open():
    packer, rng = packing.Packer(64, 4), np.random.default_rng(1)
    total = 0
    for k in range(500):
        n = int(rng.integers(1, 150))
        packer.add(k, np.arange(n, dtype=np.uint32))
        total += n
        assert len(packer.windows) <= 4
    assert all(sum(p[2] for p in s) == 64 and all(p[5] is None for p in s) for s in packer.done)
    left = packing.merge_leftovers([p for w in packer.windows for p in w[1]], 64)
    assert 64 * len(packer.done) + sum(p[2] for s in left for p in s) == total


# -- archives --------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a/x y\r\n", "<p>" + "same " * 40 + "</p>"), (2, None, "<p>" + "same " * 40 + "</p>"), (3, "http://b", None), (4, "http://b", ""), (5, "http://c", "short"), (6, "http://c", "short"), (None, "u", "<p>" + "same " * 40 + "</p>"),
    (8, "http://d", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é数" * 50), (8, "http://d", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é数" * 50), (9, "http://e", "z" * 300_000),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives(spark, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("file", F.lit("x"))
    raw, out = new_path(spark, "raw"), new_path(spark, "out")
    warc.write_pages(pages, raw, compression=compression)
    back = warc.read_archives(spark, raw)
    assert sorted((r.page_id or 0, bytes(r.payload).decode()) for r in back.collect()) == sorted((p[0] or 0, p[2] or "") for p in PAGES)
    warc.deduplicate(spark, raw, out, compression=compression)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolve(spark, out).collect()), key=str)
    want, first = [], {}
    for p, _, h in sorted(PAGES, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        again = len(data) >= 100 and data in first
        want.append((p or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, p)
    assert got == sorted(want, key=str)
    ids = [r.record_id for r in warc.read_archives(spark, out, False).collect()]
    assert len(set(ids)) == len(PAGES) and not set(ids) & {r.record_id for r in back.collect()}


def test_empty_archives_and_broken_ones(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.Reader(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


# -- near duplicates -------------------------------------------------------------------------------


def near_corpus(seed=7):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(4000)])
    texts, made = [], 0
    for _ in range(25):
        base = list(rng.choice(words, int(rng.integers(60, 300))))
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for i in rng.choice(len(copy), int(rng.integers(0, 7)), replace=False):
                copy[i] = f"z{made}"
                made += 1
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper().replace(" ", ", "), "", "!!!", "few words", "few words", "other few words"]
    return [(i * 3 % 211 + 1000 * (i // 211), t) for i, t in enumerate(texts)]


def brute_classes(rows, idf, least=0.8):
    vectors = {i: near_dedup.compact(near_dedup.shingles(t)[0]) for i, t in rows}
    parent = {i: i for i in vectors}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(vectors)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(vectors[a]) and len(vectors[b]) and near_dedup.weighted_jaccard(vectors[a], vectors[b], idf) >= least:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_dedup_against_all_pairs(spark):
    rows = near_corpus()
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("id", "node", "bucket", "class", "key", "sim")})
    counts, n = near_dedup.document_frequencies(near_dedup.vectors(table.selectExpr("doc_id as id", "text")))
    assert n == sum(1 for _, t in rows if re.search(r"\w", t))
    want = brute_classes(rows, near_dedup.inverse_frequencies(counts, n))
    got = near_dedup.near_dedup(table).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    assert {r.doc_id for r in near_dedup.keep_one(table).collect()} == set(want.values())


def test_near_dedup_awkward(docs, empty):
    got = collections.Counter((str(r.doc_id), str(r.class_id), r.kept) for r in near_dedup.near_dedup(docs).collect())
    assert got["7", "7", True] == 1 and got["7", "7", False] == 1 and got["None", "None", True] == 1
    assert got["2", "1", False] == 1 and got["4", "4", True] == got["5", "5", True] == got["6", "6", True] == got["10", "10", True] == 1
    assert near_dedup.near_dedup(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    same = want = 0.0
    for _ in range(60):
        h = rng.integers(1, 2**63, 150).astype(np.uint64)
        a, b = rng.uniform(0.5, 4, 100), rng.uniform(0.5, 4, 100)
        x, y = near_dedup.weighted_samples(h[:100], a), near_dedup.weighted_samples(h[50:], b)
        wa, wb = np.zeros(150), np.zeros(150)
        wa[:100], wb[50:] = a, b
        same += (x == y).mean()
        want += np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert same / 60 == pytest.approx(want / 60, abs=0.03)
    assert (near_dedup.weighted_samples(h, np.ones(150), block=7) == near_dedup.weighted_samples(h, np.ones(150))).all()


# -- vectors ---------------------------------------------------------------------------------------


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 64))
    vectors = np.concatenate([base, base[:12] + 0.02 * rng.standard_normal((12, 64)), base[:12] * 2, base[:12] + 0.13 * rng.standard_normal((12, 64)), base[:5], base[5:9]])
    rows = [(i, [float(x) for x in v], int(i % 30 % 2)) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [0.0] * 64, 1), (202, [float("nan")] + [1.0] * 63, 1), (203, [None] + [1.0] * 63, 1), (204, rows[0][1], None), (205, [], 0), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0), (208, [float("inf")] + [1.0] * 63, 1), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "vec", "key", "ok", "n", "block")})
    ok = {i: (np.array(v), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = collections.defaultdict(set)
    for i, (a, x) in ok.items():
        for j, (b, y) in ok.items():
            if i != j and x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i].add(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        return min(seen)

    for block_rows in (2048, 7):
        got = embedding_dedup.embedding_dedup(table, block_rows=block_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is None:
                assert r.kept and r.n_links == 0 and r.component_id is None
            else:
                assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), reach(r.vec_id), reach(r.vec_id) == r.vec_id), r
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.standard_normal((40, 64)), rng.standard_normal((40, 64))))
    total = np.zeros((40, 40))
    for seed in range(300):
        turn = embedding_dedup.rotation(64, seed)
        signs, factor = embedding_dedup.encode(x, turn)
        total += embedding_dedup.estimate(signs, factor, y @ turn.T)
    assert np.abs(total / 300 - x @ y.T).max() < 0.05
    near = x + 0.02 * rng.standard_normal(x.shape)
    bits, factor, queries, step = embedding_dedup.pack(x * 3)
    assert bits.shape == (40, 8) and queries.dtype == np.int8 and np.allclose(factor, embedding_dedup.encode(x, embedding_dedup.rotation(64))[1])
    assert np.abs(queries * step[:, None] - x @ embedding_dedup.rotation(64).T).max() <= step.max() / 2 + 1e-12
    i, j, exact = embedding_dedup.links_between(x * 1e300, near * 1e-300)
    assert set(zip(i, j, strict=True)) == {(a, b) for a, b in zip(*np.nonzero(x @ near.T / np.linalg.norm(near, axis=1) >= 0.98), strict=True)}
    i, j, exact = embedding_dedup.links_between(x, near)
    assert {(a, b) for a, b in zip(i, j, strict=True)} == {(a, b) for a, b in zip(*np.nonzero(x @ near.T / np.linalg.norm(near, axis=1) >= 0.98), strict=True)} and exact < 200


@pytest.mark.parametrize("bound", [100_000, 0])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- pages -----------------------------------------------------------------------------------------


def test_html_text():
    scores = html_text.learn(["<html><body><nav><a href=x>menu here</a></nav><article><h1>T t</h1><p>many words are in here</p></article><footer>foot</footer></body></html>"] * 30)
    get = lambda page: html_text.extract(page, scores)
    assert get("<html><head><title>no</title><style>p{}</style><script>var a='</p>';</script></head><body><nav>menu</nav><div class=\"ad\">buy this now</div><article><h1>A &amp; B</h1><p><b>one  two<br>three<p>four &lt;five&gt;&nbsp;six</article><footer>end") == "A & B\n\none two three\n\nfour <five> six"
    page = "<body><header>Site</header><div id=sidebar>side words here</div><div><p>First paragraph of the text.</p><p>Second <a href=y>linked words</a> go on.</p><form>name</form><div class='reader-comments'><p>nice post</p></div></div><div class=cookie-notice>we use cookies</div></body>"
    assert get(page) == "First paragraph of the text.\n\nSecond linked words go on."
    assert get(None) == get("") == get("<div></div>") == get("<script>x") == "" and get("just text") == "just text"
    assert len(get("<p>" + "word " * 100_000)) == 499_999 and get('<p title="a>b">x y</p><p unclosed="q>z w</p>').startswith("x y")


def wanted(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    parts = [re.sub(r"\s+", " ", html_text.entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_html_query_matches_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.html_text(pages.withColumns({"text": F.lit(1), "key": F.lit(2), "inside": F.lit(3)})).collect()}
    rows = pages.collect()
    weights = html_text.learn([r.html for r in rows])
    for r in rows:
        assert got[r.page_id].text == wanted(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)
        # The same page without the element that marks the article: marks, tags and the scan alone.
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.extract(plain, weights) == wanted(r.html)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.html_text(odd).collect()) == [(0, ""), (1, ""), (1, "")]
    assert html_text.html_text(odd.where("false")).count() == 0


def test_html_region_against_all_regions():
    """The scan finds the best of all contiguous regions, for scores of real pages and for any others."""
    rng = np.random.default_rng(9)
    weights = html_text.weigh({"nav": (0, 50), "open li": (2, 60), "open p": (80, 4), "in p": (900, 40)})
    page = html_text.parse("<nav><ul><li><a>x</a><li><a>y</a></ul></nav><div><p>one two three</p><div class=ad>buy now</div><p>four five</p></div><p>last <a>link</a></p><footer>end</footer>")
    lists = [html_text.item_scores(page, weights)] + [rng.normal(-0.1, 1, int(rng.integers(1, 40))).round(2).tolist() for _ in range(200)] + [[-1.0] * 5, [0.0, 0.0], []]
    for scores in lists:
        first, last = html_text.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
        assert sum(scores[first:last]) == pytest.approx(max(best, 0.0))


def test_html_odd_pages():
    weights = html_text.learn(["<html><body><nav><a href=x>menu here</a></nav><article><h1>T t</h1><p>many words are in here</p></article><footer>foot</footer></body></html>"] * 30)
    get = lambda page: html_text.extract(page, weights)
    text = " ".join(f"word{i}" for i in range(90))
    assert get(f"<body><form><nav><a href=x>menu</a></nav><div><p>{text}</p></div></form></body>") == text
    assert get(f"<div class='legal notice'><p>{text}</p></div><footer>end</footer>") == text
    assert get(f"<article><h2>t</h2></article><div><p>{text}</p></div>").endswith(text)
    assert get(f"<div><p>{text}</p></div><div class=comments>{'nice post friend ' * 400}</div>") == text
    assert get(f"<article><p>{text}</p><form>your name</form><aside>side</aside><div class=ad>{'buy ' * 500}</div><p>{text}</p></article><p>outside</p>") == f"{text}\n\n{text}"
    assert get("<article><p>see <math><mi>x</mi><mo>+</mo><mi>y</mi></math> here</p></article>") == "see x+y here"
    assert get(f"<p>{text}</p><ul><li>one<li>two</ul>") == f"{text}\n\none\n\ntwo" and get("a < b and c <3") == "a < b and c <3"
    assert html_text.learn([]) == html_text.weigh({}) and html_text.extract(f"<nav>menu</nav><p>{text}</p>", html_text.weigh({})) == text


def test_html_learnt_weights_decide(monkeypatch):
    """Without weights boilerplate comes out; pages alone teach what it is, whatever names are listed."""
    nav, ad, foot = "<nav><a href=x>menu here</a></nav>", "<div class=ad>buy this now and here</div>", "<footer>foot of it</footer>"
    pages = [f"<body>{nav}{ad}<article><h1>T t</h1><p>many words are in here</p></article>{foot}</body>"] * 60
    text = " ".join(f"word{i}" for i in range(40))
    weights = html_text.learn(pages)
    for box in ("article", "div"):
        page = f"<body>{nav}{ad}<{box}><h1>H</h1><p>{text}</p></{box}>{foot}</body>"
        assert html_text.extract(page, weights) == f"H\n\n{text}" != html_text.extract(page, {})
    # An element or a name that articles hold loses its mark; one beside them gets a greater one.
    held = html_text.learn([f"<body>{nav}<article><p>some words</p><aside>a note of the author</aside></article></body>"] * 60)
    assert held["aside"] > 0 > weights["aside"] and weights["advert"] < html_text.weigh({})["advert"] < 0
    assert html_text.extract(f"<article><p>{text}</p><aside>a note</aside></article>", held) == f"{text}\n\na note"
    monkeypatch.setattr(html_text, "_HOLDS", {})
    assert html_text.extract(f"<body>{nav}{ad}<div><h1>H</h1><p>{text}</p></div>{foot}</body>", html_text.learn(pages)) == f"H\n\n{text}"


def test_html_names_that_are_like_marks():
    weights = html_text.learn(["<body><nav>menu</nav><div class=ad>buy</div><article><h1>T</h1><p>many words are in here</p></article></body>"] * 60)
    get = lambda page: html_text.extract(page, weights)
    text = " ".join(f"word{i}" for i in range(40))
    for name in ("search-trees", "legal-history", "share_prices", "popular-music"):
        assert get(f"<article><p>{text}</p><section id='{name}'><h2>Part</h2><p>{text}</p></section></article>") == f"{text}\n\nPart\n\n{text}"
        assert get(f"<p>{text}</p><div class='{name}'>not of it</div>") == text
    for name in ("related-posts", "comment-list-2", "ad_728x90", "share-buttons", "side-bar", "cookie-notice", "site-header left"):
        assert get(f"<article><p>{text}</p><div class='{name}'>not of it</div><p>{text}</p></article>") == f"{text}\n\n{text}"
    assert get(f"<nav>a</nav><div class=post><header><h1>Title</h1><p>subtitle</p></header><p>{text}</p></div>") == f"Title\n\nsubtitle\n\n{text}"
    assert get(f"<header><h1>Site</h1></header><div><p>{text}</p></div>") == text
    assert get(f"<div class='{'ad_' * 30_000}x'>{text}</div><p>{text} y</p>").endswith("y")


@pytest.mark.parametrize("part", ['<a "', '<a ="', "<div></b>", "<i><div><b></i>", "<!--", "<![CDATA[", "<script>", "<b ", "<i>", "<p x='>", "<", "</p>"])
def test_html_scan_is_linear(part):
    import time

    weights = html_text.weigh({})

    def seconds(n):
        began = time.process_time()
        html_text.extract(part * n, weights)
        return time.process_time() - began

    assert seconds(40_000) < 12 * max(seconds(10_000), 0.02)


# -- classifiers -----------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality(d, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    odd = quality.quality(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert quality.quality(empty, labels).count() == 0 and {r.score for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}


def test_toxicity(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    unseen = labels.where("doc_id % 3 = 1").select("doc_id", F.col("toxic").alias("y"))
    got = toxicity.toxicity(d.join(unseen, "doc_id", "left_semi").unionByName(d.where("doc_id % 3 <> 1").join(labels, "doc_id", "left_semi")), labels.where("doc_id % 3 <> 1"))
    got = got.join(unseen, "doc_id").collect()
    bad = [r for r in got if r.y == 1]
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad) and sum(r.toxic and r.y == 0 for r in got) <= 0.005 * len(got)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.toxicity(empty, labels).count() == 0 and not any(r.toxic for r in toxicity.toxicity(docs, labels.where("false")).collect())


def test_chain_learns_from_out_of_fold_probabilities(monkeypatch):
    seen = []
    real = linear.train
    monkeypatch.setattr(toxicity, "train", lambda rows, y, epochs, **o: seen.append(len(rows)) or real(rows, y, epochs, **o))
    rng = np.random.default_rng(6)
    found = [(np.unique(rng.integers(0, 1000, 8)), None) for _ in range(50)]
    found = [(i, np.ones(len(i))) for i, _ in found]
    chain = toxicity.fit_chain(found, [(int(rng.integers(2)), int(rng.integers(2))) for _ in found])
    assert [len(w) for w in chain] == [(1 << linear.BITS) + 1, (1 << linear.BITS) + 2] and seen == [50, 40, 40, 40, 40, 40, 50]


@pytest.mark.parametrize("marks", [[], [(1, 0)], [(1, 0)] * 4, [(0, 1)] * 3, [(1, 0), (0, 1)], [(1, 0)] * 12, [(1, 0)] * 16 + [(0, 1)] * 4])
def test_few_labels_reject_nothing_else(spark, marks):
    """0 to 20 labels, of one class or two: no text without a telling word is rejected."""
    text = lambda i, toxic: " ".join(f"clean{(i * 7 + j) % 40}" for j in range(12)) + (" nasty" * 3 if toxic else "")
    rows = [(i, text(i, toxic), None) for i, (_, toxic) in enumerate(marks)] + [(100 + i, text(i, False), "x") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string").withColumns({"__text": F.lit(1), "__p_toxic": F.lit(2), "text_to_score": F.lit(3)})
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(marks)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(table, labels)
    assert kept.columns == table.columns
    got = kept.collect()
    assert {r.doc_id for r in got} >= {100 + i for i in range(30)} and {(r["__text"], r["__p_toxic"], r.text_to_score) for r in got} == {(1, 2, 3)}


def test_chain_against_its_definition():
    """Scores of a two-link chain, with the links' training written out plainly."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 10)) + (" bad" if k % 3 == 0 else "") + (" vile" if k % 6 == 0 else "") for k in range(60)]
    marks = [(int(k % 3 == 0), int(k % 6 == 0)) for k in range(60)]
    found = [linear.word_features(t) for t in texts]

    def fit(rows, y):
        size = (1 << linear.BITS) + 1 + (len(rows[0]) - 2)
        z, n, o = np.zeros(size), np.zeros(size), toxicity.OPTIONS
        bias = 1 << linear.BITS

        def weight(k):
            l1 = 0.0 if k == bias else o["l1"]
            return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((1.0 + math.sqrt(n[k])) / o["alpha"] + 1e-3)

        def features(row):
            return [(int(k), 1.0) for k in row[0]] + [(bias, 1.0)] + [(bias + 1 + j, float(np.float32(p))) for j, p in enumerate(row[2:])]

        for _ in range(toxicity.EPOCHS):
            for row, label in zip(rows, y, strict=True):
                w = [(k, v, weight(k)) for k, v in features(row)]
                p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(v * x for _, v, x in w)))))
                for k, v, x in w:
                    g = (o["positive"] if label else 1.0) * (p - label) * v
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / o["alpha"] * x
                    n[k] += g * g
        last = lambda k: min(weight(k), -0.01) if k == bias else weight(k)
        return lambda row: 1 / (1 + math.exp(-sum(v * float(np.float32(last(k))) for k, v in features(row))))

    first = fit(found, [m[0] for m in marks])
    unseen = [0.0] * 60
    for fold in range(toxicity.FOLDS):
        seen = [k for k in range(60) if k % toxicity.FOLDS != fold]
        model = fit([found[k] for k in seen], [marks[k][0] for k in seen])
        for k in range(fold, 60, toxicity.FOLDS):
            unseen[k] = model(found[k])
    second = fit([(*f, p) for f, p in zip(found, unseen, strict=True)], [m[1] for m in marks])
    chain = toxicity.fit_chain(found, marks)
    for text in [*texts[:12], "vile bad", "", "nothing known"]:
        f = linear.word_features(text)
        p = first(f)
        assert toxicity.chain_scores(chain, text) == pytest.approx([p, second((*f, p))], abs=1e-4)


def test_ftrl_equals_its_definition():
    rng, model = np.random.default_rng(8), linear.Ftrl(bits=3, alpha=0.7, beta=1.0, l1=0.2, l2=0.1)
    z, n = np.zeros(9), np.zeros(9)
    for _ in range(60):
        i, x, y = np.unique(rng.integers(0, 9, 4)), None, float(rng.integers(2))
        x = rng.standard_normal(len(i))
        l1 = {8: 0.0}  # the bias
        w = [0.0 if abs(z[k]) <= l1.get(k, 0.2) else -(z[k] - math.copysign(l1.get(k, 0.2), z[k])) / ((1.0 + math.sqrt(n[k])) / 0.7 + 0.1) for k in i]
        p = 1 / (1 + math.exp(-float(np.dot(w, x))))
        for k, v, wk in zip(i, x, w, strict=True):
            g = (p - y) * v
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.7 * wk
            n[k] += g * g
        model.update(i, x, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_schema_of_results_is_stable(docs):
    assert isinstance(mixing.mix(docs).schema["taken"].dataType, T.LongType)
