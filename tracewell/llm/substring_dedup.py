"""Substring dedup: passages that a corpus holds before, found by level-wise doubling.

Windows of a quarter of the least length are looked at first. Only those that repeat are extended
to twice their length, those that repeat again to the whole length, where the earliest place of
each window decides. A window's name at one length is made of the names of its two halves.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of the shortest passage that is removed.
LEAST = 20
#: Bytes of text whose words are named together (one text may hold more), words whose windows are
#: compared together, and bytes that are hashed at once.
SLICE, PIECE, BLOCK = 8 << 20, 1 << 20, 1 << 18
#: Bytes of a window's name that go to the last level.
NAME = 6
#: Stands for a null id in the order of documents.
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
#: What a task says of an anchor: its name; its document; the text's hash and the anchor's word, 32 bits
#: each; the halves' names, likewise; the first window's offset, then the windows' names.
_ANCHOR = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("spot", pa.int64()), ("halves", pa.int64()), ("names", pa.binary())])
ANCHOR = "h long, id long, spot long, halves long, names binary"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each ordered pair of names."""
    x = a * np.uint64(_BASE) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte (0 for white space), and powers of the base with their inverses."""
    byte = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    byte[[9, 10, 11, 12, 13, 32]] = 0
    powers = np.full(BLOCK, _BASE, np.uint64)
    inverse = np.full(BLOCK, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return byte, np.cumprod(powers), np.cumprod(inverse)


def word_names(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each word: the sum of its bytes' numbers times powers of the base. ``data`` is
    UTF-8; a word goes from its start to the next white space or start."""
    byte, powers, inverse = _tables()
    sums = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), BLOCK):
        part = byte[data[a : a + BLOCK]]
        part *= powers[: len(part)]
        i, j = np.searchsorted(starts, [a, a + BLOCK])
        cuts = starts[i:j] - a
        head = cuts[0] if len(cuts) else len(part)
        if i and head:  # the rest of a word that began in an earlier block
            sums[i - 1 : i] += part[:head].sum(keepdims=True) * np.uint64(pow(_BASE, int(a - starts[i - 1]), 1 << 64))
        if len(cuts):
            sums[i:j] += np.add.reduceat(part, cuts) * inverse[cuts]
    return mix(sums, sums >> np.uint64(17))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of concatenated texts begin; ``offsets`` are the texts' bounds."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.empty(len(data), bool)
    begins[:1] = True
    begins[1:] = space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins & ~space)


def _later(names: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which windows have an equal one that starts earlier, among these windows alone."""
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    twin = np.zeros(len(names), bool)
    same = ordered[1:] == ordered[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    own = order[twin]
    own = own[np.lexsort((places[own], ids[own], names[own]))]
    out = np.zeros(len(names), bool)
    if len(own):
        first = np.ones(len(own), bool)
        first[1:] = names[own][1:] != names[own][:-1]
        lead = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
        out[own] = (ids[own] != ids[lead]) | (places[own] != places[lead])
    return out


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The low 32 bits of two numbers in one."""
    return (high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64) & np.uint64(0xFFFFFFFF)).view(np.int64)


def _piece(words: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, txt: np.ndarray, least: int, limit: int):
    """Rows for the windows that start at the first ``limit`` of these words.

    Each window is told by its anchor, the shortest-level window in it with the least name: equal
    windows have equal anchors at equal offsets, so only anchors are looked at. Windows that
    repeat an earlier one of the piece are settled here; a row with no names holds a run of them.
    """
    quarter = least // 4
    n = len(words) - least + 1
    if n <= 0:
        return
    one = words[: len(words) - quarter + 1].copy()
    for j in range(1, quarter):
        one = mix(one, words[j : j + len(one)])
    two = mix(one[:-quarter], one[quarter:])
    four = mix(two[: -2 * quarter], two[2 * quarter :])
    s = np.flatnonzero(doc[:n] == doc[least - 1 :])
    s = s[s < limit]
    if not len(s):
        return
    anchor = np.lib.stride_tricks.sliding_window_view(one, least - quarter + 1)[: s[-1] + 1].argmin(axis=1)[s] + s
    names = four[s]
    settled = _later(names, ids[doc[s]], place[s])
    fresh = np.ones(len(s), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(s)))
    open_ = np.add.reduceat((~settled).astype(np.int64), begin) > 0
    begin, size = begin[open_], size[open_]
    if len(begin):
        p = anchor[begin]
        keep = np.repeat(open_, np.diff(np.append(np.flatnonzero(fresh), len(s))))
        ends = np.concatenate([[0], np.cumsum(size * NAME + 1)])
        raw = np.empty(ends[-1], np.uint8)
        heads = np.zeros(len(raw), bool)
        heads[ends[:-1]] = True
        raw[heads] = p - s[begin]
        raw[~heads] = np.ascontiguousarray(names[keep]).view(np.uint8).reshape(-1, 8)[:, :NAME].ravel()
        blob = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        left, right = two[np.maximum(p - quarter, 0)], two[np.minimum(p, len(two) - 1)]
        yield [one[p].view(np.int64), ids[doc[p]], _pair(txt[doc[p]], place[p]), _pair(left, right), blob]
    gone = s[settled]
    if len(gone):
        cut = np.ones(len(gone), bool)
        cut[1:] = (gone[1:] != gone[:-1] + 1) | (doc[gone[1:]] != doc[gone[:-1]])
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(gone)))
        d, p = doc[gone[begin]], place[gone[begin]]
        spread = mix(ids[d].view(np.uint64), p.astype(np.uint64)).view(np.int64)
        yield [spread, ids[d], _pair(txt[d], p), size, pa.nulls(len(begin), pa.binary())]


def _slices(batch: pa.RecordBatch):
    """Rows of at most ``SLICE`` bytes of text together, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    at = 0
    ends = np.cumsum(lengths)
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _anchors(least: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                text = pc.fill_null(part.column("text"), "").cast(pa.large_binary())
                ids, txt = part.column("id").to_numpy(), part.column("txt").to_numpy()
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                if offsets[-1] == offsets[0]:
                    continue
                data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                starts = word_starts(data, offsets)
                words = word_names(data, starts)
                doc = np.searchsorted(offsets, starts, side="right") - 1
                place = np.arange(len(starts)) - np.searchsorted(doc, np.arange(len(text)))[doc]
                for a in range(0, len(words), PIECE):
                    own = slice(a, a + PIECE + least - 1)
                    for columns in _piece(words[own], doc[own], place[own], ids, txt, least, PIECE):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_ANCHOR)

    return run


def _offset_name(o: Column) -> Column:
    return F.expr(f"substring(names, {NAME} * (hi - o) + 2, {NAME})")


def repeated_windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Windows of ``docs`` (``id, txt, text``) that also start earlier: rows ``id, txt, p, mask, run``.

    Bit ``o`` of ``mask`` says that the window of ``least`` words that starts ``o`` words before
    ``p`` is one; ``run`` says that ``run`` windows from ``p`` on are. The anchor's name deals all
    levels to the tasks, so no level needs a shuffle of its own.
    """
    quarter = least // 4
    rows = docs.select("id", "txt", "text").mapInArrow(_anchors(least), ANCHOR).repartition("h")
    marks = F.col("names").isNull()
    rows = rows.select("h", "id", "names", "halves", F.shiftright("spot", 32).cast("int").alias("txt"), F.expr("cast(spot & 4294967295L as int)").alias("p"))
    rows = rows.withColumns({"l": F.shiftright("halves", 32), "r": F.expr("halves & 4294967295L"), "hi": F.conv(F.hex(F.substring("names", 1, 1)), 16, 10).cast("int")})
    low = F.expr(f"hi - (length(names) - 1) div {NAME} + 1")
    # A quarter: anchors that repeat.
    rows = rows.withColumn("n", F.count("names").over(Window.partitionBy("h"))).where(marks | (F.col("n") > 1))
    # Half: an anchor with the quarter after it for windows that hold it, else with the one before.
    rows = rows.withColumn("nr", F.count("names").over(Window.partitionBy("h", "r"))).withColumn("nl", F.count("names").over(Window.partitionBy("h", "l")))
    right, left = (F.col("nr") > 1) & (low <= 2 * quarter), (F.col("nl") > 1) & (F.col("hi") > 2 * quarter)
    rows = rows.where(marks | right | left)
    # The whole: windows whose half repeats.
    rows = rows.withColumn("o", F.explode(F.when(marks, F.array(F.lit(-1))).otherwise(F.sequence(low, F.col("hi")))))
    rows = rows.where(marks | F.when(F.col("o") <= 2 * quarter, F.col("nr") > 1).otherwise(F.col("nl") > 1))
    rows = rows.withColumn("half", F.when(F.col("o") <= 2 * quarter, F.col("r")).otherwise(F.col("l"))).withColumn("name", _offset_name(F.col("o")))
    own = F.struct("id", (F.col("p") - F.col("o")).alias("s"))
    first = F.min(own).over(Window.partitionBy("h", "o", "half", "name"))
    rows = rows.withColumn("first", first).where(marks | (F.col("first") < own))
    bit = F.when(~marks, F.expr("shiftleft(1L, o)"))
    return rows.groupBy("h", "id", "txt", "p").agg(F.bit_or(bit).alias("mask"), F.max(F.when(marks, F.col("halves"))).alias("run")).drop("h")


def _covered(hits, words: int, least: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int64)
    for hit in hits or ():
        if hit["run"] is not None:
            edge[hit["p"]] += 1
            edge[hit["p"] + hit["run"] - 1 + least] -= 1
        mask, o = hit["mask"] or 0, 0
        while mask:
            if mask & 1:
                edge[hit["p"] - o] += 1
                edge[hit["p"] - o + least] -= 1
            mask >>= 1
            o += 1
    return np.cumsum(edge[:-1]) > 0


OUT = "id long, text string, n_words long, n_removed long, spans array<struct<start:int,length:int>>"
_OUT = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])


def _without(least: int):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                texts, removed, total, spans = [], [], [], []
                for text, hits in zip(part.column("text").to_pylist(), part.column("hits").to_pylist(), strict=True):
                    words = (text or "").encode().split()  # of bytes: at these six characters alone
                    total.append(len(words))
                    gone = _covered(hits, len(words), least) if hits else np.zeros(len(words), bool)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                    spans.append([{"start": a, "length": b - a} for a, b in edges.tolist()])
                    removed.append(int(gone.sum()))
                    texts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if hits else words).decode())
                yield pa.RecordBatch.from_arrays([part.column("real"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _OUT.field("spans").type)], schema=_OUT)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Texts without passages of ``least`` words or more that start earlier in the corpus.

    A word is a run of characters other than ``[\\x20\\x09-\\x0D]``. Each word covered by a window of
    ``least`` words is removed if an equal window starts earlier: at a smaller id, or at the same
    id and an earlier word. Windows are judged on the input. One row per row of ``docs``: its id
    column, ``text`` (kept words, joined by one space), ``n_words``, ``n_removed`` and ``spans`` (removed
    runs of words, as start and length).

    ``least`` is a multiple of 4, 84 at most. A null text has no words. A null id counts as the
    greatest one. Rows that share an id stand at the same place, so equal ones among them all stay
    unless their windows start earlier elsewhere. Other columns aren't returned. Windows are equal
    if their names (64 bits for the anchor, 32 for the half, 48 for the whole) are. A text is
    moved once, to meet its repeated windows.
    """
    if least % 4 or not 4 <= least <= 84:
        raise ValueError("least has to be a multiple of 4 from 4 to 84")
    rows = docs.select(F.col(id_col).cast("long").alias("real"), F.col(text_col).alias("text"))
    rows = rows.withColumn("id", F.coalesce("real", F.lit(LAST))).withColumn("txt", F.hash("text"))
    hits = repeated_windows(rows, least).groupBy("id", "txt").agg(F.collect_list(F.struct("p", "mask", "run")).alias("hits"))
    out = rows.join(hits, ["id", "txt"], "left").select("real", "text", "hits").mapInArrow(_without(least), OUT)
    return out.withColumnRenamed("id", id_col)


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 20], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS s FROM d)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM w) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, s + j AS i FROM later, range(20) t(j)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text, count(*) AS n
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
