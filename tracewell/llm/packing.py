"""Packing tokenised documents into training sequences with bounded-space best fit."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import keeps_cache, materialise, tokenizer_path, uses_cache

#: Tokens of a sequence, the id that ends a document, and open windows per partition.
LENGTH, END_ID, OPEN_WINDOWS = 2048, 1, 16
#: Partitions whose leftover windows one task merges: 32 x 16 windows of less than 8 kB of ids.
MERGE_PARTITIONS = 32
#: Bytes of words and ids that a worker keeps, and what an entry takes besides.
CACHE_BYTES, ENTRY_BYTES = 80 << 20, 170
#: Finished sequences that are held before their rows are handed on.
HELD_SEQUENCES = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_RAW = PIECES + ", part int, window int, ids binary"


#: Words that the vocabulary's rule parts into letters and marks: Latin letters (composed, with a
#: lower case that doesn't depend on context), then ASCII marks but the apostrophe.
_END = array("I", [END_ID]).tobytes()
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible
    in Latin-1, else one of those from U+0100, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts, from a word cache in front of a tokenizer that drops white space.

    The vocabulary's rule never joins characters across ASCII white space, so a text's ids are
    the ids of its words, one after another. Each distinct word is encoded once; plain words go
    straight to the merges, all others through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.held = 0

    def _part(self, part: str) -> bytes:
        raw = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        return array("I", [t.id for t in self.merge(raw)]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        index, plain = self.index, _PLAIN.fullmatch
        for word in words:
            text = word.decode("utf-8", "replace")
            if (parts := plain(text)) is None:
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                lower, marks = parts[1].lower(), parts[2]
                if lower == text:
                    ids = self._part(lower)
                else:
                    ids = index.get(stem := lower.encode())
                    if ids is None:
                        index[stem] = ids = self._part(lower)
                        self.held += ENTRY_BYTES + len(stem) + len(ids)
                    if marks:
                        if marks not in self.marks:
                            self.marks[marks] = self._part(marks)
                            self.held += ENTRY_BYTES + 5 * len(marks)
                        ids = ids + self.marks[marks]
            index[word] = ids
            self.held += ENTRY_BYTES + len(word) + len(ids)

    def encode(self, text: str | bytes | None) -> np.ndarray:
        """The ids of ``text`` and the id that ends a document."""
        words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").split()
        if self.held > self.limit:
            self._clear()
        found = list(map(self.index.get, words))
        if None in found:
            self._learn(list(dict.fromkeys([w for w, ids in zip(words, found, strict=True) if ids is None])))
            found = list(map(self.index.__getitem__, words))
        found.append(_END)
        return np.frombuffer(b"".join(found), np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


class Packer:
    """Open windows of one partition; full sequences go to ``done``.

    A piece is ``(doc_id, start, length, crc, doc_tokens, ids)``. Only pieces of open windows keep
    their ids, as copies, so that no document outlives its placing. Whole stretches of ``length``
    ids become sequences of their own. The rest of a document goes to the open window that it
    fills best. If none has room, a new window is opened; if all are open, the fullest takes as
    much as it has room for and is emitted, full.
    """

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> None:
        self.length, self.most = length, open_windows
        self.windows: list[list] = []  # [used, pieces]
        self.done: list[list[tuple]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.length:
            self.done.append([(doc_id, at, self.length, crc(ids[at : at + self.length]), n, None)])
            at += self.length
        while at < n:
            rest, fit = n - at, None
            for w in self.windows:
                if w[0] + rest <= self.length and (fit is None or w[0] > fit[0]):
                    fit = w
            if fit is None and len(self.windows) < self.most:
                self.windows.append(fit := [0, []])
            if fit is None:
                fit = max(self.windows, key=lambda w: w[0])
            take = min(rest, self.length - fit[0])
            own = ids[at : at + take].copy()
            fit[1].append((doc_id, at, take, crc(own), n, own))
            fit[0] += take
            at += take
            if fit[0] == self.length:
                self.windows = [w for w in self.windows if w is not fit]
                self.done.append([(*p[:5], None) for p in fit[1]])


def _rows(sequences: list[list[tuple]], first_id: int, part: int) -> dict[str, list]:
    """Columns of pieces; those of open windows keep their ids and the number of their window."""
    out: dict[str, list] = {x.split()[0]: [] for x in _RAW.split(", ")}
    for k, pieces in enumerate(sequences):
        offset = 0
        for doc_id, start, length, check, n, ids in pieces:
            row = (doc_id, start, length, check, n, first_id + k, offset, part, None if ids is None else k, None if ids is None else ids.astype("<u4").tobytes())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
            offset += length
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("window", pa.int32()), ("ids", pa.binary())])
_ENCODERS: dict[str, WordEncoder] = {}
keeps_cache("words", lambda: [e._clear() for e in _ENCODERS.values()])


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pack_partition(vocabulary: str, length: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uses_cache("words")
        part, made = TaskContext.get().partitionId(), 0
        packer, enc = Packer(length, open_windows), encoder(tokenizer_path(vocabulary))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                packer.add(doc_id, enc.encode(text.as_py()))
                if len(packer.done) >= HELD_SEQUENCES:
                    yield pa.RecordBatch.from_pydict(_rows(packer.done, (part << 32) + made, part), _ARROW)
                    made += len(packer.done)
                    packer.done = []
        yield pa.RecordBatch.from_pydict(_rows(packer.done, (part << 32) + made, part), _ARROW)
        yield pa.RecordBatch.from_pydict(_rows([w[1] for w in packer.windows], -1, part), _ARROW)

    return run


def merge_leftovers(pieces: list[tuple], length: int) -> list[list[tuple]]:
    """Sequences of leftover pieces: full ones, and what remains at the end cut into powers of two.

    A sequence whose length is a power of two takes no padding, so nothing here is padded.
    """
    total = sum(p[2] for p in pieces)
    sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if (total % length) >> b & 1]
    out: list[list[tuple]] = []
    left = 0
    for doc_id, start, size, _, n, ids in pieces:
        at = 0
        while at < size:
            if not left:
                left = sizes[len(out)]
                out.append([])
            take = min(left, size - at)
            out[-1].append((doc_id, start + at, take, crc(ids[at : at + take]), n, None))
            at += take
            left -= take
    return out


def _merge_group(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["window"], r["offset"]))
        pieces = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in rows]
        group = rows[0]["part"] // MERGE_PARTITIONS
        return pa.Table.from_pydict(_rows(merge_leftovers(pieces, length), (1 << 62) + (group << 32), group), _ARROW).drop_columns(["part", "window", "ids"])

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json",
    length: int = LENGTH, open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Every token of every document in exactly one piece of one sequence.

    Each partition packs its own documents with a fixed number of open windows; the windows left
    at the end (with their ids, less than ``open_windows * length`` a partition) are merged for
    ``MERGE_PARTITIONS`` partitions at a time. Only leftovers are shuffled. The last sequences of a
    merge are cut to powers of two, which take no padding; all others are full.

    Result: one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``. Null or empty text is one piece that holds only the end id. Null ids are kept. Rows
    that repeat are packed each for itself. An empty table gives no pieces. The result depends on
    how rows lie in partitions, but not on which task attempt ran.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    raw = materialise(rows.mapInArrow(_pack_partition(vocabulary, length, open_windows), _RAW), "packed")
    whole = raw.where("window is null").select(*[x.split()[0] for x in PIECES.split(", ")])
    left = raw.where("window is not null").groupBy(F.floor(F.col("part") / MERGE_PARTITIONS).alias("g"))
    return whole.unionByName(left.applyInArrow(_merge_group(length), PIECES))
