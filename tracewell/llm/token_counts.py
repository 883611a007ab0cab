"""Token counts by a unigram model, scored once per shared prefix of a trie of words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import keeps_cache, tokenizer_path, uses_cache

#: Nodes and words that a worker's trie may hold before it starts afresh.
TRIE_NODES, TRIE_WORDS = 1_000_000, 400_000
#: Longer words are scored on their own and not kept.
LONG_WORD = 256
_START = "▁"
OUT = "doc_id long, n_words long, n_tokens long"


def piece_scores(vocabulary: str) -> tuple[dict[str, float], float]:
    """Log probabilities of a public vocabulary's pieces, and of a byte that stands for itself.

    The file ranks its pieces; a piece's probability is taken as inverse to its rank (Zipf's law).
    A byte is less likely than any piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary))
    ranks = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    ranks = {p: min(r, len(ranks)) for p, r in ranks.items()}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - total for p, r in ranks.items()}, -math.log(len(ranks) + 1) - total - 10.0


class Trie:
    """Distinct words, with the best score and its token count for every prefix.

    The best segmentation of a prefix doesn't depend on what follows, so words share it: only the
    nodes that a word adds are scored. ``counts`` holds the token count of every word inserted.
    """

    def __init__(self, scores: dict[str, float], byte_score: float) -> None:
        self.scores, self.byte_score = scores, byte_score
        # Every ending of a piece: its score if it is a piece itself, else a number above any log
        # probability. A search for the pieces that end at a place stops at the first that isn't here.
        self.endings = {p[j:]: 1.0 for p in scores for j in range(len(p))} | scores
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # by character and node; the low bits differ, so that few keys collide
        self.best, self.tokens = [0.0], [0]
        self.counts: dict[str, int] = {}

    def step(self, word: str, d: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best (score, tokens) of ``word[:d]`` from those of all shorter prefixes; fewer tokens win ties."""
        top, count = -math.inf, 0
        get, j = self.endings.get, d - 1
        while j >= 0 and (s := get(word[j:d])) is not None:
            if s <= 0.0:
                s += best[j]
                if s > top or (s == top and tokens[j] + 1 < count):
                    top, count = s, tokens[j] + 1
            j -= 1
        if word[d - 1] not in self.scores:  # no piece for the character: its bytes
            n = len(word[d - 1].encode("utf-8", "surrogatepass"))
            s = best[d - 1] + n * self.byte_score
            if s > top or (s == top and tokens[d - 1] + n < count):
                top, count = s, tokens[d - 1] + n
        return top, count

    def alone(self, word: str) -> int:
        """The token count of a word that isn't kept."""
        word, best, tokens = _START + word, [0.0], [0]
        for d in range(1, len(word) + 1):
            s, n = self.step(word, d, best, tokens)
            best.append(s)
            tokens.append(n)
        return tokens[-1]

    def insert(self, word: str) -> None:
        marked, children = _START + word, self.children
        path = [0]
        for ch in marked:
            child = children.get(ord(ch) << 40 | path[-1])
            if child is None:
                break
            path.append(child)
        node, known = path[-1], len(path)
        if known <= len(marked):
            best, tokens = [self.best[x] for x in path], [self.tokens[x] for x in path]
            for d in range(known, len(marked) + 1):
                s, n = self.step(marked, d, best, tokens)
                best.append(s)
                tokens.append(n)
                children[ord(marked[d - 1]) << 40 | node] = child = len(self.best) + d - known
                node = child
            self.best += best[known:]
            self.tokens += tokens[known:]
        self.counts[word] = self.tokens[node]

    def count(self, words: list[str]) -> int:
        if len(self.counts) > TRIE_WORDS or len(self.best) > TRIE_NODES:
            self.clear()
        found = list(map(self.counts.get, words))
        if None in found:
            for w in dict.fromkeys([w for w, n in zip(words, found, strict=True) if n is None]):
                if len(w) <= LONG_WORD:
                    self.insert(w)
            found = [self.alone(w) if n is None else n for w, n in zip(words, map(self.counts.get, words), strict=True)]
        return sum(found)


_TRIES: dict[str, Trie] = {}
keeps_cache("tries", lambda: [t.clear() for t in _TRIES.values()])


def trie(vocabulary: str) -> Trie:
    if vocabulary not in _TRIES:
        _TRIES[vocabulary] = Trie(*piece_scores(vocabulary))
    return _TRIES[vocabulary]


def _count(vocabulary: str):
    schema = pa.schema([(x.split()[0], pa.int64()) for x in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses_cache("tries")
        own = trie(vocabulary)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                sizes.append(len(words))
                tokens.append(own.count(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Words and unigram tokens of each text, one row per row of ``docs``: ``doc_id, n_words, n_tokens``.

    Words are parted by white space. A worker keeps one bounded trie for all its rows, so nothing
    is shuffled and a word is scored about once per worker. Null and empty texts have 0 words and 0
    tokens; null ids, repeated rows and any other columns are fine; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(vocabulary), OUT)
