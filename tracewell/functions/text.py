"""Text expressions: tokens, feature sets, phrase tests, truncation. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that open a new topic wherever they occur.
FORCED_PHRASES = (
    "换话题", "聊点别的", "另一个", "说回", "下一个问题", "还有一个问题", "再问一个", "别提", "不管", "换个话题", "不说这个", "回到正题", "说重点",
    "topic switch", "switching gears", "shift topics", "moving on", "change of subject",
)
#: Character classes of features.
CJK = "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{ff00}-\\x{ffef}]"
CJK_RUN = "[\\x{4e00}-\\x{9fff}]+"
WORD = "[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+"
#: White space that isn't ASCII.
WIDE_SPACE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_NO_STRINGS = "cast(array() as array<string>)"


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.expr(_NO_STRINGS))


def tokens(text: Column) -> Column:
    """Search tokens of a text, in order: runs of ASCII letters, digits and underscores in lower
    case, and every other visible character by itself."""
    return _all(F.lower(text), "[a-z0-9_]+|(?!" + WIDE_SPACE + ")[^\\x00-\\x7f]")


def pairs(characters: Column) -> Column:
    """Adjacent pairs of an array's elements, joined."""
    n = F.size(characters)
    made = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at(characters, i), F.element_at(characters, i + 1)))
    return F.when(n > 1, made).otherwise(F.expr(_NO_STRINGS))


def cjk_characters(text: Column) -> Column:
    return _all(text, CJK)


def topic_features(text: Column) -> Column:
    """The distinct features of a text that segmentation compares: CJK characters, pairs of CJK
    characters that follow each other when all else is left out, words and numbers."""
    cjk = cjk_characters(text)
    return F.array_distinct(F.concat(cjk, pairs(cjk), _all(F.lower(text), WORD)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def character_pairs(text: Column) -> Column:
    """Distinct adjacent character pairs of a lower-case text without spaces and hyphens."""
    return F.array_distinct(pairs(F.filter(F.split(F.regexp_replace(F.lower(text), "[ \\-]", ""), ""), lambda c: c != "")))


def mixed_pairs(text: Column) -> Column:
    """Pairs inside runs of CJK characters, and ASCII words of two letters or more in lower case;
    repeats are kept."""
    runs = F.transform(_all(text, CJK_RUN), lambda r: pairs(F.filter(F.split(r, ""), lambda c: c != "")))
    return F.concat(F.flatten(runs), F.transform(_all(text, "[A-Za-z]{2,}"), lambda w: F.lower(w)))


def is_forced(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for phrase in FORCED_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return out


def is_confirmatory(text: Column, chars: int = 5) -> Column:
    return F.length(F.trim(text)) <= chars


#: What marks a correction in a text.
CORRECTIONS = "(?i)(修正|纠正|更正|推翻|误解|误判|不对|错误诊断|失败原因|根因|修复|fixed|incorrect|wrong|root cause|fix)"


def has_correction(text: Column) -> Column:
    return F.coalesce(text.rlike(CORRECTIONS), F.lit(False))


#: Patterns of lexical anchors and words that are none.
ANCHOR_DATE = "(?U)\\b\\d{4}-\\d{2}-\\d{2}\\b"
ANCHOR_NUMBER = "(?iU)\\b\\d+(?:\\.\\d+)?\\s*(?:GB|MB|KB|TB|ms|秒|分钟|小时|天|次|条|个|人|万|亿)\\b"
ANCHOR_PATH = (
    "(?iU)[A-Za-z]:\\\\[^\\s\"']+|[\\w./\\\\-]+\\.(?:py|ts|js|jsx|md|yaml|yml|json|sh|ps1|cmd|bat|toml|ini|cfg|rs|go|safetensors|gguf)"
    "|https?://\\S+|hf-mirror\\.com|huggingface\\.co"
)
ANCHOR_NAME = "(?U)\\b[A-Za-z][A-Za-z0-9_]{3,}\\b"
ANCHOR_STOP = (
    "the", "and", "for", "with", "from", "that", "this", "have", "been", "were", "will", "would", "should", "into", "upon", "after", "before",
    "配置", "进行", "完成", "确认", "实现", "优化", "问题", "方案",
)


def anchors(text: Column) -> Column:
    """Distinct lexical anchors of a text: dates, numbers with units, paths and addresses, and ASCII
    names of four characters or more; lower case. An empty array for null."""
    names = F.filter(_all(text, ANCHOR_NAME), lambda w: ~F.lower(w).isin(*ANCHOR_STOP))
    found = F.concat(_all(text, ANCHOR_DATE), _all(text, ANCHOR_NUMBER), _all(text, ANCHOR_PATH), names)
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def safe_truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters: up to the last sentence end, else the last clause end, else cut hard
    and without trailing marks."""
    cut = F.left(text, F.lit(n))
    sentence = F.trim(F.regexp_extract(cut, "(?s)^(.*[。！？.!?])", 1))
    clause = F.trim(F.regexp_extract(cut, "(?s)^(.*[，；;,:：])", 1))
    hard = F.regexp_replace(F.trim(cut), "[,，;；:：.\\s]+$", "")
    return F.when(text.isNull() | (F.length(text) <= n), text).when(sentence != "", sentence).when(clause != "", clause).otherwise(hard)


#: Where a headline may be cut, in order of preference.
HEADLINE_CUTS = ("。", "；", ". ", "; ", "，", "、", ", ")


def headline(text: Column, n: int = 30) -> Column:
    """At most ``n`` characters, cut at the first place of the most preferred separator that lies
    within them."""
    t = F.trim(F.coalesce(text, F.lit("")))
    out = F.left(t, F.lit(n))
    for mark in reversed(HEADLINE_CUTS):
        at = F.instr(t, mark) - 1
        out = F.when((at > 0) & (at <= n), F.rtrim(F.substring(t, F.lit(1), at))).otherwise(out)
    return F.when(F.length(t) <= n, t).otherwise(out)


def head_tail(text: Column, n: int = 120, head: float = 0.6) -> Column:
    """The beginning and the end of a text of more than ``n`` characters."""
    first = int(n * head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(first)), F.lit("…"), F.right(text, F.lit(n - first - 1))))


def identifier_keywords(text: Column) -> Column:
    """Distinct keywords for linking: capitalised words, identifiers of three characters or more, and
    CJK pairs that don't overlap; lower case."""
    names = F.transform(_all(text, "[A-Z][a-z]{2,}"), lambda w: F.lower(w))
    return F.array_distinct(F.concat(names, _all(F.lower(text), "[a-z_][a-z0-9_]{2,}"), _all(text, "[\\x{4e00}-\\x{9fff}]{2}")))


def greedy_distinct(items: Column, similarity: float = 0.95) -> Column:
    """The items of an array that aren't near-equal to an earlier kept one, by the Jaccard similarity
    of their character sets. Blank items are left out."""
    letters = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.aggregate(
        F.filter(items, lambda s: s.isNotNull() & (F.trim(s) != "")), F.expr(_NO_STRINGS),
        lambda kept, s: F.when(F.exists(kept, lambda k: jaccard(letters(k), letters(s)) >= similarity), kept).otherwise(F.concat(kept, F.array(s))),
    )


def greedy_batches(sizes: Column, budget: int) -> Column:
    """The batch number (from 0) of each item when a batch is closed before it would pass ``budget``."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(a: Column, n: Column) -> Column:
        closes = (a["used"] > 0) & (a["used"] + n > budget)
        batch = a["batch"] + F.when(closes, 1).otherwise(0)
        used = F.when(closes, n.cast("bigint")).otherwise(a["used"] + n)
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(a["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def embedding_text(parts: list[Column], n: int = 500) -> Column:
    """What an embedding is made of: the non-empty parts, parted by spaces, cut to ``n`` characters."""
    return F.left(F.concat_ws(" ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts]), F.lit(n))


def token_estimate(*chars: Column) -> Column:
    """A quarter of all characters, rounded down."""
    total = F.lit(0)
    for c in chars:
        total = total + F.coalesce(F.length(c), F.lit(0))
    return F.floor(total / 4).cast("long")
