"""Main text of web pages by the maximum-scoring contiguous region of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialise

#: Pages that weights are learnt from at most, drawn by hash of their address.
TRAIN_PAGES = 2_000
#: A tag seen less often gets the score of its kind: that of a block or of an inline element.
LEAST_SEEN, BLOCK_SCORE, INLINE_SCORE = 20, -0.3, -0.05
#: What a word scores before its features are added, and the bounds of a feature's weight.
WORD_SCORE, LOWEST, HIGHEST = 1.0, -4.0, 1.0
#: The least score of a tag: a list of single words, two tags to a word, still gains.
LOWEST_TAG = -0.4
#: Words that a feature is taken to have been seen with already, inside and outside of content: so
#: marks of boilerplate count against a word until pages say otherwise, a name that only holds the
#: word of a mark counts less, and plain tags and the article element count for nothing.
SEEN_MARK, SEEN_LIKE, SEEN_LINKS, SEEN_TAG, SEEN_PLACE = (1, 10), (1, 4), (5, 20), (200, 200), (1, 1)
#: The least score of a piece of text, whatever its length: a long advert mustn't tear an article apart.
LOWEST_TEXT = -1.0
#: A mark whose element holds this many times the words that no mark covers is a page's wrapper.
WRAPPER = 10

#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page; the first group holds raw text.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
UNSEEN = RAW | frozenset("head template svg canvas object audio video select datalist button".split())
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Marks of boilerplate: elements, then names in class, id or role. ``wrapping`` ones may also lie around a whole page.
ELEMENT_MARKS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "dialog"}
NAME_MARKS = {
    "comments": r"comment\w*|disqus|replies|respond",
    "advert": r"ads?|advert\w*|adbox|adsense|banners?|sponsor\w*|promo\w*",
    "site": r"nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|sidebox|footer|masthead|site-header|page-header|pagination|pager|toolbar|skip-link|complementary|contentinfo",
    "notice": r"cookies?\w*|consent|gdpr|notices?|alert|newsletter|subscribe|signup|sign-up|login|social|share\w*|sharing|related|recommend\w*|popular|trending|widgets?|popup|modal|overlay|search\w*|copyright|legal",
}
#: Words that come beside those in names of boilerplate; a name with any other word ("legal-history")
#: is only like a mark.
BESIDE_NAMES = (
    r"area|article|articles|bar|block|body|bottom|box|btn|button|buttons|center|col|column|container|content|count|footer|form|global|group|head|header|"
    r"heading|icon|icons|inner|item|items|label|left|line|link|links|list|main|message|more|news|outer|page|pages|panel|policy|post|posts|primary|read|reader|readers|"
    r"recent|right|row|secondary|section|side|sign|site|skip|slot|space|stories|story|tags|text|thread|title|tools|top|topics|unit|up|user|users|wrap|wrapper|\w"
)
_HOLDS = {mark: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I) for mark, words in NAME_MARKS.items()}
_PART = re.compile(rf"(?:{'|'.join([*NAME_MARKS.values(), BESIDE_NAMES])})", re.I)
_BETWEEN = re.compile(r"[_-]+")
_POST = re.compile(r"(?:^|[\s_-])(?:post|entry|hentry|story|article)(?:$|\s)", re.I)
MARKS = ("nav", "header", "footer", "aside", "form", "dialog", "hidden", *NAME_MARKS, *(f"like {name}" for name in NAME_MARKS))
WRAPPING = frozenset(["form", "header", "aside", "dialog", "hidden", "advert", "site", "notice", *(f"like {name}" for name in NAME_MARKS)])
#: Where a word lies on a page with an article.
PLACES = ("in article", "beside article")
_BIT = {name: 1 << i for i, name in enumerate(MARKS)}
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""=\s*(["'])|>""")
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
#: An open element of these is closed by another of the same kind or of the listed kinds.
_CLOSES = {"p": BLOCKS - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def _is_mark(name: str) -> bool:
    """Whether all parts of a name are words of marks, words that come beside them, or hold digits."""
    return all(_PART.fullmatch(part) or re.search(r"\d", part) for part in _BETWEEN.split(name) if part)


def _mark(tag: str, attributes: str) -> int:
    """The marks (bits) that an element's own tag and attributes set."""
    out = _BIT[ELEMENT_MARKS[tag]] if tag in ELEMENT_MARKS else 0
    if not attributes or tag in ("body", "html", "article", "main"):
        return out
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for word in value.split():
                for mark, pattern in _HOLDS.items():
                    if pattern.search(word):
                        out |= _BIT[mark if _is_mark(word) else f"like {mark}"]
        elif name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out |= _BIT["hidden"]
    return out


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """A page as ``(kind, name, rest)`` in order: ``text`` with its characters, or ``open`` and
    ``close`` with a tag's name and attributes. Comments, declarations and raw elements' content
    don't come out. A quoted value without an end, or a tag without one, ends at the next ``>`` or
    is text if there is none. Every search starts where the last one ended, or is made once and
    remembered, so the time grows with the page's length alone.
    """
    at, n, last = 0, len(page), page.rfind(">")
    endless: set[str] = set()
    text_from = 0
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) if "-->" not in endless else -1
            if end < 0:
                endless.add("-->")
            kind, end = "", n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt) if "]]>" not in endless else -1
            if end < 0:
                endless.add("]]>")
            kind, end = "", n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            kind, end = "", page.find(">", lt) + 1 or n
        elif (m := _NAME.match(page, lt + 1)) and lt < last:
            kind, tag, end = "close" if m[1] else "open", m[2].lower(), _tag_end(page, m.end(), endless)
            rest = page[m.end() : end - 1]
        else:
            at = lt + 1
            continue
        if lt > text_from:
            yield "text", "", page[text_from:lt]
        at = text_from = end
        if not kind:
            continue
        yield kind, tag, rest
        if kind == "open" and tag in RAW and tag not in endless:
            found = _RAW_END[tag].search(page, at)
            if not found:
                endless.add(tag)
            at = text_from = found.start() if found else n
    if text_from < n:
        yield "text", "", page[text_from:]


def _tag_end(page: str, at: int, endless: set[str]) -> int:
    """The place after the ``>`` that ends a tag whose name ends at ``at``; there is one after it."""
    first = at
    while m := _STOP.search(page, at):
        if not m[1]:
            return m.end()
        end = page.find(m[1], m.end()) if m[1] not in endless else -1
        if end < 0:
            endless.add(m[1])
            break
        at = end + 1
    return page.find(">", first) + 1


@dataclass
class Page:
    """A parsed page. ``items`` are ``(kind, name, element, text)`` in order; each element has its
    parent, nearest block, own marks, and whether it lies in an article, in a post and in a link."""

    items: list[tuple[str, str, int, str]] = field(default_factory=list)
    tag: list[str] = field(default_factory=lambda: ["body"])
    parent: list[int] = field(default_factory=lambda: [-1])
    block: list[int] = field(default_factory=lambda: [0])
    own: list[int] = field(default_factory=lambda: [0])
    article: list[bool] = field(default_factory=lambda: [False])
    post: list[bool] = field(default_factory=lambda: [False])
    link: list[bool] = field(default_factory=lambda: [False])
    unseen: list[bool] = field(default_factory=lambda: [False])


def parse(page: str) -> Page:
    """Elements and text of a page, with the ends that broken markup leaves out put in.

    Blocks and the inline elements in each are kept apart, with counts of what is open, so an end
    tag costs no search through what it doesn't close.
    """
    out = Page()
    blocks: list[tuple[int, list[int], Counter]] = [(0, [], Counter())]
    open_blocks: Counter = Counter()

    def top() -> int:
        element, inline, _ = blocks[-1]
        return inline[-1] if inline else element

    def close_block() -> None:
        element, _, _ = blocks.pop()
        open_blocks[out.tag[element]] -= 1
        out.items.append(("close", out.tag[element], element, ""))

    for kind, tag, rest in markup(page):
        if kind == "text":
            if not out.unseen[top()]:
                out.items.append(("text", "", top(), rest))
        elif kind == "close":
            _, inline, names = blocks[-1]
            if tag in BLOCKS:
                if open_blocks[tag]:
                    while out.tag[blocks[-1][0]] != tag:
                        close_block()
                    close_block()
            elif names[tag]:
                while inline:
                    last = inline.pop()
                    names[out.tag[last]] -= 1
                    out.items.append(("close", out.tag[last], last, ""))
                    if out.tag[last] == tag:
                        break
        else:
            if tag in BLOCKS:
                while len(blocks) > 1 and tag in _CLOSES.get(out.tag[blocks[-1][0]], ()):
                    close_block()
            up = top()
            if tag in VOID or tag in RAW or rest.endswith("/") and tag not in BLOCKS:
                out.items.append(("open", tag, up, ""))
                continue
            me = len(out.tag)
            mark = _mark(tag, rest)
            if tag == "header" and (out.article[up] or out.post[up]):
                mark &= ~_BIT["header"]  # a page's header is no content; an article's holds its title
            out.tag.append(tag)
            out.parent.append(up)
            out.block.append(me if tag in BLOCKS else out.block[up])
            out.own.append(mark)
            out.article.append(out.article[up] or tag in ("article", "main"))
            out.post.append(out.post[up] or tag in ("div", "section") and any(n.lower() == "class" and _POST.search(v.strip("\"'")) for n, v in _NAMED.findall(rest)))
            out.link.append(out.link[up] or tag == "a")
            out.unseen.append(out.unseen[up] or tag in UNSEEN)
            if tag in BLOCKS:
                blocks.append((me, [], Counter()))
                open_blocks[tag] += 1
            else:
                blocks[-1][1].append(me)
                blocks[-1][2][tag] += 1
            out.items.append(("open", tag, me, ""))
    return out


def features(page: Page) -> list[tuple[int, tuple[str, ...]]]:
    """Words and features of each item: none for tags; for text its marks, or else its block's tag
    and whether the block is mostly links.

    A mark that lies around nearly all of the page (a page in one form, say) tells nothing and is
    dropped: one whose element holds ``WRAPPER`` times the words that have no mark at all.
    """
    words = [len(text.split()) if kind == "text" else 0 for kind, _, _, text in page.items]
    own = list(page.own)
    n = len(own)
    while True:
        mask, root, depth = [0] * n, [-1] * n, [0] * n
        for e in range(1, n):
            up = page.parent[e]
            mask[e], root[e], depth[e] = mask[up] | own[e], root[up], depth[up]
            if own[e]:
                root[e], depth[e] = e if root[up] < 0 else root[up], depth[up] + 1
        plain, inside = 0, Counter()
        for (_, _, e, _), count in zip(page.items, words, strict=True):
            if not mask[e]:
                plain += count
            elif depth[e] == 1:
                inside[root[e]] += count
        around = [e for e, count in inside.items() if count > WRAPPER * plain and all(m in WRAPPING for m in MARKS if own[e] & _BIT[m])]
        if not around:
            break
        own[max(around, key=lambda e: (inside[e], -e))] = 0
    total, linked = Counter(), Counter()
    for (_, _, e, _), count in zip(page.items, words, strict=True):
        total[page.block[e]] += count
        linked[page.block[e]] += count * page.link[e]
    known: dict[tuple[int, int, bool], tuple[str, ...]] = {}
    out = []
    for (_, _, e, _), count in zip(page.items, words, strict=True):
        if not count:
            out.append((0, ()))
            continue
        b = page.block[e]
        mostly = 2 * linked[b] > total[b]
        key = (mask[e], b, mostly)
        if key not in known:
            marks = tuple(m for m in MARKS if mask[e] & _BIT[m])
            known[key] = marks or ("in " + page.tag[b], *["links"] * mostly)
        out.append((count, known[key]))
    return out


def tally(text: str) -> dict[str, tuple[int, int]]:
    """How often each feature of words and each tag comes inside and outside the content of a page
    that marks its article: all words in the article, marked ones too, and the tags between the
    first and the last of them. So a mark that articles hold loses its weight."""
    page = parse(text)
    found = features(page)
    content = [bool(count) and page.article[item[2]] for item, (count, _) in zip(page.items, found, strict=True)]
    places = [i for i, c in enumerate(content) if c]
    inside, outside = Counter(), Counter()
    if places:
        for i, ((kind, name, _, _), (count, fs)) in enumerate(zip(page.items, found, strict=True)):
            if kind == "text":
                for f in fs:
                    (inside if content[i] else outside)[f] += count
                (inside if content[i] else outside)["in article" if content[i] else "beside article"] += count
            elif places[0] <= i <= places[-1]:
                inside[f"{kind} {name}"] += 1
            else:
                outside[f"{kind} {name}"] += 1
    return {key: (inside[key], outside[key]) for key in {*inside, *outside}}


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from the counts of many pages: smoothed log ratios of how often a feature comes with
    words of content and with others, tags always negative."""
    ratio = lambda key, seen, total: math.log((counts.get(key, (0, 0))[0] + seen[0]) / (total[0] + 1)) - math.log((counts.get(key, (0, 0))[1] + seen[1]) / (total[1] + 1))
    bounded = lambda w: min(HIGHEST, max(LOWEST, w))
    even = (0, 0)
    out = {mark: bounded(ratio(mark, SEEN_LIKE if mark.startswith("like ") else SEEN_MARK, even)) for mark in MARKS}
    out |= {place: bounded(ratio(place, SEEN_PLACE, even)) for place in PLACES}
    out["links"] = bounded(ratio("links", SEEN_LINKS, even))
    for key in counts:
        if key.startswith("in ") and key not in PLACES:
            out[key] = bounded(ratio(key, SEEN_TAG, even))
    tags = {k: v for k, v in counts.items() if k.startswith(("open ", "close "))}
    total = (sum(v[0] for v in tags.values()), sum(v[1] for v in tags.values()))
    for key, (a, b) in tags.items():
        if a + b >= LEAST_SEEN:
            out[key] = min(-0.02, max(LOWEST_TAG, (ratio(key, (1, 1), total) - 1.0) / 8))
    return out


def learn(pages: list[str]) -> dict[str, float]:
    """Weights from pages that mark their article (others teach nothing)."""
    counts: dict[str, tuple[int, int]] = {}
    for page in pages:
        for key, (a, b) in tally(page).items():
            x, y = counts.get(key, (0, 0))
            counts[key] = (x + a, y + b)
    return weigh(counts)


def item_scores(page: Page, weights: dict[str, float]) -> list[float]:
    """The score of each item: tags negative, words by the weights of their features.

    Where a page has articles, the weight of lying in one or beside it counts by the share that
    articles hold of what words score without it: a teaser says little about the words around it.
    """
    per_word, held, whole = [], 0.0, 0.0
    for (_, _, e, _), (count, fs) in zip(page.items, features(page), strict=True):
        s = WORD_SCORE + sum(weights.get(f, 0.0) for f in fs)
        gain = count * max(0.0, s)
        per_word.append((count, s))
        whole += gain
        held += gain * page.article[e]
    share = held / whole if whole else 0.0
    place = [weights.get(name, 0.0) * share if share else 0.0 for name in PLACES]
    scores = []
    for (kind, name, e, _), (count, s) in zip(page.items, per_word, strict=True):
        if kind == "text":
            scores.append(max(LOWEST_TEXT, count * (s + place[not page.article[e]])))
        else:
            scores.append(weights.get(f"{kind} {name}", BLOCK_SCORE if name in BLOCKS else INLINE_SCORE))
    return scores


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the greatest sum, by one scan: the first such, as ``(from, to)``."""
    best, best_from, best_to, run, run_from = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        run += s
        if run <= 0:
            run, run_from = 0.0, k + 1
        if run > best:
            best, best_from, best_to = run, run_from, k + 1
    return best_from, best_to


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, joined by two line ends; words in it that score nothing or
    less (an advert within an article, say) are left out."""
    parsed = parse(page or "")
    scores = item_scores(parsed, weights)
    first, last = best_region(scores)
    blocks, current = [], []

    def end() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(current))).strip()
        if text:
            blocks.append(text)
        current.clear()

    for (kind, name, _, text), score in zip(parsed.items[first:last], scores[first:last], strict=True):
        if kind == "text":
            if score > 0 or text.isspace():
                current.append(text)
        elif name == "br":
            current.append(" ")
        elif name in BLOCKS:
            end()
    end()
    return "\n\n".join(blocks)


OUT = "page_id long, url string, text string, n_chars long"


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[int, int]] = {}
    for batch in batches:
        for text in batch.column(0):
            for key, (a, b) in tally(text.as_py()).items():
                x, y = total.get(key, (0, 0))
                total[key] = (x + a, y + b)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=["key", "inside", "outside"])


def _extract(weights):
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=shape)

    return run


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    Weights are learnt from a bounded sample of pages that mark their article (the first
    ``train_pages`` by the MD5 of their ids): each task adds up counts, and only the counts of
    features and tags that were seen ``LEAST_SEEN`` times reach the driver. Extraction itself is a
    scan of the table without a shuffle.

    Null html is empty and gives an empty text, as a page without any content does. Broken markup
    is read as far as it goes. Null ids and addresses stay null; rows that repeat give a row each;
    an empty table gives no rows. Without any page that marks its article, marks and tags have the
    weights that they start with.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    drawn = rows.where(F.lower("html").rlike(r"<(article|main)[\s>]")).select("page_id").distinct()
    drawn = materialise(drawn.orderBy(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), "page_id").limit(train_pages), "html-sample")
    sample = rows.join(F.broadcast(drawn), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    counts = sample.select("html").mapInArrow(_tallies, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    weights = weigh({r["key"]: (r["a"], r["b"]) for r in counts.where(F.col("a") + F.col("b") >= LEAST_SEEN).collect()})
    return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(weights)), OUT)
