"""Main text of web pages: the best contiguous region by a maximum-scoring subsequence.

A page is a sequence of words and tags. Every one has a weight: the log-odds that it lies inside the content rather than
outside, learned from labelled pages (those with exactly one ``article`` element, whose extent is the label). Words of content score
above zero, words of boilerplate and all tags below. One linear scan finds the region of the greatest
sum. Where most of its words lie in a page's one ``article``, the region is that article's whole extent. Menus, forms,
adverts and the like that lie inside it are dropped by their elements, and what is left is read as blocks of text.

An element is boilerplate by its name, or by a word of its class, id or role; ``html``, ``body`` and ``main`` never are
by class, an ``article`` only by a class of that one word, and neither is an element that holds ``main`` or the page's
one ``article``. Elements without words count nothing. A page is read in one pass with an open-element stack that knows
what lies in force at its top, so time is linear in the page however deep or broken it is.

Features are drawn from the fixed HTML tag names and a few kinds of boilerplate, so the weights stay a small table
however many pages are counted; the counts are summed by Spark over all pages.

Defined cases: null and empty pages give an empty text; a page without any words of positive weight too; pages that stop
in the middle are read as far as they go; unclosed tags end with their parent; a value's quote that never closes runs to
the end of the page; repeated rows give repeated rows.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import texts_of

# HTML element names by what they mean for reading.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math object xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NEVER = {"nav", "aside", "footer", "form", "button", "select", "dialog", "head", "title", "menu", "header", "audio", "video", "canvas", "map", "fieldset"} | RAW
#: Elements that close an open one of the same kind in the same parent.
SELF_CLOSING = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}}
#: Kinds of boilerplate told by class, id or role.
KINDS = {
    "advert": r"ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|outbrain|taboola",
    "comment": r"comments?|commentlist|disqus\w*|replies|respond|discussion",
    "menu": r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|toc|toolbar|tabs",
    "side": r"sidebar\w*|aside|widgets?|related|recommend\w*|popular|trending",
    "notice": r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|paywall|disclaimer",
    "frame": r"header|masthead|footer\w*|copyright|social|share|sharing|search|searchbox|login",
}
_KIND_PATTERNS = {kind: re.compile(rf"(?:^|[_-])(?:{words})(?=$|[_-])", re.I) for kind, words in KINDS.items()}
_WHOLE_PATTERNS = {kind: re.compile(words, re.I) for kind, words in KINDS.items()}
_ANY_KIND = re.compile("|".join(KINDS.values()), re.I)
#: Class words that tell of a layout or a state of the page, and a title block's class words; neither is boilerplate.
_STATE = re.compile(r"(?:no|not|has|have|with|without)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled|allowed)", re.I)
_TITLE_BLOCK = re.compile(r"(?:entry|post|article|story|content|blog|chapter|section)[_-]+header(?:[_-].*)?", re.I)
#: Never boilerplate by class or id; an ``article`` is by a class of one whole word (a reader's comment, say).
_UNBANNED = {"html", "body", "main"}
_ROLES = {"navigation": "menu", "banner": "frame", "contentinfo": "frame", "complementary": "side", "search": "frame", "alert": "notice", "dialog": "notice", "menu": "menu"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s]*+)))?")
_TOLD_BY = {"class", "id", "role", "hidden", "aria-hidden"}
#: Weights before any page is counted, and the counts they stand for.
WORD_PRIOR, BOILERPLATE_PRIOR, TAG_PRIOR, PRIOR_COUNT = 1.0, -1.0, -0.1, 2.0
#: Tags never score above this, wherever they were seen; no weight is farther from zero than the limit.
TAG_MOST, LIMIT = -0.05, 3.0
#: What elements of boilerplate count for: they are dropped in any case, and should hardly part content around them.
DROPPED_SHARE = 0.1


class Event:
    """A tag or a run of text: what it is, what it lies in, and where it stands in the page."""

    __slots__ = ("banned", "block", "feature", "n", "text")

    def __init__(self, feature: str, text: str | None, block: int, banned: bool, n: int):
        self.feature, self.text, self.block, self.banned, self.n = feature, text, block, banned, n


def _kind_of_words(name: str, value: str) -> str:
    """The kind told by the words of a class or id."""
    if name in _UNBANNED or not _ANY_KIND.search(value):
        return ""
    for word in value.split():
        if name == "article":
            kind = next((k for k, p in _WHOLE_PATTERNS.items() if p.fullmatch(word)), "")
        elif _STATE.fullmatch(word) or _TITLE_BLOCK.fullmatch(word):
            kind = ""
        else:
            kind = next((k for k, p in _KIND_PATTERNS.items() if p.search(word)), "")
        if kind:
            return kind
    return ""


def boilerplate_kind(name: str, attributes: str) -> str:
    """The kind of boilerplate an element is by name, class, id or role; ``""`` if none."""
    if name in NEVER:
        return name if name in ("nav", "aside", "footer", "form", "head", "title", "header") else "raw" if name in RAW else "form"
    if not attributes:
        return ""
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key not in _TOLD_BY:
            continue
        value = next((v for v in values if v), "")
        if name not in _UNBANNED and (key == "hidden" or key == "aria-hidden" and value.lower() == "true"):
            return "hidden"
        if key == "role":
            kind = _ROLES.get(value.lower(), "") if name not in _UNBANNED else ""
        else:
            kind = _kind_of_words(name, value) if key in ("class", "id") else ""
        if kind:
            return kind
    return ""


class Open:
    """An open element, and what is in force inside it."""

    __slots__ = ("blocks", "event", "holder", "kind", "links", "name", "own", "words")

    def __init__(self, name: str, own: str, under: Open | None, event: int, words: int):
        self.name, self.own, self.event, self.words = name, own, event, words
        is_block = name in BLOCKS
        self.kind = own or (under.kind if under else "")
        self.holder = name if is_block else under.holder if under else "none"
        self.links = (under.links if under else 0) + (name == "a")
        self.blocks = (under.blocks if under else 0) + is_block


def _parse(page: str, spared: set[int]) -> tuple[list[Event], list[tuple[int, int]], int, set[int]]:
    """Events, spans of the articles, how many articles began, and starts of the elements banned by class round the content.

    ``spared`` are such starts, which are no boilerplate.
    """
    events: list[Event] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = defaultdict(list)
    block, at, articles, opened, words_seen = 0, 0, [], None, 0
    round_main: set[int] = set()
    round_article: set[int] = set()

    def words(raw: str) -> None:
        nonlocal words_seen
        if not raw:
            return
        text = html_lib.unescape(raw)
        top = stack[-1] if stack else None
        kind, holder, link = (top.kind, top.holder, ":a" if top.links else "") if top else ("", "none", "")
        n = len(text.split())
        words_seen += n
        events.append(Event(f"word:{kind or holder}{link}", text, block, bool(kind), n))

    def close(name: str, event: Event | None = None) -> None:
        nonlocal block
        if not places[name]:
            return
        while stack:
            last = stack.pop()
            places[last.name].pop()
            block += last.name in BLOCKS
            if last.words == words_seen:
                events[last.event].n = 0
            if last.name == name:
                if event and last.words == words_seen:
                    event.n = 0
                return

    position = 0
    while position < len(page):
        found = _TOKEN.search(page, position)
        if not found:
            words(page[position:])
            break
        words(page[position : found.start()])
        position = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        known = name if name in BLOCKS or name in INLINE or name in VOID or name in RAW else "other"
        if not found[4]:
            break
        if found[1]:
            kind = stack[-1].kind if stack else ""
            events.append(Event(f"tag:/{known}:{kind}", None, block, bool(kind), 1))
            if name == "article" and opened is not None:
                articles.append((opened, len(events) - 1))
                opened = None
            close(name, events[-1])
            block += name in BLOCKS
            continue
        for n, enders in SELF_CLOSING.items():
            # An open element of this kind ends here unless another block was opened inside it since.
            if name in enders and places[n] and stack[-1].blocks == stack[places[n][-1]].blocks:
                close(n)
        block += name in BLOCKS
        kind = "" if len(events) in spared else boilerplate_kind(name, found[3])
        outer = stack[-1].kind if stack else ""
        if name == "header" and not outer and (places["article"] or places["main"]):
            kind = ""
        if name in ("main", "article") and outer:
            (round_main if name == "main" else round_article).update(
                e.event for e in stack if e.own and e.own != "hidden" and e.name not in NEVER and not (name == "article" and e.own == "comment"))
        events.append(Event(f"tag:{known}:{kind or outer}", " " if name == "br" else None, block, bool(kind or outer), 1))
        if name == "article":
            if opened is None:
                opened = len(events) - 1
            at += 1
        if name in VOID or found[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = _raw_end(name).search(page, position)
            position = end.end() if end else len(page)
            continue
        places[name].append(len(stack))
        stack.append(Open(name, kind, stack[-1] if stack else None, len(events) - 1, words_seen))
    if opened is not None:
        articles.append((opened, len(events)))
    return events, articles, at, round_main | (round_article if at == 1 else set())


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I)


def read_page(page: str) -> tuple[list[Event], tuple[int, int] | None]:
    """The events of a page, and the span of its ``article`` if it has exactly one."""
    events, articles, at, spared = _parse(page, set())
    if spared:
        events, articles, at, _ = _parse(page, spared)
    return events, articles[0] if at == 1 and len(articles) == 1 else None


def counts(page: str) -> Counter:
    """``(feature, inside)`` of a labelled page; nothing for the others. Words in boilerplate count as outside."""
    events, span = read_page(page)
    total: Counter = Counter()
    if span:
        for i, event in enumerate(events):
            if event.n:
                total[event.feature, span[0] < i < span[1] and not event.banned] += event.n
    return total


def learn(pages: DataFrame, text_col: str = "html") -> dict[str, float]:
    """Weight of each feature: smoothed log-odds, drawn to the prior of words or tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column(0).to_pylist():
                total.update(counts(page))
            keys = list(total)
            yield pa.record_batch([pa.array([f for f, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
                                  ["feature", "inside", "n"])

    counted = texts_of(pages, text=text_col).mapInArrow(run, "feature string, inside boolean, n long")
    rows = counted.groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("b")).collect()
    return {r.feature: weight(r.feature, r.a or 0, r.b or 0) for r in rows}


def prior(feature: str) -> float:
    """Words score positive and tags negative; words of a boilerplate element negative."""
    if feature.startswith("tag:"):
        return TAG_PRIOR
    kind = feature.split(":")[1]
    return BOILERPLATE_PRIOR if kind in KINDS or kind in ("nav", "aside", "footer", "form", "head", "title", "header", "raw", "hidden") else WORD_PRIOR


def weight(feature: str, inside: int, outside: int) -> float:
    half = 1 / (1 + math.exp(-prior(feature)))
    odds = math.log((inside + PRIOR_COUNT * half) / (outside + PRIOR_COUNT * (1 - half)))
    odds = max(-LIMIT, min(LIMIT, odds))
    return min(odds, TAG_MOST) if feature.startswith("tag:") else odds


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the greatest sum above zero; ``(0, 0)`` if there is none."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of the best region, a line a block."""
    events, article = read_page(page)
    scores = [e.n * (weights[e.feature] if e.feature in weights else prior(e.feature)) * (DROPPED_SHARE if e.banned else 1) for e in events]
    start, end = best_region(scores)
    if article:
        held = [sum(e.n for e in events[a:b] if e.text and not e.banned) for a, b in ((start, end), (max(start, article[0]), min(end, article[1])))]
        if 2 * held[1] > held[0]:
            start, end = article
    # Text next to the region in the same block belongs to it.
    blocks: dict[int, list[str]] = {}
    inside = {e.block for e in events[start:end] if e.text}
    for i, event in enumerate(events):
        if event.text and not event.banned and (start <= i < end or event.block in inside):
            blocks.setdefault(event.block, []).append(event.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; the weights are learned from the same pages if none are given."""
    weights = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  ["page_id", "url", "text", "n_chars"])

    frame = texts_of(pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id", "url", text="html")
    return frame.mapInArrow(run, "page_id long, url string, text string, n_chars long")
