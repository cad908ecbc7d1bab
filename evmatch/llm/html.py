"""Main text of web pages as the maximum-scoring run of tokens.

A page is read as a sequence of tags and text runs.  Words score positive, tags negative; words in
containers that labelled pages show to hold no content score negative too.  One linear scan finds the
contiguous run of the highest sum.  It holds all of the article but, at times, a few words behind many
tags at an end or, after a long stretch of tags, a part; so its ends move out to those of the innermost
container of its words, and further to those of a container that labelled pages show to hold content
only.  Words that score negative stay out.

Labelled pages are those that mark their article themselves with one ``article`` or ``main`` element:
what is inside is content, the rest is not.  Weights of tags and of container names are log odds counted
over at most ``SAMPLE`` such pages; other pages are scored by the same weights.  Names that by general use
hold no content start with ``PRIOR`` words counted against them outside an article, which labelled pages
outweigh.  Inside an article such a name says nothing by itself: the container must also be mostly links, have
many controls, be repeated on other pages or be known from outside of articles, or its whole name must say so
and it must be small or lie at an end of the article (``evident``).

Reading takes time and memory in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.llm.common import seeded, table

SAMPLE, SEED, LEAST, MOST = 4000, 4, 20, 1.5
#: words that speak against a name before any page is read; how many times the other side counts as proof
PRIOR, PROOF = 200, 9
#: inside an article: words a control, words of a small container and how often it fits into the article, words of a
#: text that is worth knowing again and pages that have it
EACH_CONTROL, SMALL, SHARE, REPEATED, PAGES = 20, 60, 10, 5, 3

#: fixed values: elements whose text is never the page's
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "canvas")
#: fixed values: those that end with the page where their end tag is missing, and cannot close themselves
TO_THE_END = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav",
    "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: fixed values: elements that hold no article text
APART = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog"}
#: fixed values: those of them that an article can have of its own
OWN = {"header", "menu", "dialog"}
#: fixed values: elements to act with
CONTROLS = {"button", "form", "input", "select", "textarea"}
#: fixed values: elements that hold parts of a page rather than a run of its text
PARTS = {"div", "section", "ul", "ol", "table"}
#: fixed values: words of names of what readers wrote
READERS = {"comment", "comments", "disqus", "replies", "respond"}
#: fixed values: words that begin or end a class, id or role of containers that hold no article text
APART_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "masthead", "menu",
    "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "paywall", "popup", "promo",
    "promoted", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sitenav", "skip", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
#: fixed values: words that make a name speak of a state instead of what a container holds
STATES = {"no", "not", "has", "have", "is", "with", "without", "hide", "hidden", "open", "opened", "closed", "free", "on", "off", "enabled", "disabled", "allowed", "less", "non"}
#: fixed values: elements whose class and id speak of the page or the article itself
WHOLE = {"html", "body", "main", "article"}
#: fixed values: an opening element of the key ends an open element of the values
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: a quoted value ends where white space, a slash or the tag's end follows; any other quote is a plain character
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+')(?=[\s/>])"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|</>|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|{_VALUE}|=)*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


@lru_cache(maxsize=100_000)
def against(name: str) -> bool:
    """Whether a class, id or role by general use names a container without article text."""
    parts = PART.findall(name)
    return bool(parts) and (parts[0] in APART_NAMES or parts[-1] in APART_NAMES) and STATES.isdisjoint(parts)


def names(attributes: str) -> tuple[str, ...]:
    """The words of a container's class, id and role, in lower case."""
    if "=" not in attributes:
        return ()
    return tuple({w for a, b, c in NAMED.findall(attributes) for w in (a or b or c).lower().split()})


class Page:
    """Tags and text runs in order, each with its innermost open container.

    ``tokens`` are (tag, text, container): text of a tag is empty, an end tag begins with "/", and the tag
    of a text run is empty.  ``parent``, ``tag`` and ``names`` are those of each container, outer ones
    first; container 0 is the page.
    """

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.parent, self.tag, self.names = [0], [""], [()]
        #: dialogs that are open
        self.shown: set[int] = set()
        at, size, find, put = 0, len(page), TOKEN.search, self.tokens.append
        stack, opened, endless = [0], Counter(), set()
        while at < size:
            m = find(page, at)
            if m is None:
                put(("", page[at:], stack[-1]))
                return
            if m.start() > at:
                put(("", page[at : m.start()], stack[-1]))
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if opened[tag]:
                    while True:
                        last = self.tag[stack.pop()]
                        opened[last] -= 1
                        if last == tag:
                            break
                put((f"/{tag}", "", stack[-1]))
            elif tag in _RAW_END:
                put((tag, "", stack[-1]))
                if tag in TO_THE_END or not (tag in endless or m[3].rstrip().endswith("/")):
                    end = _RAW_END[tag].search(page, at)
                    if end:
                        at = end.end()
                    elif tag in TO_THE_END:
                        at = size
                    else:
                        endless.add(tag)
            else:
                while len(stack) > 1 and ((top := self.tag[stack[-1]]) in CLOSES.get(tag, ()) or top == "p" and tag in BLOCK):
                    opened[top] -= 1
                    stack.pop()
                if tag not in VOID and not m[3].rstrip().endswith("/"):
                    self.parent.append(stack[-1])
                    self.tag.append(tag)
                    self.names.append(names(m[3]))
                    if tag == "dialog" and re.search(r"\bopen\b", m[3], re.I):
                        self.shown.add(len(self.parent) - 1)
                    opened[tag] += 1
                    stack.append(len(self.parent) - 1)
                put((tag, "", stack[-1]))

    def sums(self, values: list[int]) -> list[int]:
        """Of values of each container, those of all within it."""
        out = list(values)
        for v in range(len(out) - 1, 0, -1):
            out[self.parent[v]] += out[v]
        return out

    def within(self, says: list[bool]) -> list[bool]:
        """Whether a container or one around it is so."""
        out = list(says)
        for v in range(1, len(out)):
            out[v] = out[v] or out[self.parent[v]]
        return out


def largest(read: Page, held: list[int], tags: tuple[str, ...] = ("article",)) -> int:
    """The element of ``tags`` with the most words, the first of equals; 0 if there is none."""
    return max((v for v, t in enumerate(read.tag) if t in tags), key=lambda v: (held[v], -v), default=0)


class Evidence:
    """What a page shows of the containers in its article; all of it in one pass over the page."""

    def __init__(self, read: Page, words: list[int], article: int):
        self.read, self.article = read, article
        size = len(read.parent)
        self.member = read.within([v == article for v in range(size)])
        link = read.within([t == "a" for t in read.tag])
        held, linked, controls, digests = ([0] * size for _ in range(4))
        self.first, self.last = [len(read.tokens)] * size, [-1] * size
        self.named = [m and v != article and t not in WHOLE and any(map(against, n)) for v, (m, t, n) in enumerate(zip(self.member, read.tag, read.names, strict=True))]
        doubtful = read.within([n or m and t in APART for n, m, t in zip(self.named, self.member, read.tag, strict=True)])
        plain = []
        for k, (tag, text, v) in enumerate(read.tokens):
            if words[k]:
                held[v] += words[k]
                linked[v] += words[k] if link[v] else 0
                digests[v] += crc32(" ".join(text.split()).encode("utf-8", "replace"))
                self.first[v], self.last[v] = min(self.first[v], k), k
                if self.member[v] and not doubtful[v]:
                    plain.append(k)
            elif tag in CONTROLS:
                controls[v] += 1
        for v in range(size - 1, 0, -1):
            up = read.parent[v]
            self.first[up], self.last[up] = min(self.first[up], self.first[v]), max(self.last[up], self.last[v])
        self.held, self.linked, self.controls, self.digests = map(read.sums, (held, linked, controls, digests))
        self.start, self.end = (plain[0], plain[-1]) if plain else (-1, len(read.tokens))

    def links(self, v: int) -> bool:
        return 2 * self.linked[v] >= self.held[v] > 0

    def acts(self, v: int) -> bool:
        return EACH_CONTROL * self.controls[v] >= self.held[v] > 0

    def edge(self, v: int) -> bool:
        """No plain text of the article lies before it, or none behind it."""
        return self.last[v] >= 0 and (self.last[v] < self.start or self.first[v] > self.end)

    def small(self, v: int) -> bool:
        return self.held[v] <= SMALL and SHARE * self.held[v] <= self.held[self.article]

    def digest(self, v: int) -> int | None:
        return self.digests[v] if self.held[v] >= REPEATED else None

    def evident(self, known: Callable[[str], bool] = lambda name: False, repeated: frozenset[int] = frozenset()) -> list[bool]:
        """Whether a container inside the article is none of its text.

        Elements of APART are not, but for those of OWN without links or controls.  A name is believed where
        labelled pages know it (``known``), and one of APART_NAMES by its links, controls or a text that other
        pages repeat; by its size or place only for PARTS whose whole name is of such words, or by its place for
        what readers wrote.
        """
        read, says = self.read, [False] * len(self.member)
        for v, (t, own) in enumerate(zip(read.tag, read.names, strict=True)):
            if not self.member[v] or v == self.article:
                continue
            if t in APART:
                says[v] = t not in OWN or self.links(v) or t != "header" and self.acts(v) or t == "dialog" and v not in read.shown
            if says[v] or not own or t in WHOLE:
                continue
            says[v] = any(map(known, own))
            if self.named[v] and not says[v]:
                says[v] = self.links(v) or self.acts(v) or self.digest(v) in repeated
                if t in PARTS and not says[v]:
                    parts = [PART.findall(n) for n in own if against(n)]
                    whole = any(APART_NAMES.issuperset(p) for p in parts)
                    says[v] = whole and (self.small(v) or self.edge(v)) or self.edge(v) and not READERS.isdisjoint(w for p in parts for w in p)
        return says


def labelled(page: str) -> Counter | None:
    """(kind, inside) counts of a page that marks one article; None of any other.

    Kinds are tags and, behind a dot, the names of containers with the words in them.  What the page shows to be
    no text of the article (``Evidence.evident``) counts as outside.  Behind "=" are the texts of containers in
    the article whose names speak against them, once a page.
    """
    low = page.lower()
    mark = next((t for t in ("article", "main") if len(re.findall(rf"<{t}[\s>]", low)) == 1), None)
    if mark is None:
        return None
    read, found = Page(page), Counter()
    marked = read.within([t == mark for t in read.tag])
    words = [0 if tag else len(text.split()) for tag, text, _ in read.tokens]
    shown = Evidence(read, words, read.tag.index(mark))
    away = read.within(shown.evident())
    found.update({(f"={d}", True) for v, n in enumerate(shown.named) if n and (d := shown.digest(v)) is not None})
    sizes = [[0] * len(marked), [0] * len(marked)]
    for (tag, _, v), n in zip(read.tokens, words, strict=True):
        inside = marked[v] and not away[v]
        if tag:
            found[tag, inside] += 1
        else:
            sizes[inside][v] += n
    for inside, held in enumerate(map(read.sums, sizes)):
        for v, n in enumerate(held):
            for name in read.names[v] if n else ():
                found[f".{name}", bool(inside)] += n
    return found


class Weights:
    """Scores of tags, and the container names whose words are not content or are content only."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        tags = {k for k, _ in counts if k[0] not in ".="}
        inside, outside = (sum(counts.get((t, side), 0) for t in tags) + 1 for side in (True, False))
        odds = {t: math.log((counts.get((t, False), 0) + 1) / outside) - math.log((counts.get((t, True), 0) + 1) / inside) for t in tags}
        self.tags = {t: -min(MOST, max(0.01, o)) for t, o in odds.items()}
        #: name -> words inside and outside
        self.seen = {k[1:]: (counts.get((k, True), 0), counts.get((k, False), 0)) for k, _ in counts if k[0] == "."}
        #: digests of texts that several articles have in containers whose names speak against them
        self.repeated = frozenset(int(k[1:]) for (k, _), n in counts.items() if k[0] == "=" and n >= PAGES)

    def score(self, tag: str) -> float:
        return self.tags.get(tag, -0.3)

    def apart(self, name: str, prior: int = PRIOR) -> bool:
        inside, outside = self.seen.get(name, (0, 0))
        outside += prior if against(name) else 0
        return outside >= max(LEAST, PROOF * (inside + 1))

    def content(self, tag: str, name: tuple[str, ...]) -> bool:
        if tag in ("article", "main"):
            return True
        return any((s := self.seen.get(n)) and s[0] >= max(LEAST, PROOF * (s[1] + 1)) for n in name)

    def away(self, read: Page, words: list[int]) -> list[bool]:
        """Whether a container holds no content, by its tag or its names or those of one around it.

        Names say nothing of a WHOLE element, nor of a container around most of the page's words and the
        page's article or, where none is marked, its heading.  Inside the largest article evidence decides.
        """
        own = [0] * len(read.parent)
        for (_, _, v), n in zip(read.tokens, words, strict=True):
            own[v] += n
        held = read.sums(own)
        article = largest(read, held)
        shown = Evidence(read, words, article) if article else None
        best = largest(read, held, ("article", "main"))
        best = best or next((v for v, t in enumerate(read.tag) if t == "h1"), 0)
        around = set()
        while best:
            around.add(best)
            best = read.parent[best]
        says = [t in APART for t in read.tag]
        for v, (t, name) in enumerate(zip(read.tag, read.names, strict=True)):
            if name and not says[v] and not (shown and shown.member[v]) and t not in WHOLE and not (v in around and 2 * held[v] > held[0]):
                says[v] = any(map(self.apart, name))
        if shown:
            inner = shown.evident(lambda name: self.apart(name, 0), self.repeated)
            says = [i if m and v != article else s for v, (s, i, m) in enumerate(zip(says, inner, shown.member, strict=True))]
        return read.within(says)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The half-open run of the highest sum, the longest of equals from the left; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > 0 and total >= best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks joined by line ends; empty for a page without content."""
    read = Page(page or "")
    tokens = read.tokens
    sizes = [0 if tag else len(text.split()) for tag, text, _ in tokens]
    away = weights.away(read, sizes)
    lo, hi = best_region([weights.score(tag) if tag else -float(n) if away[v] else float(n) for (tag, _, v), n in zip(tokens, sizes, strict=True)])
    inside = [k for k in range(lo, hi) if sizes[k] and not away[tokens[k][2]]]
    if not inside:
        return ""
    # containers around the first word, and of those around the last the innermost that is one of them
    chain, v = set(), tokens[inside[0]][2]
    while v:
        chain.add(v)
        v = read.parent[v]
    whole = tokens[inside[-1]][2]
    while whole and whole not in chain:
        whole = read.parent[whole]
    v = whole
    while v:
        if weights.content(read.tag[v], read.names[v]):
            whole = v
            if read.tag[v] == "article":
                break
        v = read.parent[v]
    if whole and read.tag[whole] not in ("html", "body"):
        member = read.within([v == whole for v in range(len(read.parent))])
        held = [k for k, t in enumerate(tokens) if member[t[2]]]
        lo, hi = min(lo, held[0]), max(hi, held[-1] + 1)
    blocks, now = [], []
    for tag, text, v in tokens[lo:hi]:
        if tag.lstrip("/") in BLOCK:
            blocks.append("".join(now))
            now = []
        elif tag:
            now.append(" " if tag == "br" else "")
        elif not away[v]:
            now.append(html.unescape(text))
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def fit(pages: DataFrame, row_id: str = "page_id", page: str = "html", sample: int = SAMPLE) -> Weights:
    """From at most ``sample`` pages, chosen by hash; pages without one marked article teach nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for p in batch.column(0):
                total += labelled(p.as_py() or "") or Counter()
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], type=pa.string()), pa.array([i for _, i in keys], type=pa.bool_()), pa.array([total[k] for k in keys], type=pa.int64())], ["kind", "inside", "n"])

    chosen = pages.select(F.col(row_id).alias("_id")).filter("_id is not null").orderBy(seeded(SEED, "_id"), "_id").limit(sample).distinct()
    some = pages.select(F.col(row_id).alias("_id"), F.col(page).alias("_page")).join(F.broadcast(chosen), "_id", "left_semi")  # sample ids at most
    counts = some.select("_page").mapInArrow(each, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    rows = counts.filter(~F.col("kind").startswith("=") | (F.col("n") >= PAGES)).collect()  # tags, names and repeated texts of sample pages
    return Weights({(r["kind"], r["inside"]): r["n"] for r in rows})


def extract(pages: DataFrame, weights: Weights, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """(*keep, text, n_chars) per row.  A null page is an empty one; broken markup is read as far as it goes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                texts = [main_text(p.as_py(), weights) for p in some.column(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], [*some.schema.names[:-1], "text", "n_chars"])

    kept = pages.select(*keep, F.col(page).alias("_page"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(each, f"{kinds}, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


QUERIES = {"op4_html": op4_html}
ORACLES: dict[str, str] = {}
