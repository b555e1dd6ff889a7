"""Main text of web pages: rules for page furniture, and removal of each site's templates.

A page is read once from left to right, with the end tags that HTML implies. What its tags,
classes and roles name as menu, header, footer, sidebar, notice, advert, form, script or reader
comment is left out; a class word alone does not drop what holds the article. The element subtrees that remain are hashed; Spark counts for each host on
how many pages with different contents a subtree occurs, and subtrees that recur on many are
templates and are deleted. Text under ``article`` (else ``main``, else the whole body) is the main
text. There only containers such as ``div`` or ``ul`` can be templates, not paragraphs or headings,
and never the one that holds half of the text or more: sites repeat passages, too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlytics.llm.scratch import stored
from crewlytics.llm.text_arrays import tidy

MIN_PAGES = 10

# fixed values: names that HTML gives and words that mark page furniture
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
) - {"br"}
CONTAINER = set("blockquote details div dl fieldset figure menu ol pre section table ul".split())
DROPPED = set(
    "aside audio button canvas dialog embed footer form head header iframe menu nav noembed noframes noscript "
    "object script select style svg template textarea title video xmp".split()
)
DROPPED_WORDS = set(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget".split()
)
DROPPED_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
NEVER = {"html", "body"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>?")
COMMENT_END = re.compile(r"--!?>")
BETWEEN = re.compile(r"[\s/]*")
NAME = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
M64 = (1 << 64) - 1


HARD, SOFT = 1, 2


def _furniture(tag: str, attributes: dict[str, str], open_articles: int) -> int:
    """Whether an element is page furniture: HARD by what it is, SOFT by a word in its class or id."""
    if tag in DROPPED:
        return HARD
    if not attributes or tag in NEVER:
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return HARD
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return HARD
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return HARD
    if tag in ("article", "main") and not open_articles:
        return 0
    names = attributes.get("class", "") + " " + attributes.get("id", "")
    return SOFT if any(w.lower() in DROPPED_WORDS for w in WORD.findall(names)) else 0


class Tags:
    """Reads the attributes of tags as the HTML standard does, in one pass over the page."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.quotes = {q: source.rfind(q) for q in "\"'"}

    def read(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes behind a tag's name and where the tag ends, which some ``>`` must do.

        A quote without a second one is part of the value, which ends with the tag.
        """
        source, found = self.source, {}
        while True:
            at = BETWEEN.match(source, at).end()
            if at > self.last:
                return found, len(source)
            if source[at] == ">":
                return found, at + 1
            name = NAME.match(source, at)
            at, value = name.end(), ""
            equals = EQUALS.match(source, at)
            if equals:
                at = equals.end()
                quote = source[at : at + 1]
                if quote in self.quotes and self.quotes[quote] > at:
                    close = source.index(quote, at + 1)
                    value, at = source[at + 1 : close], close + 1
                else:
                    plain = UNQUOTED.match(source, at)
                    value, at = plain[0], plain.end()
            found.setdefault(name[0].lower(), value)


class Page:
    """The blocks of a page and its subtrees: (first block, last, hash, length, tag, inside)."""

    def __init__(self, source: str, spared: frozenset[int] = frozenset()):
        import xxhash

        self.hash_of = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
        self.blocks: list[str] = []
        self.inside: list[int] = []  # 2: in an article, 1: in main, 0: elsewhere
        self.subtrees: list[tuple] = []
        self.buffer: list[str] = []
        self.stack: list[list] = []  # [tag, hash, length, first block, furniture]
        self.open: dict[str, list[int]] = {}  # places of the open elements of a tag in the stack
        self.open_blocks: list[int] = []
        self.dropped = 0  # open elements that are furniture or lie in it
        self.hard = 0
        self.elements = 0
        self.spared = spared
        self.wrappers: list[list] = []  # open SOFT elements: [number, characters, holds an article]
        self.closed: list[list] = []
        self._read(source)
        while self.stack:
            self._pop()
        self._flush()
        self.root = max(self.inside, default=0)
        if not self.root and not spared:
            self._spare(source)

    def _spare(self, source: str) -> None:
        """Reads the page anew if a class word has dropped what holds the article.

        That is an element with half of the text or more and in it an article, main part or first
        heading, on a page that has no article outside.
        """
        total = sum(map(len, self.blocks)) + sum(w[1] for w in self.closed if w[3])
        spared = frozenset(w[0] for w in self.closed if w[2] and 2 * w[1] >= total > 0)
        if spared:
            self.__init__(source, spared)

    def _inside(self) -> int:
        return 2 if self.open.get("article") else 1 if self.open.get("main") else 0

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                self.blocks.append(text)
                self.inside.append(self._inside())
                if self.stack:
                    top = self.stack[-1]
                    top[1] = (top[1] * 1099511628211 + self.hash_of(text)) & M64
                    top[2] += len(text)

    def _push(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCK:
            self._flush()
            self.open_blocks.append(len(self.stack))
        self.elements += 1
        kind = _furniture(tag, attributes, len(self.open.get("article", ())))
        if kind == SOFT and self.elements in self.spared:
            kind = 0
        if kind == HARD:
            self.hard += 1
        elif kind == SOFT and not self.hard:
            self.wrappers.append([self.elements, 0, False, not self.wrappers])
        elif self.wrappers and not self.hard and tag in ("article", "main", "h1"):
            self.wrappers[-1][2] = True
        self.dropped += kind > 0
        self.stack.append([tag, 0, 0, len(self.blocks), kind])
        self.open.setdefault(tag, []).append(len(self.stack) - 1)

    def _pop(self) -> None:
        if self.stack[-1][0] in BLOCK:
            self._flush()
            self.open_blocks.pop()
        tag, inner, length, first, kind = self.stack.pop()
        inside = self._inside()
        self.open[tag].pop()
        dropped = self.dropped
        self.dropped -= kind > 0
        if kind == HARD:
            self.hard -= 1
        elif kind == SOFT and not self.hard:
            wrapper = self.wrappers.pop()
            self.closed.append(wrapper)
            if self.wrappers:
                self.wrappers[-1][1] += wrapper[1]
                self.wrappers[-1][2] |= wrapper[2]
        if not dropped and length:
            own = self.hash_of(f"{tag}:{inner}")
            if tag in BLOCK and tag not in NEVER and tag not in ("article", "main"):
                self.subtrees.append((first, len(self.blocks), own, length, tag, inside))
            if self.stack:
                top = self.stack[-1]
                top[1] = (top[1] * 1099511628211 + own) & M64
                top[2] += length

    def _imply(self, tag: str) -> None:
        """Closes what a start tag closes."""
        if tag in CLOSES:
            closed, stop = CLOSES[tag]
            floor = max((self.open[t][-1] for t in stop if self.open.get(t)), default=-1)
            lowest = len(self.stack)
            for t in closed:
                places = self.open.get(t, ())
                at = bisect_right(places, floor)
                if at < len(places):
                    lowest = min(lowest, places[at])
            while len(self.stack) > lowest:
                self._pop()
        elif tag in BLOCK and self.open_blocks and self.stack[self.open_blocks[-1]][0] == "p":
            at = self.open_blocks[-1]
            while len(self.stack) > at:
                self._pop()

    def _close(self, tag: str) -> None:
        places = self.open.get(tag)
        if not places:
            return
        at = places[-1]
        if tag not in BLOCK and self.open_blocks and self.open_blocks[-1] > at:
            return
        while len(self.stack) > at:
            self._pop()

    def _text(self, text: str) -> None:
        if not self.dropped:
            self.buffer.append(html.unescape(text) if "&" in text else text)
        elif self.wrappers and not self.hard:
            self.wrappers[-1][1] += len("".join(text.split()))

    def _read(self, source: str) -> None:
        at, tags = 0, Tags(source)
        while True:
            m = TOKEN.search(source, at)
            while m and m[2] and m.end() > tags.last:  # a tag that never ends is text
                m = TOKEN.search(source, m.end())
            end = m.start() if m else len(source)
            if end > at:
                self._text(source[at:end])
            if not m:
                return
            at = m.end()
            if not m[2]:
                if m[0] == "<!--":
                    short = next((n for n in (">", "->") if source.startswith(n, at)), None)
                    stop = None if short else COMMENT_END.search(source, at)
                    at = at + len(short) if short else stop.end() if stop else len(source)
                continue
            tag = m[2].lower()
            attributes, at = tags.read(at)
            if m[1]:
                if tag == "br" and not self.dropped:
                    self.buffer.append(" ")
                self._close(tag)
            elif tag in VOID:
                if not self.dropped:
                    if tag == "hr":
                        self._imply(tag)
                        self._flush()
                    elif tag == "br":
                        self.buffer.append(" ")
            elif tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                at = stop.start() if stop else len(source)
                close = source.find(">", at)
                at = close + 1 if stop and close >= 0 else len(source)
            else:
                self._imply(tag)
                self._push(tag, attributes)

    def candidates(self) -> list[tuple]:
        """The subtrees that may be templates."""
        total = sum(len(b) for b, i in zip(self.blocks, self.inside, strict=True) if i == self.root)
        return [
            s for s in self.subtrees
            if s[5] == self.root and 2 * s[3] < total and (not self.root or s[4] in CONTAINER)
        ]

    def text(self, templates: set[int]) -> str:
        keep = [i == self.root for i in self.inside]
        if templates:
            for first, last, own, *_ in self.candidates():
                if own in templates:
                    keep[first:last] = [False] * (last - first)
        return " ".join(b for b, k in zip(self.blocks, keep, strict=True) if k)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """(key, host, content, subtree) of ``pages`` (key, host, html), each subtree of a page once."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, hosts, contents, subtrees = [], [], [], []
            for key, host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source or "")
                found = {_signed(s[2]) for s in page.candidates()}
                content = xxhash.xxh64_intdigest(page.text(set()).encode("utf-8", "surrogatepass"))
                keys += [key] * len(found)
                hosts += [host] * len(found)
                contents += [_signed(content)] * len(found)
                subtrees += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(contents, pa.int64()),
                 pa.array(subtrees, pa.int64())],
                ["key", "host", "content", "subtree"],
            )

    return pages.mapInArrow(run, "key long, host string, content long, subtree long")


def templates_of(found: DataFrame, min_pages: int) -> DataFrame:
    """(host, subtree) of the subtrees that are on at least ``min_pages`` pages of their host.

    The number does not grow with the host, so the template of a small part of a large host counts
    as it would on a host of its own. Pages with equal contents count once, so copies of one page
    make no template. Distinct rows and counts are partial aggregates; a host with a third of all
    pages is spread by its subtrees.
    """
    once = found.select("host", "subtree", "content").distinct()
    counts = once.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    return counts.where(f"n >= {min_pages}").select("host", "subtree")


def extract_text(
    pages: DataFrame, min_pages: int = MIN_PAGES, id: str = "page_id", url: str = "url", page: str = "html",
) -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one space. A null or empty page has an empty text. Null urls share one host, the
    empty one. Repeated rows each give a row; other columns are not read; pages of any size are
    read whole, one at a time.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"))
    rows = rows.withColumn("key", F.xxhash64("id", "url", "html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:/?#]*://([^/?#]*)", 1))
    hashed = rows.select("key", host.alias("host"), "html")
    found = stored(subtree_hashes(hashed), "subtrees")
    templates = stored(templates_of(found, min_pages), "templates")
    on_page = found.join(templates, ["host", "subtree"])
    on_page = stored(on_page.groupBy("key").agg(F.collect_set("subtree").alias("subtrees")), "page-templates")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                Page(source or "").text({s & M64 for s in gone or ()})
                for source, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            columns.append(pa.array([len(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [id, "url", "text", "n_chars"])

    kind = pages.schema[id].dataType.simpleString()
    joined = rows.join(on_page, "key", "left").select("id", "url", "html", "subtrees")
    return joined.mapInArrow(run, f"`{id}` {kind}, url string, text string, n_chars long")
