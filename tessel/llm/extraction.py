"""HTML extraction by composite text density.

A page becomes a tree of its blocks; inline tags belong to their block and only count as tags and links. What no text is
(scripts, styles, controls) is taken out first. A block is in doubt if its tag or role says that it is no main text (menus,
headers, footers, asides, forms), or if a class, or outside articles an id, names such a thing as a whole (``cookieNotice``,
``sidebar-left``, not ``no-sidebar`` or ``social-history``); names of headings, of parts of tables and of inline elements say
nothing. A block in doubt goes, unless it is the page: it has half of its text and all its headings of first order and main
parts, or all of its text; of a form half of the text is enough.
For every block with C characters, T tags, LC characters and LT tags in links the
composite text density is

    C / T * log(base = ln(C / nonLC * LC + LC_body / C_body * C + e), C / LC * T / LT)

with zeros in denominators as 1, so that link text lowers a block's characters per tag. Densities of a block's children
are summed; the block of greatest sum is the core of the page. The least density on its path to the body is the
threshold. Every block off that path is then judged by itself, from the body down: a block whose text is half or more
in links and less dense than the threshold goes with all it holds, all else stays, however sparse. A single link with
text beside it, or within the core or an article on the path, is no list and stays; that is all that article and main
weigh here, but for numbered lists there, as of references, stay too. The rest of the text is returned, block by block, in page order.

Cases: a null or empty page has an empty text; a page without markup is its own text; unclosed, stray and misnested
tags are closed as HTML closes them, by block; repeated rows get equal results; an empty table gives an empty result;
columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.html import VOID, attributes, tokens
from tessel.llm.words import batches
from tessel.session import table

INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "picture",
    "q", "ruby", "rp", "rt", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements whose content is no text of the page.
DROPPED = {
    "head", "script", "style", "noscript", "template", "iframe", "button", "select", "textarea", "option", "svg", "canvas", "object", "embed", "audio", "video", "map", "noframes", "noembed", "title",
}
#: Elements that are no main text unless they are the page; a header within an article is part of it.
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
#: Elements whose class and id say nothing about what they are.
UNNAMED = {"h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre", "li", "dt", "dd", "article", "main", "html", "body"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"}
#: Words that name what is no main text, and words that go with them in the name of such an element.
HINTS = set(
    "ad ads advert adverts advertise advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar side aside widget widgets rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login search share sharing social related recommended recommendations comment comments commentlist respond replies disqus pagination pager copyright legal disclaimer skip".split()
)
BESIDE = set(
    "site page main top bottom left right global primary secondary sub post posts entry article articles story stories content js c l m u o is box boxes wrap wrapper container inner outer holder "
    "section block area region panel bar list lists item items link links button buttons icon icons text form title group col column row slot unit zone sticky fixed mobile desktop user reader "
    "the of to and for your our us media policy info message msg news web".split()
)
_WORDS = re.compile(r"(?<![a-z0-9])[0-9]+x[0-9]+(?![a-z0-9])|[a-z]+|[^a-z0-9\s_-]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag closes if it is open, up to the nearest of its bounds.
_BLOCKS_P = {"address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "li", "dt", "dd"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}


class Block:
    __slots__ = ("tag", "up", "items", "text", "tags", "links", "link_chars", "chars", "density", "total", "article", "anchors", "last", "doubt", "form", "heads")

    def __init__(self, tag: str, up: Block | None):
        self.tag, self.up, self.items, self.text = tag, up, [], None  # items: blocks and anonymous runs of text, in order
        self.tags = self.links = self.link_chars = self.chars = 0
        self.anchors = self.last = 0  # links that have text, and the number of the last one
        self.density = self.total = 0.0
        self.article = tag in ("article", "main")
        self.doubt = self.form = False  # its tag, role, class or id says that it is no main text; it is a form
        self.heads = int(tag in ("main", "h1"))  # how many of these it holds

    def add(self, text: str, link: int) -> None:
        """Text of this block; ``link`` is the number of the link it is in, 0 if none."""
        if not self.items or self.items[-1].tag:
            run = Block("", self)
            run.text = []
            self.items.append(run)
        run = self.items[-1]
        run.text.append(text)
        if link:
            run.link_chars += len(text)
            if link != run.last and not text.isspace():
                run.anchors, run.last = run.anchors + 1, link


def hidden(tag: str, of: dict[str, str]) -> bool:
    """Whether an element is no text of the page by its tag or by what hides it."""
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in of or of.get("aria-hidden", "").lower() == "true" or "display:none" in of.get("style", "").replace(" ", "").lower()


def doubted(tag: str, of: dict[str, str], in_article: bool) -> bool:
    """Whether a block's tag, role, class or id says that it is no main text."""
    if tag in ASIDE or tag == "header" and not in_article or tag not in ("article", "main") and of.get("role", "").lower() in ROLES:
        return True
    if tag in UNNAMED:
        return False
    names = of.get("class", "") if in_article else f"{of.get('class', '')} {of.get('id', '')}"
    return any(hinted(n) for n in names.split())


def hinted(name: str) -> bool:
    """Whether a class or id as a whole names something that is no main text: a hint and words that go with it, nothing else."""
    words = [w for w in _WORDS.findall(_CAMEL.sub("-", name).lower()) if not w[0].isdigit()]
    return any(w in HINTS for w in words) and all(w in HINTS or w in BESIDE for w in words)


def parse(page: str) -> Block:
    """The tree of blocks that may be main text; the root is the body."""
    body = at = Block("body", None)
    open_: list[str] = []  # names of open elements, without html and body; blocks' are those of at's line
    skip = 0  # depth in open_ of what is taken out, 0 if nothing is
    linked = link = 0  # open links; number of the last one
    for kind, name, rest in tokens(page):
        if kind == "text":
            if not skip:
                at.add(rest, link if linked else 0)
            continue
        if name in ("html", "body"):
            continue
        inline = name in INLINE
        if kind == "open":
            closes, bounds = _CLOSES.get(name, ((), ()))
            for i in range(len(open_) - 1, -1, -1):
                x = open_[i]
                if x in closes or x == "p" and name in _BLOCKS_P:
                    at, skip, linked = _pop(open_, i, at, skip, linked)
                elif x in bounds or not closes and x not in INLINE:
                    break
            if skip:
                if name not in VOID:
                    open_.append(name)
                continue
            if name == "br":
                at.add(" ", 0)
                at.tags += 1
                continue
            if name == "hr":
                at.items.append(Block("hr", at))
                continue
            if name in VOID:
                at.tags += 1
                continue
            of = attributes(rest) if rest else {}
            if hidden(name, of):
                open_.append(name)
                skip = len(open_)
                continue
            open_.append(name)
            if inline:
                at.tags += 1
                if name == "a":
                    at.links += 1
                    linked, link = linked + 1, link + 1
            else:
                child = Block(name, at)
                child.doubt = doubted(name, of, any(x in ("article", "main") for x in open_[:-1]))
                child.form = name == "form" or of.get("role", "").lower() == "form"
                at.items.append(child)
                at = child
        elif name in open_:
            i = len(open_) - 1 - open_[::-1].index(name)
            if inline and any(x not in INLINE for x in open_[i + 1 :]):
                i = None  # an inline tag's end doesn't close blocks within it
            if i is not None:
                at, skip, linked = _pop(open_, i, at, skip, linked)
    return body


def _pop(open_: list[str], i: int, at: Block, skip: int, linked: int) -> tuple[Block, int, int]:
    while len(open_) > i:
        name = open_.pop()
        if skip:
            if len(open_) < skip:
                skip = 0
        elif name == "a":
            linked -= 1
        elif name not in INLINE and at.up is not None:
            at = at.up
    return at, skip, linked


def settle_doubts(body: Block) -> None:
    """Take out the blocks in doubt, but for those that are the page."""
    order, stack = [], [body]
    while stack:
        b = stack.pop()
        order.append(b)
        stack += b.items
    size: dict[int, int] = {}
    for b in reversed(order):
        size[id(b)] = len("".join(b.text).strip()) if b.text is not None else sum(size[id(c)] for c in b.items)
        b.heads += sum(c.heads for c in b.items)
    whole, heads, stack = size[id(body)], body.heads, [body]

    def is_page(b: Block) -> bool:
        return 2 * size[id(b)] >= whole > 0 and (b.form or b.heads == heads > 0 or size[id(b)] == whole)

    while stack:
        b = stack.pop()
        b.items = [c for c in b.items if not c.doubt or is_page(c)]
        stack += b.items


def measure(body: Block) -> None:
    """Characters, tags and densities of all blocks; children come before their parents."""
    order, stack = [], [body]
    while stack:
        b = stack.pop()
        order.append(b)
        stack += b.items
    for b in reversed(order):
        if b.text is not None:
            words = html.unescape("".join(b.text)).split()
            b.text = " ".join(words)
            b.chars = len(b.text)
            b.link_chars = min(b.link_chars, b.chars)
        for c in b.items:
            b.chars += c.chars
            b.link_chars += c.link_chars
            b.tags += c.tags + (c.tag != "")
            b.links += c.links
            b.anchors += c.anchors
    ratio = body.link_chars / max(1, body.chars)
    for b in order:
        if b.chars:
            tags, lc = max(1, b.tags), max(1, b.link_chars)
            base = math.log(b.chars / max(1, b.chars - b.link_chars) * b.link_chars + ratio * b.chars + math.e)
            b.density = b.chars / tags * math.log(max(1.0, b.chars / lc * tags / max(1, b.links))) / math.log(max(base, 1 + 1e-9)) if base > 1 + 1e-9 else b.chars / tags
    for b in order:
        b.total = sum(c.density for c in b.items)


def linked(b: Block, inside: bool) -> bool:
    """Whether a block is of links mostly: several, or one with no text beside it unless that is within the core or an article."""
    if b.anchors == 1:
        return not inside and b.link_chars == b.chars
    return 2 * b.link_chars >= max(1, b.chars)


def main_text(body: Block) -> list[str]:
    """The texts of the blocks that are main text, in page order."""
    best, stack = body, [body]
    while stack:
        b = stack.pop()
        if b.total > best.total:
            best = b
        stack += b.items[::-1]
    path, b = [], best
    while b is not None:
        path.append(b)
        b = b.up
    least = min(b.density for b in path)
    on, texts = set(map(id, path)), []
    stack = [(body, False, False)]
    while stack:
        b, inside, listed = stack.pop()
        inside = inside or b is best or b.article and id(b) in on
        listed = listed or inside and b.tag == "ol"
        if id(b) not in on and b.tag not in HEADINGS and not listed and b.density < least and linked(b, inside):
            continue
        if b.text:
            texts.append(b.text)
        stack += [(c, inside, listed) for c in b.items[::-1]]
    return texts


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    body = parse(page)
    settle_doubts(body)
    measure(body)
    return " ".join(main_text(body))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    of = pages.schema["page_id"].dataType.simpleString()

    def rows(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(batched, "html"):
            found = [extract(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(rows, f"page_id {of}, url string, text string, n_chars long")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the main texts of all ``pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))
