"""A small HTML tokenizer for Python tasks: open and close tags and texts in page order."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements whose content is text up to their own end tag.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for x in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ("open", tag, attributes as written), ("close", tag, "") or ("text", "", still encoded).

    A tag ends at the first ``>`` outside quotes; a quote that nothing closes is none. What ends nowhere is text. Takes time
    linear in the page: each search either moves on by what it has read, or is known to fail from the last place of a mark.
    """
    at, text, end = 0, 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 4)
            stop = end if stop < 0 else stop + 3
            kind = name = rest = ""
        else:
            closing = page.startswith("/", begin + 1)
            m = _NAME.match(page, begin + 1 + closing)
            if begin > last[">"] or not m and not page.startswith(("!", "?", "/"), begin + 1):
                at = begin + 1
                continue
            if m:
                stop = _tag_end(page, m.end(), last)
                kind, name, rest = "close" if closing else "open", m[0].lower(), page[m.end() : stop - 1]
            else:
                stop, kind = page.find(">", begin) + 1, ""
        if begin > text:
            yield "text", "", page[text:begin]
        at = text = stop
        if kind:
            yield kind, name, "" if kind == "close" else rest
        if kind == "open" and name in RAW:
            close = _END[name].search(page, at)
            if close is None:
                return
            at = text = close.end()
            yield "close", name, ""
    if text < end:
        yield "text", "", page[text:]


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place after the ``>`` that ends the tag; there is one at or after ``at``."""
    while (m := _STOP.search(page, at)) is not None:
        quote, at = m[0], m.end()
        if quote == ">":
            return at
        if at <= last[quote]:
            closed = page.find(quote, at) + 1
            if closed <= last[">"]:
                at = closed
    return last[">"] + 1


def attributes(rest: str) -> dict[str, str]:
    """Attributes by lower-case name, character references decoded; the first of a name holds."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = m[2] or ""
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        found.setdefault(m[1].lower(), html.unescape(value))
    return found
