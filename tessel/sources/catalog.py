"""Catalog pages to records by a table function: a row per course block, an error row for a bad one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes of blocks and their parts, the patterns of titles, codes and cross-listings.
BLOCK, TITLE_PART, TEXT_PART, EXTRA_PART, LINK = "courseblock", "courseblocktitle", "cb_desc", "courseblockextra", "bubblelink"
TITLE = re.compile(r"^([A-Z]{2,4})\s?(\d{4}[A-Z]?)\.\s+(.+?)\.\s+\(([\d.]+)\s*Hours?\)\s*$")
CODE = re.compile(r"^([A-Z]{2,4})\s?(\d{4}[A-Z]?)$")
CROSS = re.compile(r"\b([A-Z]{2,4})\s?([0-9]{4}[A-Z]?)\s+and\s+([A-Z]{2,4})\s?([0-9]{4}[A-Z]?)\s+are\s+cross-?listed", re.I)

RECORD = "pos int, code string, name string, credits int, description string, prereqs array<string>, cross_listed array<string>, error string"


class _Blocks(HTMLParser):
    """Gathers the texts of each block's parts; ``found`` holds (parts, error) of blocks in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[dict | None, str | None]] = []
        self.block: dict | None = None
        self.depth = 0  # open divs within the block
        self.part = self.link = self.strong = False
        self.into: list[list[str]] = []  # texts that get what is read

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag == "div" and BLOCK in classes:
            if self.block is not None:
                self.close_block("unclosed block")
            self.block, self.depth = {"title": None, "text": None, "links": []}, 1
        elif self.block is None:
            return
        elif tag == "div":
            self.depth += 1
        elif tag == "p":
            self.end_part()
            name = "title" if TITLE_PART in classes else "text" if TEXT_PART in classes else None
            if name and self.block[name] is None:
                self.block[name] = []
                self.into = [self.block[name]]
            self.part, self.label = EXTRA_PART in classes, None
        elif self.part and tag == "strong" and self.label is None:
            self.label = []
            self.into = [self.label]
        elif self.part and tag == "a" and LINK in classes and self.label is not None and "rerequisite" in "".join(self.label):
            self.block["links"].append([])
            self.into = [self.block["links"][-1]]

    def handle_endtag(self, tag):
        if self.block is None:
            return
        if tag == "div":
            self.depth -= 1
            if self.depth == 0:
                self.close_block(None)
        elif tag == "p":
            self.end_part()
        elif self.part and tag in ("a", "strong"):
            self.into = []

    def handle_data(self, data):
        for x in self.into:
            x.append(data)

    def end_part(self):
        self.part, self.into = False, []

    def close_block(self, error):
        self.end_part()
        self.found.append((self.block, error))
        self.block = None


def _joined(texts: list[str] | None, by: str = " ") -> str | None:
    return None if texts is None else by.join(t.strip() for t in texts if t.strip())


def record_of(parts: dict) -> tuple | None:
    """(code, name, credits, description, prereqs, cross_listed) of a block; None if its title is no course's."""
    m = TITLE.match(_joined(parts["title"]) or "")
    if m is None:
        return None
    code = f"{m[1]} {m[2]}"
    try:
        hours = float(m[4])
        credits = int(hours) if hours == int(hours) else None
    except ValueError:
        credits = None
    text = _joined(parts["text"])
    named = [f"{c[1]} {c[2]}" for c in map(CODE.match, (_joined(x, "") for x in parts["links"])) if c]
    cross = [f"{c[i]} {c[i + 1]}".upper() for c in CROSS.finditer(text or "") for i in (1, 3)]
    return code, m[3].strip(), credits, text, *(list(dict.fromkeys(x for x in codes if x != code)) for codes in (named, cross))


class CourseBlocks:
    """The table function: ``eval`` yields the records of one page; what goes wrong in a block is a row and doesn't end the page."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html is None:
            return
        page = _Blocks()
        page.feed(html)
        page.close()
        if page.block is not None:
            page.close_block("unclosed block")
        for pos, (parts, error) in enumerate(page.found):
            try:
                row = None if error else record_of(parts)
            except Exception as e:  # noqa: BLE001
                row, error = None, f"{type(e).__name__}: {e}"
            if row is not None:
                yield pos, *row, None
            elif error:
                yield pos, None, None, None, None, None, None, error


def course_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, once for each record or error of a page, with RECORD's columns."""
    blocks = F.udtf(CourseBlocks, returnType=RECORD)
    column: Column = F.col(html)
    return pages.lateralJoin(blocks(column.outer())).drop(html)
