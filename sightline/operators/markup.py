"""Page elements that need a walk over the markup: headings, images, meta tags, locale links and content blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from sightline.sources.shared import bound_pages

#: Elements whose text isn't content, elements that close themselves, and what a block's text is taken from (fixed).
SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe")
HEADINGS = ("h1", "h2", "h3", "h4")
TEXTUAL = ("p", "ul", "ol", "table", "blockquote")
#: Elements whose whole content no block holds.
NOT_BLOCK = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript")

#: Attributes of images that are kept, besides those of data-.
IMAGE_ATTRIBUTES = ("alt", "width", "height", "loading", "class")

ELEMENTS = "url string, pos int, kind string, name string, value string, extra map<string,string>"
BLOCKS = "url string, pos int, heading string, content string, word_count int"


#: Rows that a task holds in Python at most, but for those of one page.
HELD = 2_000


def _tables(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """rows as tables of HELD rows at most."""
    rows = iter(rows)
    while part := list(islice(rows, HELD)):
        yield pd.DataFrame(part, columns=columns)


class _Walk(HTMLParser):
    """Collects (kind, name, value, attributes) in document order, and blocks of at least so many words."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str | None, dict]] = []
        self.blocks: list[list] = [["Introduction", []]]
        self.skip = self.away = 0
        self.open: list[tuple[str, list[str], list[str] | None, dict]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        self.away += tag in NOT_BLOCK
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "img":
            self.rows.append(("image", "img", a.get("src"), {k: v for k, v in a.items() if k in IMAGE_ATTRIBUTES or k.startswith("data-")}))
        elif tag == "meta" and (a.get("name") or a.get("property")):
            self.rows.append(("meta", (a.get("name") or a["property"]).lower(), a.get("content"), {}))
        elif tag == "link" and "rel" in a:
            for rel in a["rel"].lower().split():
                if rel == "canonical" or (rel == "alternate" and "hreflang" in a):
                    self.rows.append(("link", rel, a.get("href"), {"hreflang": a["hreflang"]} if "hreflang" in a else {}))
        elif tag in HEADINGS or tag in TEXTUAL or tag in ("title", "a"):
            if tag in HEADINGS or tag in TEXTUAL:
                self._close("p")  # a paragraph ends where another block begins
            self.open.append((tag, [], None if self.away else [], a))

    def handle_endtag(self, tag: str) -> None:
        if tag in NOT_BLOCK:
            self.away = max(0, self.away - 1)
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        else:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for _, parts, kept, _ in self.open:
                parts += (data, " ")  # runs of text between tags stand apart
                if kept is not None and not self.away:
                    kept += (data, " ")

    def _close(self, tag: str) -> None:
        if not any(o[0] == tag for o in self.open):
            return
        while self.open:
            t, parts, kept, a = self.open.pop()
            text = " ".join("".join(parts).split())
            block = " ".join("".join(kept or ()).split())
            if t in HEADINGS:
                self.rows.append(("heading", t, text, {}))
                if kept is not None:
                    self.blocks.append([block, []])
            elif t in TEXTUAL and len(block.split()) >= 5:
                self.blocks[-1][1].append(block)
            elif t == "title":
                self.rows.append(("title", t, text, {}))
            elif t == "a" and a.get("href"):
                self.rows.append(("anchor", t, a["href"], {"text": text[:100], "rel": a.get("rel", "")}))
            if t == tag:
                break


def _walked(html: str | None) -> _Walk:
    walk = _Walk()
    walk.feed(html or "")
    walk.close()
    while walk.open:
        walk._close(walk.open[-1][0])
    return walk


def elements(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, pos, kind, name, value, extra): one row for each element, in document order.

    kind: title, heading, meta, link (canonical and alternate), image, anchor. Null html has no rows. Markup that is not
    closed ends with what surrounds it.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((u, i, *r) for u, h in zip(pdf["url"], pdf["html"]) for i, r in enumerate(_walked(h).rows))
            yield from _tables(rows, ["url", "pos", "kind", "name", "value", "extra"])

    bound_pages(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(walk, ELEMENTS)


def blocks(pages: DataFrame, least: int = 20) -> DataFrame:
    """pages(url, html) -> (url, pos, heading, content, word_count): text between headings, of `least` words or more."""

    def found(u: str | None, h: str | None) -> list[tuple]:
        made = [(head, " ".join(parts)) for head, parts in _walked(h).blocks]
        return [(u, i, head, text, len(text.split())) for i, (head, text) in enumerate(made) if len(text.split()) >= least]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = (r for u, h in zip(pdf["url"], pdf["html"]) for r in found(u, h))
            yield from _tables(rows, ["url", "pos", "heading", "content", "word_count"])

    bound_pages(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(walk, BLOCKS)


#: What the id of a client-side framework's root holds, and elements without an end tag.
ROOT_IDS = ("app", "root", "__next", "__nuxt")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Roots(HTMLParser):
    """Ids like those of ROOT_IDS in document order, each with the text within its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name = (dict(attrs).get("id") or "").lower()
        parts: list[str] | None = [] if any(r in name for r in ROOT_IDS) else None
        if parts is not None:
            self.found.append((name, parts))
        if tag not in VOID:
            self.open.append((tag, parts))

    def handle_endtag(self, tag: str) -> None:
        at = max((i for i, o in enumerate(self.open) if o[0] == tag), default=None)
        if at is not None:  # an end tag without a start is passed over
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        for _, parts in self.open:
            if parts is not None:
                parts.append(data)


def framework_roots(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, pos, id, characters): elements that frameworks render into, and how long their text is."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, h in zip(pdf["url"], pdf["html"]):
                roots = _Roots()
                roots.feed(h or "")
                roots.close()
                rows += [(u, i, name, len("".join(parts).strip())) for i, (name, parts) in enumerate(roots.found)]
            yield pd.DataFrame(rows, columns=["url", "pos", "id", "characters"])

    bound_pages(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(walk, "url string, pos int, id string, characters int")
