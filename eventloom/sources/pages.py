"""Fields, links and embedded triples of HTML pages, one page per row.

Pages are parsed in Arrow batches, each in one pass: plain markup by one regular expression, all
other pages by the standard library's parser, with the same events. Pages never meet each
other, so the work spreads with the input partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from eventloom.fixed_values import DELETED_TEXT

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
#: Elements in which a parser may not look for tags.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
_VALUE = r"""(?:[^"<>&]|&(?:amp|lt|gt|quot);)*+"""
#: A start tag with quoted values, an end tag, or text up to the next tag.
_TOKEN = re.compile(
    rf"""<(?P<start>[A-Za-z][A-Za-z0-9]*+)(?P<attributes>(?:[ \t\n\r\f]++[A-Za-z][A-Za-z0-9:_.-]*+="{_VALUE}")*+)[ ]?(?P<void>/?)>"""
    r"""|</(?P<end>[A-Za-z][A-Za-z0-9]*+)>|(?P<text>[^<]++)"""
)
_ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9:_.-]*+)="([^"]*+)\"""")


class _Element:
    __slots__ = ("tag", "attributes", "pieces", "start", "stop", "found")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]], pieces: list[str]):
        self.tag = tag
        self.attributes: dict[str, str] = {}
        for name, value in attributes:
            self.attributes.setdefault(name, value or "")
        # its text is a part of the page's; that of a silent element is its own
        self.pieces = [] if tag in _SILENT else pieces
        self.start = self.stop = len(self.pieces)
        self.found: list[_Element] = []  # elements inside that have a property

    @property
    def text(self) -> str:
        return "".join(self.pieces[self.start : self.stop])

    def has(self, attribute: str, value: str) -> bool:
        found = self.attributes.get(attribute)
        return found is not None and (found == value or (attribute == "class" and value in found.split()))


class _Page(HTMLParser):
    """Elements in document order, and every text with the element that directly follows it."""

    def __init__(self, html: str):
        self._clear()
        if not self._plain(html):
            self._clear()
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
        while self._open:
            self._end(self._open.pop())

    def _clear(self) -> None:
        self.elements: list[_Element] = []
        self.texts: list[list] = []
        self._open: list[_Element] = []
        self._typed: list[_Element] = []  # open elements with a type
        self._loose: list | None = None
        self._pieces: list[str] = []

    def _plain(self, html: str) -> bool:
        """Handle a page of nothing but plain tags and texts; False at the first other markup."""
        at = 0
        for token in _TOKEN.finditer(html):
            if token.start() != at:
                return False
            at = token.end()
            start, attributes, void, end, text = token.groups()
            if text is not None:
                self.handle_data(unescape(text) if "&" in text else text)
            elif end is not None:
                self.handle_endtag(end.lower())
            else:
                tag = start.lower()
                if tag in _RAW:
                    return False
                found = [(n.lower(), unescape(v) if "&" in v else v) for n, v in _ATTRIBUTE.findall(attributes)] if attributes else []
                (self.handle_startendtag if void else self.handle_starttag)(tag, found)
        return at == len(html)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        element = _Element(tag, attrs, self._pieces)
        if self._loose is not None:
            self._loose[1] = element
            self._loose = None
        self.elements.append(element)
        if "property" in element.attributes:
            for outer in self._typed:
                outer.found.append(element)
        if tag not in _VOID:
            self._open.append(element)
            if "typeof" in element.attributes:
                self._typed.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end(self._open.pop())

    def handle_endtag(self, tag: str) -> None:
        self._loose = None
        if self._open and self._open[-1].tag == tag:
            self._end(self._open.pop())
        elif any(e.tag == tag for e in reversed(self._open)):
            while True:
                element = self._open.pop()
                self._end(element)
                if element.tag == tag:
                    break

    def _end(self, element: _Element) -> None:
        element.stop = len(element.pieces)
        if self._typed and self._typed[-1] is element:
            self._typed.pop()

    def handle_data(self, data: str) -> None:
        for inner in reversed(self._open):
            if inner.tag in _SILENT:
                inner.pieces.append(data)
                return
        self._pieces.append(data)
        self._loose = [data, None]
        self.texts.append(self._loose)

    def first(self, tag: str, attribute: str | None = None, value: str | None = None) -> str | None:
        for element in self.elements:
            if element.tag == tag and (attribute is None or value is None or element.has(attribute, value)):
                return element.text
        return None

    def link(self, pattern: re.Pattern) -> _Element | None:
        for element in self.elements:
            if element.tag == "a" and pattern.search(element.attributes.get("href", "")):
                return element
        return None

    def link_after(self, label: re.Pattern) -> str | None:
        for text, follower in self.texts:
            if label.search(text):
                return follower.attributes.get("href") if follower is not None and follower.tag == "a" else None
        return None

    def triples(self) -> list[dict]:
        return [
            {"s": node.attributes["typeof"], "p": inner.attributes["property"], "o": inner.attributes.get("content", inner.text)}
            for node in self.elements
            for inner in node.found
        ]


_TRIPLES = pa.list_(pa.struct([("s", pa.string()), ("p", pa.string()), ("o", pa.string())]))


def _per_page(pages: DataFrame, key: str, html: str, columns: dict[str, pa.DataType], extract: Callable[[_Page], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(_Page(text or "")) for text in batch.column(1).to_pylist()]
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=[key, *columns])

    rows = pages.select(key, html)
    schema = rows.select(key, *[F.lit(None).cast(from_arrow_type(kind)).alias(name) for name, kind in columns.items()]).schema
    return rows.mapInArrow(run, schema)


def page_fields(pages: DataFrame, key: str, html: str, fields: list[tuple]) -> DataFrame:
    """First text of each (name, tag, attribute, value) field, null without a match."""
    return _per_page(
        pages, key, html, {f[0]: pa.string() for f in fields}, lambda page: tuple(page.first(*f[1:]) for f in fields)
    )


def page_link(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """First link whose address contains the pattern: group 1, address and text.

    The group is taken at the start of the address, null if the pattern only fits later.
    """
    compiled = re.compile(pattern)

    def extract(page: _Page) -> tuple:
        link = page.link(compiled)
        if link is None:
            return None, None, None
        match = compiled.match(link.attributes["href"])
        return (match.group(1) if match else None), link.attributes["href"], link.text

    return _per_page(pages, key, html, {n: pa.string() for n in ("linkId", "href", "linkText")}, extract)


def page_link_after(pages: DataFrame, key: str, html: str, label: str) -> DataFrame:
    """Address of the link right behind the first text that contains the label."""
    compiled = re.compile(label)
    return _per_page(pages, key, html, {"href": pa.string()}, lambda page: (page.link_after(compiled),))


def triple_lists(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The embedded ``triples`` of each page in document order, as one array."""
    return _per_page(pages, key, html, {"triples": _TRIPLES}, lambda page: (page.triples(),))


def page_triples(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Embedded triples in document order as (key, pos, s, p, o) rows."""
    found = triple_lists(pages, key, html)
    return found.select(key, F.posexplode("triples").alias("pos", "t")).select(key, "pos", "t.s", "t.p", "t.o")


def deleted_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Whether a page without triples says in its first ``h3`` that it was deleted."""

    def extract(page: _Page) -> tuple:
        heading = page.first("h3")
        return (not page.triples() and heading is not None and DELETED_TEXT in heading,)

    return _per_page(pages, key, html, {"deleted": pa.bool_()}, extract)
