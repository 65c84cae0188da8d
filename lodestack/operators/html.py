"""Text, tables, headings and links of HTML pages by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that are never content, elements that end a line, headings, and void elements.
CHROME = {"script", "style", "nav", "header", "footer", "noscript", "svg", "form", "iframe"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "tr", "table", "td", "th", "body", "title", "dt", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
LEAST_MAIN, MAIN_SHARE = 400, 0.5


class _Page(HTMLParser):
    """One pass over a page's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.open: list[str] = []
        self.body: list[str] = []
        self.main: list[str] = []
        self.title: list[str] = []
        self.headings: list[list[str]] = []
        self.tables: list[list[list[str]]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.in_main = 0

    def handle_starttag(self, tag, attrs):
        if tag in CHROME and tag not in VOID:
            self.skip.append(tag)
        if tag not in VOID:
            self.open.append(tag)
        if self.skip:
            return
        if tag in ("main", "article"):
            self.in_main += 1
        if tag in BLOCKS:
            self._write("\n")
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self._inside("table"):
            self.tables[-1].append([])
        elif tag in ("td", "th") and self._inside("table"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append("")
        elif tag in HEADINGS:
            self.headings.append([])
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", []))

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
            return
        if self.skip:
            return
        if tag in ("main", "article") and self.in_main:
            self.in_main -= 1
        if tag in BLOCKS:
            self._write("\n")

    def _inside(self, tag: str) -> bool:
        return tag in self.open and bool(self.tables)

    def _write(self, text: str) -> None:
        if not self._inside("table"):
            self.body.append(text)
            if self.in_main:
                self.main.append(text)

    def handle_data(self, data):
        if "title" in self.open and not self.skip:
            self.title.append(data)
            return
        if self.skip:
            return
        if self._inside("table"):
            if self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1] += data
        else:
            self._write(data)
        if self.headings and any(h in self.open for h in HEADINGS):
            self.headings[-1].append(data)
        if self.links and "a" in self.open:
            self.links[-1][1].append(data)


def _lines(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def read_page(html: str) -> dict:
    """``title, text, headings, tables, links`` of a page; broken markup gives what can be read."""
    p = _Page()
    p.feed(html)
    p.close()
    body, main = _lines(p.body), _lines(p.main)
    text = main if len(main) >= max(LEAST_MAIN, MAIN_SHARE * len(body)) else body
    clean = lambda x: " ".join("".join(x).split())
    return {
        "title": clean(p.title),
        "text": text,
        "headings": [h for h in map(clean, p.headings) if h],
        "tables": [[[clean(c) for c in r] for r in t if r] for t in p.tables],
        "links": [{"href": h, "anchor": clean(a)} for h, a in p.links if h],
    }


PAGE_SQL = "title string, text string, headings array<string>, tables array<array<array<string>>>, links array<struct<href: string, anchor: string>>"
_PAGE = pa.schema([("title", pa.string()), ("text", pa.string()), ("headings", pa.list_(pa.string())), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("links", pa.list_(pa.struct([("href", pa.string()), ("anchor", pa.string())])))])


def read_html(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """``keep`` with each page's title, text, headings, tables and links; a null page gives nulls and empty lists."""
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", " + PAGE_SQL
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_page(t) if t else {"title": None, "text": None, "headings": [], "tables": [], "links": []} for t in b.column(n).to_pylist()]
            cols = [pa.array([r[f.name] for r in rows], f.type) for f in _PAGE]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], names=[*keep, *_PAGE.names])

    return pages.select(*keep, html).mapInArrow(run, schema)
