"""Extraction of result pages: one Arrow job turns pages into cells, DataFrames do the rest.

``read_pages`` and ``rows`` are the only places where Python sees a page. Every table of a page is listed, nested ones too,
and the text of a nested table is also text of the cell around it. ``cells`` has a row for each cell, ``rows`` one for each
table row with its cells, the headers of its table and the title of its page, so that nothing has to be gathered again; the
readings take either. Pages of plain tags are cut by one pattern, others go through the parser of the standard library. For
``rows``, a page that is one plain table is cut whole, and its rows lie in columns at once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resultmart.functions.arrays import zip_map
from resultmart.functions.text import blank_to_null, classify_role, clean_date, nation_code, split_title, to_float, to_int
from resultmart.operators.windows import carry_forward

CELLS = "doc_id string, kind string, table_no int, row_no int, row_class string, cell_no int, is_header boolean, text string, anchor string, after string, links array<struct<text:string,href:string,url:string>>"
_LINK = pa.struct([("text", pa.string()), ("href", pa.string()), ("url", pa.string())])
_CELLS = pa.schema([("doc_id", pa.string()), ("kind", pa.string()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("row_class", pa.string()), ("cell_no", pa.int32()), ("is_header", pa.bool_()), ("text", pa.string()), ("anchor", pa.string()), ("after", pa.string()), ("links", pa.list_(_LINK))])
#: Header texts and the names of their columns.
HEADERS = {"no.": "entry_no", "name": "name", "nat.": "nation", "nation": "nation", "club": "club", "fpl.": "place", "pl.": "place", "points": "points", "tss": "tss", "tes": "tes", "pcs": "pcs", "deduction": "deduction", "deductions": "deduction", "ded.": "deduction", "stn.": "start", "qual.": "qual", "function": "function", "category": "category", "segment": "segment", "date": "date", "time": "time", "reports": ""}
HEADINGS = {"title", "h1", "h2", "h3", "h4"}
ROWS = "doc_id string, title string, table_no int, row_no int, is_header boolean, headers array<string>, row array<struct<cell_no:int,is_header:boolean,text:string,anchor:string,after:string,links:array<struct<text:string,href:string,url:string>>>>"
#: A table row of cells with text and breaks alone, a tag whose attributes are quoted and hold no references, or text.
_PLAIN = re.compile(r'<tr>((?:<t[dh]>[^<]*(?:<br ?/?>[^<]*)*</t[dh]>)+)</tr>|<(/?)((?i:[a-z][a-z0-9]*))((?:[ \t\n\r\f]+(?i:[a-z-]+)="[^"<>&]*")*)[ \t\n\r\f]*(/?)>|([^<]+)')
_CELL = re.compile(r"<(t[dh])>([^<]*(?:<br ?/?>[^<]*)*)</t[dh]>")
_BREAK = re.compile(r"<br ?/?>")
_ATTRIBUTE = re.compile(r'([a-z-]+)="([^"]*)"', re.IGNORECASE)
#: A page of one table of such cells, whose rows hold headers alone or none; a match is never tried twice.
_TABLE = re.compile(r"<table>(?:<caption>((?:[^<]*+<h2>[^<]*+</h2>)*+)[^<]*+</caption>)?((?:<tr>(?:(?:<td>[^<]*+(?:<br ?/?>[^<]*+)*+</td>)++|(?:<th>[^<]*+(?:<br ?/?>[^<]*+)*+</th>)++)</tr>)*+)</table>")
_SECOND = re.compile(r"<h2>([^<]*)</h2>")
#: Tags whose content isn't read as tags.
_OPAQUE = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}


class _Page(HTMLParser):
    """Cells and headings of one page, in the order in which they begin."""

    def __init__(self, doc_id: str, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.doc_id, self.url, self.out, self.raw, self.gone = doc_id, url, [], [], 0  # raw: rows with texts as they came; gone: how many were handed over before the page ended
        self.tables: list[dict] = []  # the open ones, outermost first
        self.count, self.heading, self.link = 0, None, None

    def _table(self) -> dict:
        table = {"no": self.count, "row": -1, "class": "", "cell": None, "cells": 0}
        self.count += 1
        self.tables.append(table)
        return table

    def _close_link(self) -> None:
        self.link = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = dict(attrs)
        if tag == "table":
            self._table()
        elif tag == "tr":
            table = self.tables[-1] if self.tables else self._table()
            table.update(row=table["row"] + 1, cell=None, cells=0)
            table["class"] = held.get("class") or ""
        elif tag in ("td", "th") and self.tables:
            table = self.tables[-1]
            self._close_link()
            cell = {"doc_id": self.doc_id, "kind": "cell", "table_no": table["no"], "row_no": max(table["row"], 0), "row_class": held.get("class") or table["class"], "cell_no": table["cells"], "is_header": tag == "th", "text": "", "anchor": None, "after": "", "links": []}
            table.update(cell=cell, cells=table["cells"] + 1)
            self.out.append(cell)
            self.raw.append(cell)
        elif tag == "a":
            self._close_link()
            if held.get("href") or any(t["cell"] for t in self.tables):
                self.link = {"text": "", "href": held.get("href"), "url": urljoin(self.url, held["href"]) if held.get("href") else None}
                for table in self.tables:
                    if table["cell"]:
                        table["cell"]["links"].append(self.link)
        elif tag in HEADINGS:
            self.heading = {"doc_id": self.doc_id, "kind": tag, "table_no": self.tables[-1]["no"] if self.tables else -1, "row_no": -1, "row_class": "", "cell_no": self.gone + len(self.out), "is_header": False, "text": "", "anchor": None, "after": "", "links": []}
            self.out.append(self.heading)
            self.raw.append(self.heading)
        elif tag == "form" and held.get("action"):
            for table in self.tables:
                if table["cell"]:
                    table["cell"]["links"].append({"text": "form", "href": held["action"], "url": urljoin(self.url, held["action"])})
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.tables:
            self.tables.pop()
        elif tag == "a":
            self._close_link()
        elif tag in HEADINGS:
            self.heading = None
        elif tag in ("td", "th") and self.tables:
            self._close_link()
            self.tables[-1]["cell"] = None
        elif tag == "tr" and self.tables:
            self.tables[-1]["cell"] = None

    def handle_data(self, data: str) -> None:
        if self.heading is not None:
            self.heading["text"] += data
        if self.link is not None:
            self.link["text"] += data
        for table in self.tables:
            cell = table["cell"]
            if cell:
                cell["text"] += data
                if self.link is None and cell["links"]:
                    cell["after"] += data

    def feed_plain(self, text: str) -> Iterator[None]:
        """Read a page of plain tags as ``feed`` would, pausing after each table row; ``_Odd`` where it has other markup."""
        at = 0
        for m in _PLAIN.finditer(text):
            if m.start() != at:
                raise _Odd
            at = m.end()
            row, close, tag, attrs, both, data = m.groups()
            if row:
                if len(self.tables) != 1:
                    self._table_row(row)
                    yield
                    continue
                table = self.tables[0]
                table.update(row=table["row"] + 1, cell=None)
                table["class"], self.link = "", None
                texts = _head_texts(row) if row.startswith("<th>") else _texts(row)
                if self.heading is not None:
                    self.heading["text"] += "".join(_inside(x) for _, x in _CELL.findall(row))
                self.out += [{"doc_id": self.doc_id, "kind": "cell", "table_no": table["no"], "row_no": table["row"], "row_class": "", "cell_no": i, "is_header": head, "text": x, "anchor": None, "after": "", "links": ()} for i, (head, x) in enumerate(texts)]
                table["cells"] = len(texts)
                yield
            elif data:
                self.handle_data(unescape(data) if "&" in data else data)
            else:
                tag = tag.lower()
                if tag in _OPAQUE:
                    raise _Odd
                if close:
                    self.handle_endtag(tag)
                    if tag == "tr":
                        yield
                    continue
                self.handle_starttag(tag, [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else [])
                if both:
                    self.handle_endtag(tag)
        if at != len(text):
            raise _Odd

    def _table_row(self, row: str) -> None:
        """A row of cells with text and breaks alone, in or outside of other tables."""
        self.handle_starttag("tr", [])
        for cell, inside in _CELL.findall(row):
            self.handle_starttag(cell, [])
            self.handle_data(_inside(inside))
            self.handle_endtag(cell)
        self.handle_endtag("tr")

    def settled(self) -> bool:
        """Whether all rows but the last one of the open table are done."""
        return len(self.tables) <= 1 and self.heading is None and self.link is None and not any(t["cell"] for t in self.tables)

    def rows(self) -> list[dict]:
        for c in self.raw:
            links = [x | {"text": _clean(x["text"])} for x in c["links"]]
            c |= {"text": _clean(c["text"]), "after": _clean(c["after"]), "links": [x for x in links if x["text"] and x["href"]], "anchor": next((x["text"] for x in links if x["text"] and x["text"] != "form"), None)}
        self.raw = []
        return self.out

    def done(self) -> list[dict]:
        """The rows so far that are done, which are handed over; a table row that may go on stays."""
        self.rows()
        open_ = {(t["no"], max(t["row"], 0)) for t in self.tables}
        kept = [c for c in self.out if c["kind"] == "cell" and (c["table_no"], c["row_no"]) in open_]
        out = [c for c in self.out if not (c["kind"] == "cell" and (c["table_no"], c["row_no"]) in open_)]
        self.out, self.gone = kept, self.gone + len(out)
        return out


class _Odd(Exception):
    """A page has markup beyond plain tags."""


def _clean(x: str) -> str:
    return " ".join(x.replace("\xa0", " ").replace("�", " ").split())


def _inside(x: str) -> str:
    """The text of a cell with text and breaks alone."""
    x = _BREAK.sub(" ", x) if "<" in x else x
    return unescape(x) if "&" in x else x


def _texts(row: str) -> list[tuple[bool, str]]:
    """The cells of a row with text and breaks alone: whether it is a header, and its text."""
    return [(cell == "th", _clean(_inside(x))) for cell, x in _CELL.findall(row)]


_head_texts = functools.lru_cache(4096)(_texts)


#: Rows of pages that are gathered before they go on.
_ROWS = 20_000


def _text(body: str | bytes | None) -> str:
    return body.decode("windows-1252", "replace") if isinstance(body, bytes) else body or ""


def _parts(doc_id: str | None, body: str | bytes | None, part: int) -> Iterator[list[dict]]:
    """The rows of a page in parts of some ``part`` rows that hold whole table rows; the last part may be larger."""
    text = _text(body)
    page = _Page(doc_id, doc_id or "")
    for _ in page.feed_plain(text):
        if len(page.out) >= part and page.settled():
            yield page.done()
    yield page.rows()


def _parsed(doc_id: str | None, body: str | bytes | None, part: int) -> Iterator[list[dict]]:
    """``_parts`` of a page with any markup."""
    text, step = _text(body), 64 * part
    page = _Page(doc_id, doc_id or "")
    for i in range(0, len(text), step):
        page.feed(text[i : i + step])
        if len(page.out) >= part and page.settled():
            yield page.done()
    page.close()
    yield page.rows()


def _page_parts(doc_id: str | None, body: str | bytes | None, pack, part: int) -> list:
    """The packed parts of a page, or one row that says why it can't be read; the others are read whatever it holds."""
    try:
        try:
            return [pack(x) for x in _parts(doc_id, body, part)]
        except _Odd:
            return [pack(x) for x in _parsed(doc_id, body, part)]
    except (ValueError, AssertionError, RecursionError) as error:
        return [[{"doc_id": doc_id, "kind": "error", "text": f"{type(error).__name__}: {error}"[:1000]}]]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = lambda held: pa.RecordBatch.from_pylist(held, schema=_CELLS)
    for b in batches:
        held: list[dict] = []
        for doc_id, body in zip(b.column(0), b.column(1), strict=True):
            # a large page is held as Arrow batches until it is known that all of it can be read
            for part in _page_parts(doc_id.as_py(), body.as_py(), lambda x: batch(x) if len(x) >= _ROWS else x, _ROWS):
                if isinstance(part, pa.RecordBatch):
                    yield part
                else:
                    held += part
            if len(held) >= _ROWS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


@functools.lru_cache(4096)
def _header_name(text: str) -> str:
    """As ``_header``."""
    text = re.sub(r"[=+\-]\s*\Z", "", text).strip(" ")
    return HEADERS.get(text.lower(), text)


class _Packed:
    """Table rows of a page, or of a part of one: their places in columns, their cells in an Arrow array or a list."""

    def __init__(self, cells_: list[dict]) -> None:
        by: dict[tuple[int, int], list[dict]] = {}
        self.caption, self.seconds = None, []
        at, row = None, []
        for c in cells_:
            if c["kind"] == "cell":
                if (c["table_no"], c["row_no"]) != at:
                    at = (c["table_no"], c["row_no"])
                    row = by.setdefault(at, [])
                row.append(c)
                if c["row_class"] == "caption2" and c["text"]:
                    caption = (c["table_no"], c["row_no"], c["cell_no"], c["text"])
                    self.caption = min(self.caption or caption, caption)
            elif c["kind"] == "h2" and c["text"]:
                self.seconds.append(c["text"])
        for row in by.values():
            if row[-1]["cell_no"] != len(row) - 1:  # cells before the first row of a table count as its own
                row.sort(key=lambda c: (c["cell_no"], c["is_header"], c["text"]))
        self.places = list(by)
        self.heads = [all(c["is_header"] for c in x) for x in by.values()]
        self.names = {k: [_header_name(c["text"]) for c in x] for (k, x), head in zip(by.items(), self.heads, strict=True) if head}
        rows = list(by.values())
        self.rows = _row_array(rows) if len(cells_) >= _ROWS else rows


def _row_array(rows: list[list[dict]]) -> pa.Array:
    """Lists of cells as an array of ``ROWS``' last type, column by column."""
    flat = [c for row in rows for c in row]
    links = [x for c in flat for x in c["links"]]
    link = pa.StructArray.from_arrays([pa.array([x[k] for x in links], pa.string()) for k in ("text", "href", "url")], fields=list(_LINK))
    ends = lambda sizes: pa.array(list(_ends(sizes)), pa.int32())
    columns = [pa.array([c[k] for c in flat], kind) for k, kind in (("cell_no", pa.int32()), ("is_header", pa.bool_()), ("text", pa.string()), ("anchor", pa.string()), ("after", pa.string()))]
    columns.append(pa.ListArray.from_arrays(ends(len(c["links"]) for c in flat), link))
    return pa.ListArray.from_arrays(ends(map(len, rows)), pa.StructArray.from_arrays(columns, names=["cell_no", "is_header", "text", "anchor", "after", "links"]))


def _ends(sizes: Iterator[int]) -> Iterator[int]:
    total = 0
    yield total
    for n in sizes:
        total += n
        yield total


def _row_batch(held: list[tuple[str | None, str | None, dict, _Packed]], array: pa.Array) -> pa.RecordBatch:
    places = [(doc_id, title, t, r, headers.get(t)) for doc_id, title, headers, p in held for t, r in p.places]
    doc_ids, titles_, tables, numbers, names = zip(*places, strict=True)
    columns = [pa.array(doc_ids, pa.string()), pa.array(titles_, pa.string()), pa.array(tables, pa.int32()), pa.array(numbers, pa.int32()), pa.array([x for *_, p in held for x in p.heads], pa.bool_()), pa.array(names, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*columns, array], names=["doc_id", "title", "table_no", "row_no", "is_header", "headers", "row"])


def _plain_row(row: str) -> list[str]:
    """The texts of a row of cells that are no headers, given without its own tags."""
    texts = row[4:-5].split("</td><td>")
    if "&" in row or "<br" in row or "\xa0" in row or "�" in row:
        return [_clean(_inside(x)) for x in texts]
    if "> " not in row and " <" not in row and " ".join(row.split()) == row:
        return texts
    return [" ".join(x.split()) for x in texts]


@functools.lru_cache(4096)
def _plain_heads(row: str) -> tuple[list[str], tuple[str, ...]]:
    """The texts of a row of headers, and the names of its columns."""
    texts = [_clean(_inside(x)) for x in row[4:-5].split("</th><th>")]
    return texts, tuple(map(_header_name, texts))


class _Plain:
    """Table rows of pages of one plain table, column by column."""

    def __init__(self) -> None:
        self.pages: list[tuple[str | None, str | None, int, int]] = []  # with the number of its headers and of its rows
        self.headers: dict[tuple[str, ...] | None, int] = {None: 0}
        self.heads: list[bool] = []
        self.sizes: list[int] = []
        self.texts: list[str] = []

    def add(self, doc_id: str | None, text: str) -> bool:
        """Whether the page is of that kind, and not so large that it has to be read in parts."""
        m = _TABLE.fullmatch(text) if len(text) <= 64 * _ROWS else None
        if not m:
            return False
        if not m[2]:
            return True
        try:
            rows_ = [(True, *_plain_heads(x)) if x.startswith("<th>") else (False, _plain_row(x), None) for x in m[2][4:-5].split("</tr><tr>")]
            seconds = [x for x in (_clean(_inside(x)) for x in _SECOND.findall(m[1] or "")) if x]
        except ValueError:
            return False
        names = next((x for head, _, x in rows_ if head), None)
        self.pages.append((doc_id, seconds[1] if len(seconds) > 1 else None, self.headers.setdefault(names, len(self.headers)), len(rows_)))
        for head, texts, _ in rows_:
            self.heads.append(head)
            self.sizes.append(len(texts))
            self.texts += texts
        return True

    def batch(self) -> pa.RecordBatch:
        doc_ids, titles_, names, n = zip(*self.pages, strict=True)
        page, sizes, total = np.repeat(np.arange(len(n)), n), np.array(self.sizes), len(self.texts)
        of_page = lambda values, kind: pa.array(values, kind).take(pa.array(page))
        starts = lambda counts: np.repeat(np.cumsum(counts) - counts, counts)
        headers = pa.array([x and list(x) for x in self.headers], pa.list_(pa.string())).take(of_page(names, pa.int32()))
        heads = np.array(self.heads)
        link = pa.StructArray.from_arrays([pa.nulls(0, pa.string())] * 3, fields=list(_LINK))
        cells_ = [pa.array(np.arange(total) - starts(sizes), pa.int32()), pa.array(np.repeat(heads, sizes)), pa.array(self.texts, pa.string()), pa.nulls(total, pa.string()), pa.repeat(pa.scalar("", pa.string()), total), pa.ListArray.from_arrays(pa.array(np.zeros(total + 1), pa.int32()), link)]
        row = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(cells_, names=["cell_no", "is_header", "text", "anchor", "after", "links"]))
        columns = [of_page(doc_ids, pa.string()), of_page(titles_, pa.string()), pa.array(np.zeros(len(page)), pa.int32()), pa.array(np.arange(len(page)) - starts(np.array(n)), pa.int32()), pa.array(heads), headers, row]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "title", "table_no", "row_no", "is_header", "headers", "row"])


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        plain = _Plain()
        held: list[tuple[str | None, str | None, dict, _Packed]] = []
        n = 0
        for doc_id, body in zip(b.column(0), b.column(1), strict=True):
            text = _text(body.as_py())
            if plain.add(doc_id.as_py(), text):
                if len(plain.texts) >= _ROWS:
                    yield plain.batch()
                    plain = _Plain()
                continue
            parts = [x for x in _page_parts(doc_id.as_py(), text, _Packed, _ROWS) if isinstance(x, _Packed)]
            seconds = [x for p in parts for x in p.seconds]
            captions = [p.caption for p in parts if p.caption]
            title = min(captions)[3] if captions else seconds[1] if len(seconds) > 1 else None
            first: dict[int, tuple[int, list[str]]] = {}
            for p in parts:
                for (t, r), names in p.names.items():
                    first[t] = min(first.get(t, (r, names)), (r, names))
            headers = {t: names for t, (_, names) in first.items()}
            for p in parts:
                if not p.places:
                    continue
                page = (doc_id.as_py(), title, headers, p)
                if isinstance(p.rows, pa.Array):
                    yield _row_batch([page], p.rows)
                else:
                    held.append(page)
                    n += sum(map(len, p.rows))
            if n >= _ROWS:
                yield _row_batch(held, _row_array([x for *_, p in held for x in p.rows]))
                held, n = [], 0
        if held:
            yield _row_batch(held, _row_array([x for *_, p in held for x in p.rows]))
        if plain.pages:
            yield plain.batch()


def rows(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """A row for each table row of the pages that can be read, whose URLs are unique: the title of its page, the headers of its table (null: none), its cells.

    The readings below take it in place of ``cells``; then no cell is sent anywhere.
    """
    return documents.select(F.col(url).cast("string"), body).mapInArrow(_read_rows, ROWS)


def read_pages(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Cells and headings of pages, and a row of kind ``error`` with the reason for each page that can't be read.

    Bytes are read as windows-1252, and links are resolved against the page's URL.
    """
    return documents.select(F.col(url).cast("string"), body).mapInArrow(_read, CELLS)


def cells(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Cells and headings of the pages that can be read."""
    return read_pages(documents, url, body).where("kind <> 'error'")


def page_issues(read: DataFrame, code: Column | str = "index_page_parse_failed") -> DataFrame:
    """(code, message, url) of the pages of ``read_pages`` that can't be read."""
    return read.where("kind = 'error'").select((F.lit(code) if isinstance(code, str) else code).alias("code"), F.col("text").alias("message"), F.col("doc_id").alias("url"))


def route(documents: DataFrame, url: str = "url") -> DataFrame:
    """Add page_type by the shape of the file name."""
    u = F.upper(F.regexp_replace(F.col(url), r"[?#].*$", ""))
    kind = (
        F.when(u.rlike(r"CAT\d+EN\.HTML?\z"), "entries").when(u.rlike(r"CAT\d+RS\.HTML?\z"), "category_result").when(u.rlike(r"SEG\d+OF\.HTML?\z"), "officials")
        .when(u.rlike(r"SEG\d+\.HTML?\z"), "segment_result").when(u.endswith(".PDF"), "score_sheet").otherwise("index")
    )
    return documents.withColumn("page_type", kind)


def _header(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, r"[=+\-]\s*\z", ""))
    known = F.create_map(*[F.lit(x) for pair in HEADERS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(c)), c)


def table_rows(cells_: DataFrame) -> DataFrame:
    """One row for each table row below headers: headers (names of the columns) and row (cells); of ``rows`` also the page's title."""
    if "row" in cells_.columns:
        return cells_.where("NOT is_header AND headers IS NOT NULL").drop("is_header")
    cell = F.struct("cell_no", "is_header", "text", "anchor", "after", "links")
    rows = cells_.where("kind = 'cell'").groupBy("doc_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(cell)).alias("row"), F.max("row_class").alias("row_class"), F.min("is_header").alias("is_header"))
    heads = rows.where("is_header").groupBy("doc_id", "table_no").agg(F.min_by(F.transform("row", lambda x: _header(x.text)), "row_no").alias("headers"))
    return rows.where("NOT is_header").join(heads, ["doc_id", "table_no"]).select("doc_id", "table_no", "row_no", "headers", "row")


def header_map(cells_: DataFrame) -> DataFrame:
    """The tables' headers: doc_id, table_no, headers."""
    return table_rows(cells_).groupBy("doc_id", "table_no").agg(F.first("headers").alias("headers"))


def cell(name: str, part: str = "text") -> Column:
    """The cell under a header, null where the table has none."""
    place = F.array_position("headers", name).cast("int")
    return F.when(place > 0, F.get(F.col("row"), place - 1)[part])


def _tables(cells_: DataFrame, *names: str) -> DataFrame:
    """Rows of the innermost tables with these headers and as many cells as have to be there."""
    return table_rows(cells_).where(F.size(F.array_except(F.array(*map(F.lit, names)), F.col("headers"))) == 0)


def titles(cells_: DataFrame) -> DataFrame:
    """doc_id and title: the text of the page's caption row, else of its second heading."""
    caption = cells_.where("kind = 'cell' AND row_class = 'caption2' AND text <> ''").groupBy("doc_id").agg(F.min_by("text", F.struct("table_no", "row_no", "cell_no")).alias("caption"))
    second = cells_.where("kind = 'h2' AND text <> ''").groupBy("doc_id").agg(F.get(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), F.lit(1))["text"].alias("second"))
    return caption.join(second, "doc_id", "full").select("doc_id", F.coalesce("caption", "second").alias("title"))


def source_id(href: Column) -> Column:
    return F.when(href.rlike(r"/bios/(isufs\d+)\.htm"), F.regexp_extract(href, r"/bios/(isufs\d+)\.htm", 1))


def _who() -> dict[str, Column]:
    """Name (the link's text where there is one), affiliations and the id behind the link."""
    name = F.coalesce(cell("name", "anchor"), cell("name"))
    href = F.get(cell("name", "links"), F.lit(0))["href"]
    return {"name": name, "club": cell("club"), "nation": F.coalesce(nation_code(cell("nation")), cell("nation")), "source_skater_id": source_id(href)}


def _titled(rows: DataFrame, cells_: DataFrame) -> DataFrame:
    parts = split_title(F.col("title"))
    titled = rows if "title" in rows.columns else rows.join(titles(cells_), "doc_id", "left")
    return titled.withColumns({"category": parts["category"], "segment": parts["segment"]}).drop("title")


def _page(rows: DataFrame) -> list[str]:
    """What rows know of their page."""
    return [c for c in ("doc_id", "title") if c in rows.columns]


def entry_rows(cells_: DataFrame) -> DataFrame:
    rows = _tables(cells_, "entry_no", "name").where(F.coalesce(cell("name"), F.lit("")) != "")
    return _titled(rows.select(*_page(rows), "row_no", to_int(cell("entry_no")).alias("entry_no"), *[c.alias(n) for n, c in _who().items()]), cells_)


def category_result_rows(cells_: DataFrame) -> DataFrame:
    """Final places; columns after the points are places in segments."""
    rows = _tables(cells_, "place", "name", "points").where(F.coalesce(cell("name"), F.lit("")) != "")
    at = F.array_position("headers", "points").cast("int")
    texts = F.transform("row", lambda x: x.text)
    places = zip_map(F.slice("headers", at + 1, F.greatest(F.size("headers") - at, F.lit(0))), F.slice(texts, at + 1, F.greatest(F.size("row") - at, F.lit(0))))
    places = F.map_filter(F.transform_values(places, lambda _, v: to_int(v)), lambda _, v: v.isNotNull())
    return _titled(rows.select(*_page(rows), "row_no", to_int(cell("place")).alias("final_place"), *[c.alias(n) for n, c in _who().items()], to_float(cell("points")).alias("points"), places.alias("segment_places")), cells_)


def segment_result_rows(cells_: DataFrame) -> DataFrame:
    """Segment scores; columns between the component sum and the deduction are components. Short rows are left out."""
    rows = _tables(cells_, "place", "name", "tss").where(F.size("row") >= F.size("headers"))
    # columns of their own, so that they are found once
    rows = rows.withColumns({"a": F.array_position("headers", "pcs").cast("int"), "z": F.array_position("headers", "deduction").cast("int")})
    a, n = F.col("a"), F.greatest(F.col("z") - F.col("a") - 1, F.lit(0))
    rows = rows.withColumns({"part_names": F.transform(F.slice("headers", a + 1, n), F.lower), "part_texts": F.transform(F.slice("row", a + 1, n), lambda x: x.text)})
    parts = zip_map(F.col("part_names"), F.col("part_texts"))
    parts = F.map_filter(F.transform_values(parts, lambda _, v: to_float(v)), lambda _, v: v.isNotNull())
    scores = [to_float(cell(c)).alias(c) for c in ("tss", "tes", "pcs", "deduction")]
    club = blank_to_null(F.when(cell("name", "anchor").isNotNull(), cell("name", "after")))
    return _titled(rows.select(*_page(rows), "row_no", to_int(cell("place")).alias("place"), *[c.alias(n) for n, c in _who().items()], club.alias("club_display_name"), *scores, parts.alias("components"), to_int(cell("start")).alias("starting_number"), cell("qual").alias("qualification")), cells_)


def official_rows(cells_: DataFrame) -> DataFrame:
    rows = _tables(cells_, "function", "name").where((F.coalesce(cell("function"), F.lit("")) != "") & (F.coalesce(cell("name"), F.lit("")) != ""))
    role = classify_role(cell("function"))
    out = rows.select(*_page(rows), "row_no", cell("function").alias("function"), role["role_group"].alias("role_group"), role["judge_number"].alias("judge_number"), cell("name").alias("name"), cell("nation").alias("nation"))
    first = out.groupBy(*_page(out), "function", "role_group", "judge_number", "name", "nation").agg(F.min("row_no").alias("row_no"))
    return _titled(first.select(out.columns), cells_)


def _link(links: Column, test) -> Column:
    return F.get(F.filter(links, test), F.lit(0))


def index_rows(cells_: DataFrame) -> DataFrame:
    """Categories and segments of index pages with their links.

    A row that names a category opens it; rows after it without one are its segments. A table of categories whose rows
    have a name and one link lists results only, as PDF.
    """
    rows = _tables(cells_, "category").where(~F.array_contains("headers", "date"))
    links = F.flatten(F.transform("row", lambda x: x.links))
    named = blank_to_null(cell("category"))
    held = carry_forward(rows.withColumns({"named": named, "links": links, "segment_name": blank_to_null(cell("segment"))}), ["doc_id", "table_no"], ["row_no"], F.col("named"), "category")
    held = held.where(F.col("category").isNotNull() & (F.col("named").isNotNull() | F.col("segment_name").isNotNull()))
    text = lambda x: F.lower(x.text)
    pdf_only = F.col("named").isNotNull() & (F.size("headers") <= 2)
    sheets = F.filter("links", lambda x: F.lower(x.href).endswith(".pdf"))
    sheet = F.coalesce(_link(F.col("links"), lambda x: text(x).contains("judges scores")), F.when(F.col("named").isNull(), F.get(sheets, F.lit(0))))
    kind = F.when(F.col("named").isNotNull() & F.col("segment_name").isNull(), "category").otherwise("segment")
    out = {
        "kind": kind, "segment": F.col("segment_name"), "source_shape": F.when(pdf_only, "category_result_pdf_only").otherwise("full"),
        "entries": _link(F.col("links"), lambda x: text(x).contains("entries")), "result": F.when(kind == "category", _link(F.col("links"), lambda x: text(x).contains("result") & ~text(x).contains("detail"))),
        "officials": _link(F.col("links"), lambda x: text(x).contains("officials") | text(x).contains("panel")), "details": _link(F.col("links"), lambda x: text(x).contains("detail")), "judges_scores": F.when(kind == "segment", sheet),
    }
    return held.select("doc_id", "table_no", "row_no", "category", *[c.alias(n) for n, c in out.items()])


def schedule_rows(cells_: DataFrame) -> DataFrame:
    """Scheduled segments; a row with a date alone holds for the rows after it."""
    rows = _tables(cells_, "date", "time", "category", "segment")
    text = lambda i: F.get(F.col("row"), F.lit(i))["text"]
    rows = carry_forward(rows, ["doc_id", "table_no"], ["row_no"], blank_to_null(text(0)), "day").where(F.coalesce(text(1), F.lit("")) != "")
    return rows.select("doc_id", "row_no", clean_date(F.regexp_replace("day", r"[^\d./ -]", "")).alias("date"), text(1).alias("time"), text(2).alias("category"), text(3).alias("segment"), F.get(F.get(F.col("row"), F.lit(3))["links"], F.lit(0))["href"].alias("href"))


def event_rows(cells_: DataFrame) -> DataFrame:
    """Name, location, dates and venue from the headings of an index page, or from its captions in the newer layout."""
    heads = cells_.where("kind IN ('h2', 'h3') AND table_no = -1 AND text <> ''").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda x: x.text).alias("heads"))
    title = cells_.where("kind = 'title'").groupBy("doc_id").agg(F.first("text").alias("title"))
    captions = cells_.where("kind = 'cell' AND row_class LIKE 'caption%' AND text <> ''").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "row_no", "cell_no", "text"))), lambda x: x.text).alias("captions"))
    out = title.join(heads, "doc_id", "left").join(captions, "doc_id", "left")
    texts = F.coalesce("heads", F.array()).cast("array<string>")
    every = F.concat(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), F.coalesce("captions", F.array().cast("array<string>")))
    dated = r"\d{1,2}[./]\d{1,2}[./]?\d{0,4}.*\d{4}"
    date = F.get(F.filter(every, lambda x: x.rlike(dated)), F.lit(0))
    rest = F.filter(every, lambda x: ~x.rlike(dated))
    return out.select("doc_id", F.coalesce(F.get(texts, F.lit(0)), "title").alias("name"), F.get(rest, F.lit(0)).alias("location"), F.get(rest, F.lit(1)).alias("venue"), clean_date(F.regexp_replace(date, r"[^\d./ –-]", "")).alias("date_range"))


def catalog_rows(documents: DataFrame, discipline: str = "FIGURE SKATING", detail: str = "/eventdetail/", url: str = "url", body: str = "body") -> DataFrame:
    """Events of a listing: a line with dates, then name, place and discipline; each with the detail link of its number."""
    text = F.regexp_replace(F.col(body).cast("string"), r"(?is)<script.*?</script>", " ")
    parts = F.filter(F.transform(F.split(text, "<[^>]*>"), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    lines = documents.select(F.col(url).alias("doc_id"), F.posexplode(parts).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    months = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    rows = lines.select("doc_id", "line_no", F.col("line").alias("date_range"), F.lead("line", 1).over(w).alias("event_name"), F.lead("line", 2).over(w).alias("place"), F.lead("line", 3).over(w).alias("discipline"))
    rows = rows.where(F.col("date_range").rlike(rf"^\d{{1,2}} {months}.* \d{{4}}\z") & (F.upper("discipline") == discipline))
    first = rows.groupBy("doc_id", "event_name", "date_range", "place").agg(F.min("line_no").alias("line_no"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    found = documents.select(F.col(url).alias("doc_id"), F.posexplode(F.array_distinct(F.regexp_extract_all(F.col(body).cast("string"), F.lit(rf'href="([^"]*{detail}[^"]*)"'), F.lit(1)))).alias("n", "detail_url")).withColumn("n", F.col("n") + 1)
    place = F.split("place", " / ", 2)
    return numbered.join(found, ["doc_id", "n"], "left").select("doc_id", "event_name", "date_range", F.get(place, F.lit(0)).alias("city"), F.get(place, F.lit(1)).alias("country_code"), "detail_url")


def detail_rows(documents: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Fields of event pages from the JSON they carry, else the result link by its label."""
    from resultmart.functions.arrays import first_json_string, slice_between

    raw = F.col(body).cast("string")
    info = F.coalesce(slice_between(raw, "pageinfos", "eventdatas"), raw)
    field = lambda name: first_json_string(info, name)
    anchor = F.regexp_extract(raw, r'(?is)<a[^>]*href="([^"]+)"[^>]*>[^<]*results?[^<]*</a>', 1)
    result = F.coalesce(field("detail_result_url"), F.nullif(anchor, F.lit("")))
    out = documents.select(F.col(url).alias("detail_url"), field("name").alias("event_name"), field("display_date").alias("date_range"), field("city").alias("city"), field("country_code").alias("country_code"), field("discipline_title").alias("discipline"), result.alias("result_url"))
    return out.withColumn("discovery_status", F.when(F.col("result_url").isNotNull(), "candidate_result_url").otherwise("catalog_only_needs_result_url"))
