"""HTML text to an array of page elements, inside an Arrow UDF.

Python only tokenises. Which element holds the title, date or body is decided by column
expressions in ``rotativa.operators.articles``, so only the HTML column crosses to Python.

``texts`` holds the text nodes of an element: stripped and without empty ones, but as they are
for ``h2``, ``script`` and article bodies. ``inside`` holds the positions of the elements around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rotativa.functions.text import as_col

ELEMENT_DDL = (
    "struct<pos:int,tag:string,css:array<string>,name:string,property:string,type:string,content:string,href:string,"
    "label:string,datetime:string,texts:array<string>,inside:array<int>>"
)
PAGE_DDL = f"struct<elements:array<{ELEMENT_DDL}>,error:string>"

_ARROW_PAGE = pa.struct(
    [
        (
            "elements",
            pa.list_(
                pa.struct(
                    [
                        ("pos", pa.int32()),
                        ("tag", pa.string()),
                        ("css", pa.list_(pa.string())),
                        ("name", pa.string()),
                        ("property", pa.string()),
                        ("type", pa.string()),
                        ("content", pa.string()),
                        ("href", pa.string()),
                        ("label", pa.string()),
                        ("datetime", pa.string()),
                        ("texts", pa.list_(pa.string())),
                        ("inside", pa.list_(pa.int32())),
                    ]
                )
            ),
        ),
        ("error", pa.string()),
    ]
)

# Pages whose elements are held at once.
PAGES = 64

_STRIPPED = {"title", "h1", "time", "p", "a", "span"}
_AS_IS = {"h2", "script"}
_KEPT = _STRIPPED | _AS_IS | {"meta", "article", "div"}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = {"div", "article", "section", "li", "td", "body", "blockquote", "aside", "footer"}


class _ElementReader(HTMLParser):
    """Collects the kept elements with their own text nodes and the kept elements around them."""

    def __init__(self, nest_paragraphs: bool):
        super().__init__(convert_charrefs=True)
        self.nest_paragraphs = nest_paragraphs
        self.rows: list[dict] = []
        self.stack: list[tuple[str, dict | None]] = []
        self.pending: list[str] = []

    def flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending.clear()
        if self.stack and self.stack[-1][0] in ("script", "style"):
            owners = self.stack[-1:]
        else:
            owners = self.stack
        stripped = text.strip()
        for tag, row in owners:
            if row is None or row["texts"] is None:
                continue
            if tag not in _STRIPPED:
                row["texts"].append(text)
            elif stripped:
                row["texts"].append(stripped)

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag == "p" and not self.nest_paragraphs:
            self._close_paragraph()
        row = self._row(tag, dict(attrs)) if tag in _KEPT else None
        if row is not None:
            self.rows.append(row)
        if tag not in _VOID:
            self.stack.append((tag, row))

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                del self.stack[depth:]
                return

    def _close_paragraph(self) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == "p":
                del self.stack[depth:]
                return
            if self.stack[depth][0] in _BLOCKS:
                return

    def _row(self, tag: str, attrs: dict) -> dict:
        css = (attrs.get("class") or "").split()
        keeps_text = tag in _STRIPPED | _AS_IS or (tag == "article" and "article-body" in css)
        return {
            "pos": len(self.rows),
            "tag": tag,
            "css": css,
            "name": attrs.get("name"),
            "property": attrs.get("property"),
            "type": attrs.get("type"),
            "content": attrs.get("content"),
            "href": attrs.get("href"),
            "label": attrs.get("aria-label"),
            "datetime": attrs.get("datetime"),
            "texts": [] if keeps_text else None,
            "inside": [row["pos"] for _, row in self.stack if row is not None],
        }


def _read_page(html: str | None, nest_paragraphs: bool) -> dict | None:
    if html is None:
        return None
    try:
        reader = _ElementReader(nest_paragraphs)
        reader.feed(html)
        reader.close()
        reader.flush()
        return {"elements": reader.rows, "error": None}
    except Exception as error:  # one bad page must not stop the job
        return {"elements": [], "error": f"{type(error).__name__}: {error}"}


def _read_batches(batches: Iterator[pa.Array], nest_paragraphs: bool) -> Iterator[pa.Array]:
    # Elements of a few pages only are held as Python objects, whatever the session's batch size.
    for batch in batches:
        for at in range(0, len(batch), PAGES):
            yield pa.array([_read_page(page.as_py(), nest_paragraphs) for page in batch.slice(at, PAGES)], type=_ARROW_PAGE)


def page_elements(html: Column | str, nest_paragraphs: bool = False) -> Column:
    """Struct of ``elements`` and ``error`` for a column of HTML text.

    An unclosed ``<p>`` ends at the next ``<p>``, or with ``nest_paragraphs`` at the end of the
    enclosing element, the two ways lenient parsers read it.
    """

    @F.arrow_udf(PAGE_DDL)
    def read_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _read_batches(batches, nest_paragraphs)

    # Otherwise a filter on the result is pushed below the projection and reads every page twice.
    return read_pages.asNondeterministic()(as_col(html))
