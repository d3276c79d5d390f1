"""Visible text of HTML pages, laid out.

A page becomes a tree: void elements hold nothing, and the start of a block closes an open paragraph, an item the item before it, a
cell or row the one before it, as authors leave those end tags out. What a browser wouldn't show is skipped: the head,
scripts, styles, templates, and elements that are ``hidden``, or styled ``display: none`` or ``visibility: hidden`` by attribute or by the
cascade of the page's own style sheets on a screen (``style_sheets``). All other text is emitted in the order of the page. White space collapses as in a
browser except in ``pre``; blocks stand on lines of their own, with an empty line around paragraphs, headings, lists and tables;
items are marked or numbered and indented; the cells of a table are aligned in columns.

Defined results: a null page has a null text; an empty page, or one without visible text, an empty one. Elements nested deeper than
``DEPTH`` are laid out as parts of the element at that depth, and cells are padded to ``ALIGN`` characters at most; no text is lost by either.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sitegrain.llm.common import bytes_of, own_columns, slices
from sitegrain.llm.style_sheets import drop_unshown

DEPTH, ALIGN = 200, 60

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript noframes noembed iframe object audio video canvas datalist param rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
#: What an element's start closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
#: Elements that start the body where its tag is left out.
IN_HEAD = frozenset("head html title meta link base script style template noscript".split())

_CLOSING = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape((m[2] or "").strip("\"'"))
        return None


def tree(page: str) -> Element:
    """The page's elements and texts below one root."""
    root = Element("#root")
    stack, at = [root], 0

    def text(s: str) -> None:
        if s:
            if len(stack) > 1 and any(e.tag == "head" for e in stack) and s.strip():
                close({"head"}, {"html"})
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    def close(tags: set[str] | frozenset[str], limit: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                # a row closes its cell and itself
                close(tags, limit)
                return
            if stack[i].tag in limit:
                return

    while m := _MARKUP.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag not in IN_HEAD and any(e.tag == "head" for e in stack[:3]):
            close({"head"}, {"html"})
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "li", "dd", "dt", "div", "section", "article", "blockquote"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        element = Element(tag, m[3])
        stack[-1].children.append(element)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            closing = _CLOSING[tag].search(page, at)
            end = closing.start() if closing else len(page)
            body = page[at:end]
            element.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            stop = page.find(">", end)
            at = len(page) if stop < 0 else stop + 1
        elif len(stack) <= DEPTH:
            stack.append(element)
    text(page[at:])
    return root


class Layout:
    """Lines of blocks, one after another."""

    def __init__(self) -> None:
        self.lines, self.inline, self.gap = [], [], 0

    def seen(self, e: Element) -> bool:
        return e.tag not in UNSEEN and e.tag != "input"

    def flush(self) -> None:
        if self.inline:
            for line in "".join(self.inline).split("\0"):
                self.put([_BLANK.sub(" ", line).strip(" ")])
            self.inline = []

    def put(self, lines: list[str]) -> None:
        if any(lines):
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.extend(lines)

    def space(self, n: int) -> None:
        self.flush()
        self.gap = max(self.gap, n)

    def inside(self, e: Element, pre: bool = False) -> list[str]:
        """Lines of an element's content by itself."""
        own = Layout()
        own.walk(e, pre)
        own.flush()
        return own.lines

    def walk(self, e: Element, pre: bool = False) -> None:
        for child in e.children:
            if isinstance(child, str):
                if pre:
                    first, *more = child.replace("\0", "").split("\n")
                    self.inline.append(first)
                    for line in more:
                        self.put_raw()
                        self.inline.append(line)
                else:
                    self.inline.append(child.replace("\0", ""))
            elif self.seen(child):
                self.element(child, pre)

    def put_raw(self) -> None:
        line, self.inline = "".join(self.inline), []
        if self.lines and line:
            self.lines.extend([""] * self.gap)
        self.gap = 0 if line else self.gap
        if line or self.lines:
            self.lines.append(line)

    def element(self, e: Element, pre: bool) -> None:
        tag = e.tag
        if tag == "br":
            self.put_raw() if pre else self.inline.append("\0")
        elif tag == "table":
            self.space(1)
            self.put(self.table(e))
            self.gap = 1
        elif tag in ("ul", "ol", "menu", "dir"):
            self.space(0 if self.nested else 1)
            self.put(self.items(e))
            self.gap = max(self.gap, 0 if self.nested else 1)
        elif tag == "pre":
            self.space(1)
            own = Layout()
            own.walk(e, True)
            own.put_raw()
            while own.lines and not own.lines[-1]:
                own.lines.pop()
            self.put([x.rstrip() for x in own.lines])
            self.gap = 1
        elif tag in BLOCK:
            self.space(int(tag in SPACED))
            if tag == "li":
                self.put(self.item("- ", e))
            elif tag in ("dd", "blockquote"):
                self.put([f"  {x}".rstrip() for x in self.inside(e, pre)])
            else:
                self.walk(e, pre)
            self.space(int(tag in SPACED))
        else:
            self.walk(e, pre)

    nested = False

    def item(self, mark: str, e: Element) -> list[str]:
        own = Layout()
        own.nested = True
        own.walk(e)
        own.flush()
        return [(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(own.lines)]

    def items(self, e: Element) -> list[str]:
        out: list[str] = []
        start = (e.attribute("start") or "1").strip() if e.tag == "ol" else ""
        number = int(start) if re.fullmatch("-?[0-9]{1,9}", start) else 1
        for child in e.children:
            if isinstance(child, Element) and self.seen(child):
                if child.tag == "li":
                    out += self.item(f"{number}. " if e.tag == "ol" else "- ", child)
                    number += 1
                else:
                    holder = Element("div")
                    holder.children = [child]
                    out += [f"  {x}".rstrip() for x in self.inside(holder)]
            elif isinstance(child, str) and child.strip():
                out.append(_BLANK.sub(" ", child).strip())
        return out

    def table(self, e: Element) -> list[str]:
        """A caption, then rows whose cells start at the same place in each line."""
        before: list[str] = []
        rows: list[list[tuple[int, int, list[str]]]] = []
        taken: dict[int, int] = {}
        waiting = [*reversed(e.children)]
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                before += [_BLANK.sub(" ", part).strip()] if part.strip() else []
            elif not self.seen(part) or part.tag in ("col", "colgroup"):
                continue
            elif part.tag in ("thead", "tbody", "tfoot"):
                waiting.extend(reversed(part.children))
            elif part.tag == "tr":
                row, column = [], 0
                for cell in part.children:
                    if isinstance(cell, str) and not cell.strip() or isinstance(cell, Element) and not self.seen(cell):
                        continue
                    if isinstance(cell, str) or cell.tag not in ("td", "th"):
                        holder = Element("td")
                        holder.children = [cell]
                        cell = holder
                    while taken.get(column, 0) > 0:
                        column += 1
                    spans = [int(s) if s and re.fullmatch("[0-9]{1,4}", s) and int(s) else 1 for s in (cell.attribute("colspan"), cell.attribute("rowspan"))]
                    wide = min(spans[0], 1000)
                    row.append((column, wide, self.inside(cell)))
                    if spans[1] > 1:
                        taken.update(dict.fromkeys(range(column, column + wide), spans[1]))
                    column += wide
                taken = {c: n - 1 for c, n in taken.items() if n > 1}
                rows.append(row)
            else:
                before += self.inside(part)
        width: dict[int, int] = {}
        for row in rows:
            for column, wide, lines in row:
                if wide == 1:
                    width[column] = max(width.get(column, 0), min(ALIGN, max(map(len, lines), default=0)))
        columns = sorted({c for row in rows for c, _, _ in row})
        starts, at = {}, 0
        for column in columns:
            starts[column] = at
            at += width.get(column, 0) + 3
        out = before
        for row in rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for column, _, lines in row:
                    if column and line:
                        line = line.ljust(starts[column] - 3) + " | "
                    elif starts[column]:
                        line = " " * starts[column]
                    line += lines[i] if i < len(lines) else ""
                out.append(line.rstrip(" |") if not line.strip(" |") else line.rstrip(" "))
        return out


def visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    root = tree(page)
    drop_unshown(root, Element, "<style" in page.lower())
    layout = Layout()
    layout.walk(root)
    layout.flush()
    return "\n".join(layout.lines).replace("\xa0", " ").strip("\n")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = bytes_of(batch.column("html"))
        for a, b in slices(offsets):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([visible_text(p) for p in batch.column("html").slice(a, b - a).to_pylist()], pa.string())], ["id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text of each row."""
    rows = own_columns(pages, id=id_col, html=html_col)
    return rows.mapInArrow(_extract, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", "page_id")
