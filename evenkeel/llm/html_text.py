"""HTML extraction by layout: build the tree a browser would, apply visibility, and render all visible text.

The tree builder supplies implied tags (paragraphs ended by blocks, list items by list items, cells and rows of tables, missing
rows), puts what a table cannot hold in front of it, ends raw text elements only at their own end tag and closes at
the end of the page whatever is open. Elements may be nested to any depth.

Not visible: scripts, styles, templates, the head, fallback content of embedded media, controls and elements hidden by the
``hidden`` attribute, by ``display: none`` or, unless a descendant is visible again, by ``visibility: hidden`` in their own
style; closed details but their summary; closed dialogs. Everything else is emitted once, in document order.

Blocks start on lines of their own, paragraphs, headings, lists, quotations and tables have a blank line around them, list items
have a mark and their further lines an indent, preformatted text keeps its white space, table cells are padded so
that columns stand under one another, with two blanks between them. Layout, not text, has bounds, as it would grow with the square
of the depth: indents stop at ``WIDEST`` columns, and tables inside ``GRIDS`` others have each cell on lines of its own.

A null page is null, an empty page or one without visible text is the empty string. Repeated rows give equal texts, null
ids stay null. A sign that opens no tag is text; a quotation mark in a tag that is never closed is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import text_slices

WIDEST = 240
GRIDS = 40

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table ul xmp textarea".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre figure fieldset hr xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset(
    "head script style template title noscript noembed noframes iframe object audio video canvas datalist select map svg math "
    "rp base link meta param".split()
)
SECTIONS = frozenset("thead tbody tfoot".split())
IN_TABLE = frozenset("table thead tbody tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
#: What an end tag or an implied end does not reach across.
WALLS = frozenset("td th caption table html template button object marquee".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?:!|\?|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none")
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent

    def get(self, name: str) -> str | None:
        """An attribute's value, the empty string if it has none, None if it is missing."""
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


class Builder:
    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {"html": [0]}  # places of the open elements of each tag

    def text(self, data: str) -> None:
        here = self.open[-1]
        if here.tag in IN_TABLE and not data.isspace():
            self.before_table(data)
        else:
            here.children.append(data)

    def before_table(self, item) -> None:
        """Put what a table cannot hold in front of the table."""
        table = self.open[self.last("table")] if self.at.get("table") else None
        if table is None or table.parent is None:
            self.open[-1].children.append(item)
            return
        siblings = table.parent.children
        if isinstance(item, Node):
            item.parent = table.parent
        siblings.insert(next(i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is table), item)

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, -1 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def cut(self, k: int) -> None:
        """End the open elements from the k-th on."""
        for node in self.open[k:]:
            self.at[node.tag].pop()
        del self.open[k:]

    def close(self, tags: frozenset | set, walls: frozenset = WALLS) -> bool:
        """End the innermost open element of ``tags`` and all inside it, unless a wall stands between."""
        k = max(map(self.last, tags))
        if k <= 0 or k < max(map(self.last, walls)):
            return False
        self.cut(k)
        return True

    def push(self, tag: str, attributes: str, void: bool) -> None:
        here = self.open[-1]
        node = Node(tag, attributes, here)
        if tag == "form" and here.tag in IN_TABLE:
            void = True  # rows and cells stay those of the table
        if here.tag in IN_TABLE and tag not in TABLE_PARTS and tag not in ("script", "style", "template", "form", "input"):
            self.before_table(node)
        else:
            here.children.append(node)
        if not void:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def start(self, tag: str, attributes: str, void: bool) -> None:
        if tag in ("html", "head", "body"):
            if attributes and tag == "body":
                self.root.attributes += " " + attributes
            if tag == "head":
                self.push(tag, attributes, void)
            elif tag == "body":
                self.close({"head"})
            return
        if self.open[-1].tag == "head" and tag not in ("meta", "link", "title", "style", "script", "base", "noscript", "template"):
            self.cut(len(self.open) - 1)  # the head ends where something stands that it cannot hold
        if tag in CLOSES_P:
            self.close({"p"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        elif tag == "li":
            self.close({"li"}, WALLS | {"ul", "ol", "menu", "dir"})
        elif tag in ("dd", "dt"):
            self.close({"dd", "dt"}, WALLS | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close({"option"} if tag == "option" else {"option", "optgroup"}, WALLS | {"select", "datalist"})
        elif tag == "a":
            self.close({"a"})
        elif tag in TABLE_PARTS:
            self.in_table(tag)
        self.push(tag, attributes, void)

    def in_table(self, tag: str) -> None:
        """Close what the part of a table ends, and supply the row that a cell needs."""
        if not self.at.get("table"):
            return
        walls = frozenset(("table", "html", "template"))
        if tag in ("td", "th"):
            self.close({"td", "th", "caption", "colgroup"}, walls | {"tr"})
            if not self.within("tr"):
                self.push("tr", "", False)
        elif tag == "tr":
            self.close({"tr", "caption", "colgroup"}, walls | SECTIONS)
        else:
            self.close(SECTIONS | {"caption", "colgroup"}, walls) or self.close({"tr"}, walls)

    def within(self, tag: str) -> bool:
        return self.last(tag) > self.last("table")

    def end(self, tag: str) -> None:
        if tag == "br":
            self.push("br", "", True)
        elif tag == "p":
            if not self.close({"p"}):
                self.push("p", "", True)
        elif tag in HEADINGS:
            self.close(HEADINGS)
        elif tag in ("html", "body"):
            pass
        elif tag == "table":
            self.close({"table"}, frozenset(("html", "template")))
        elif tag in TABLE_PARTS:
            self.close({tag}, frozenset(("table", "html", "template")))
        else:
            self.close({tag})


def parse(page: str) -> Node:
    builder, at, size = Builder(), 0, len(page)
    while at < size:
        here = page.find("<", at)
        if here < 0:
            builder.text(unescape(page[at:]))
            break
        m = TOKEN.match(page, here)
        if m is not None and m[2] is not None and '"' not in m[3] and "'" not in m[3] and not m[0].endswith(">"):
            m = LOOSE_TAG.match(page, here) or m
        elif m is None:
            m = LOOSE_TAG.match(page, here)  # quotes that never end
        if m is None:
            nothing = page.find("<", here + 1)
            stop = nothing if nothing >= 0 else size
            builder.text(unescape(page[at:stop]))
            at = stop
            continue
        if here > at:
            builder.text(unescape(page[at:here]))
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            builder.end(tag)
            continue
        attributes = m[3] or ""
        void = tag in VOID
        builder.start(tag, attributes, void)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            inner = page[at : stop.start()] if stop else page[at:]
            builder.open[-1].children.append(unescape(inner) if tag in ("title", "textarea") else inner)
            builder.cut(len(builder.open) - 1)
            at = stop.end() if stop else size
        elif tag == "plaintext":
            builder.open[-1].children.append(page[at:])
            break
    return builder.root


class Writer:
    """Lines of text with collapsing white space and collapsing gaps."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent, self.mark = "", ""

    def deeper(self, columns: int) -> str:
        """The indent with so many columns more, as far as it may grow."""
        return (self.indent + " " * columns)[:WIDEST]

    def open_line(self) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.line.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent)
        self.mark = ""

    def text(self, data: str) -> None:
        data = SPACES.sub(" ", data)
        if not self.line:
            data = data.lstrip(" ")
            if data:
                self.open_line()
        elif self.line[-1].endswith(" ") and len(self.line) > 1:
            data = data.removeprefix(" ")
        if data:
            self.line.append(data)

    def keep(self, data: str) -> None:
        """Preformatted text."""
        parts = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, part in enumerate(parts):
            if k:
                self.end_line(True)
            if part:
                if not self.line:
                    self.open_line()
                self.line.append(part)

    def end_line(self, always: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif always and self.lines:
            self.gap += 1

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced:
            self.gap = max(self.gap, 1)

    def whole(self) -> list[str]:
        self.end_line()
        return self.lines


def number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else default


def finish(step: Generator):
    """Run a step and the steps it yields, on a stack of its own: pages are nested deeper than functions may be."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def render(node: Node, out: Writer, seen: bool = True, kept: bool = False, nested: int = 0, grids: int = 0) -> Generator:
    """Write a node's text; a step for ``finish``, as is ``table_lines``."""
    tag = node.tag
    if tag in UNSEEN or tag == "input":
        return
    if node.attributes:
        style = (node.get("style") or "").lower()
        if node.get("hidden") is not None or HIDDEN_STYLE.search(style):
            return
        if m := VISIBILITY.search(style):
            seen = m[1] == "visible"
    if tag == "dialog" and node.get("open") is None:
        return
    if tag == "br":
        out.end_line(True)
        return
    if tag == "table":
        out.block(True)
        if grids < GRIDS:
            for line in (yield table_lines(node, seen, grids + 1)):
                out.keep(line)
                out.end_line(True)
        else:
            captions, rows = rows_of(node)
            for part in (*captions, *(cell for row in rows for cell in cells_of(row))):
                out.block(False)
                yield render(part, out, seen, kept, nested, grids)
        out.block(True)
        return
    block, spaced = tag in BLOCK, tag in SPACED and not (nested and tag in ("ul", "ol", "menu", "dir"))
    if block:
        out.block(spaced)
    if tag in ("ul", "ol", "menu", "dir", "dl", "li", "blockquote", "dd"):
        nested += 1
    indent = out.indent
    if tag == "blockquote" or tag == "dd":
        out.indent = out.deeper(2)
    count = number(node.get("start"), 1) if tag == "ol" else 0
    kept = kept or tag in ("pre", "textarea", "xmp", "plaintext", "listing")
    children = node.children
    if tag == "details" and node.get("open") is None:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
        children = [children[0][1:], *children[1:]]
    for child in children:
        if isinstance(child, str):
            if seen:
                out.keep(child) if kept else out.text(child)
        elif child.tag == "li":
            count = number(child.get("value"), count)
            out.block(False)
            mark = f"{count}. " if tag == "ol" else "- "
            own, out.indent, out.mark = out.indent, out.deeper(len(mark)), mark
            yield render(child, out, seen, kept, nested, grids)
            out.block(False)
            out.indent, out.mark = own, ""
            count += 1
        else:
            yield render(child, out, seen, kept, nested, grids)
    out.indent = indent
    if block:
        out.block(spaced)


def rows_of(table: Node) -> tuple[list[Node], list[Node]]:
    """Captions and rows of a table, rows of heads first and of feet last."""
    captions, heads, bodies, feet = [], [], [], []
    for child in table.children:
        if not isinstance(child, Node) or hidden(child):
            continue
        if child.tag == "caption":
            captions.append(child)
        elif child.tag == "tr":
            bodies.append(child)
        elif child.tag in SECTIONS:
            part = heads if child.tag == "thead" else feet if child.tag == "tfoot" else bodies
            part += [r for r in child.children if isinstance(r, Node) and r.tag == "tr" and not hidden(r)]
    return captions, heads + bodies + feet


def hidden(node: Node) -> bool:
    return bool(node.attributes) and (node.get("hidden") is not None or bool(HIDDEN_STYLE.search((node.get("style") or "").lower())))


def cells_of(row: Node) -> list[Node]:
    return [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)]


def table_lines(table: Node, seen: bool, grids: int) -> Generator:
    captions, rows = rows_of(table)
    lines: list[str] = []
    for caption in captions:
        out = Writer()
        yield render(caption, out, seen, grids=grids)
        lines += out.whole()
    grid: list[list[tuple[list[str], int]]] = []  # per row: lines of a cell and the columns it spans
    below: dict[int, int] = {}  # column: rows for which a cell above still fills it
    for row in rows:
        cells, column = [], 0

        def fill():
            nonlocal column
            while below.get(column, 0) > 0:
                below[column] -= 1
                cells.append(([], 1))
                column += 1

        for cell in cells_of(row):
            fill()
            out = Writer()
            yield render(cell, out, seen, grids=grids)
            wide, tall = max(1, min(1000, number(cell.get("colspan"), 1))), max(1, min(65534, number(cell.get("rowspan"), 1)))
            cells.append((out.whole(), wide))
            for k in range(wide):
                below[column + k] = tall - 1
            column += wide
        fill()
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        column = 0
        for text, wide in cells:
            if wide == 1:
                widths[column] = max([widths.get(column, 0), *map(len, text)])
            column += wide
    for cells in grid:
        for k in range(max([len(text) for text, _ in cells], default=0)):
            parts, column = [], 0
            for text, wide in cells:
                room = sum(widths.get(column + i, 0) for i in range(wide)) + 2 * (wide - 1)
                parts.append((text[k] if k < len(text) else "").ljust(room))
                column += wide
            lines.append("  ".join(parts).rstrip())
    return lines


def visible_text(page: str) -> str:
    out = Writer()
    finish(render(parse(page), out))
    return "\n".join(out.whole()).replace("\xa0", " ").strip("\n")


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """The rows with the visible text in place of the markup; a column of that name is replaced."""
    kept = [c for c in pages.columns if c not in (html, name)]

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, html):
                values = [None if t is None else visible_text(t.decode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(values, pa.string())], [*kept, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema]
    return pages.select(*kept, F.col(html).cast("string").alias(html)).mapInArrow(run, ", ".join([*fields, f"`{name}` string"]))
