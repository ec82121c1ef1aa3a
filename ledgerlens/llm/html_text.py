"""Layout-aware rendering of HTML to text.

Tags build a tree, with tags that HTML lets authors leave out implied (ends of `<p>`, `<li>` and
cells, rows around cells) and stray end tags ignored. What stands in a table but outside its cells
goes before the table, as in browsers. All visible text of the tree is emitted: blocks on lines of
their own, paragraphs apart by a blank line, list items with their marks, tables with their columns
aligned, cells with the lines that they have, also those of tables in them.

Elements that browsers don't show give no text: scripts, styles, heads, templates, `hidden`,
`display:none`, comments, closed dialogs, and closed details but for their summary. Text under
`visibility:hidden` isn't shown either, but what is `visible` inside it.

Null pages give null, empty pages an empty text. Pages are rendered one by one, so repeated rows have
equal texts; a page is in memory with its tree. Elements nested deeper than `DEPTH` are put beside
their parents, which keeps all text. Other columns stay, whatever their names.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerlens.llm._spark import map_texts, with_text

# Elements by how they are shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"head", "title", "script", "style", "template", "noscript", "datalist", "iframe", "canvas", "audio", "video", "rp"}
BLOCK = {"address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "plaintext", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SPACED = {"blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "p", "pre", "ul", "ol", "dl", "table"}
SAID_BY_VALUE = {"", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset"}
#: A start tag that ends open elements, up to the scopes that hold it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Parts of tables, and down to which open parts a start tag of each goes.
SECTIONS, CELLS, INSIDE = {"thead", "tbody", "tfoot"}, {"td", "th"}, {"table", "thead", "tbody", "tfoot", "tr"}
DOWN_TO = dict.fromkeys(("caption", "colgroup", "col", *SECTIONS), {"table"}) | {"tr": {"table", *SECTIONS}} | dict.fromkeys(CELLS, INSIDE)
#: Deeper elements are put beside their parents: trees that authors nest without end stay walkable.
DEPTH = 300
#: Widest table column that is padded, in cells of a terminal; columns that a cell may take, as browsers have it.
WIDEST, MOST_SPAN = 60, 1_000
NONE = regex.compile(r"(?i)display\s*:\s*none")
VISIBILITY = regex.compile(r"(?i)visibility\s*:\s*(hidden|collapse|visible)")
SPACES = regex.compile(r"[ \t\r\n\f]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def gone(self) -> bool:
        """Whether nothing of it is shown, nor takes room."""
        if self.tag in UNSEEN or "hidden" in self.attrs or (self.tag == "dialog" and "open" not in self.attrs):
            return True
        return bool(NONE.search(self.attrs.get("style") or ""))

    def unseen(self, above: bool) -> bool:
        """Whether its text takes room but isn't shown; if it doesn't tell, as its parent's."""
        told = VISIBILITY.search(self.attrs.get("style") or "")
        return above if told is None else told[1].lower() != "visible"

    def number(self, name: str, default: int, least: int = 1) -> int:
        said = (self.attrs.get(name) or "").strip()
        return max(least, int(said)) if said.removeprefix("-").isdecimal() and said.isascii() and len(said) < 9 else default


class Tree(HTMLParser):
    """Builds the tree; `open` is the path from the root to the place of the next node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def _end_open(self, tags: set[str], scopes: set[str]) -> None:
        """Ends the outermost open element of the tags, and all in it, that isn't beyond a scope."""
        end = 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in scopes or self.open[i].tag in CELLS:
                break
            if self.open[i].tag in tags:
                end = i
        if end:
            del self.open[end:]

    def _table(self) -> int:
        """The place of the innermost open table, or 0."""
        return next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "table"), 0)

    def _add(self, node: Node | str) -> None:
        if self.open[-1].tag in INSIDE and not (isinstance(node, Node) and node.tag in {*DOWN_TO, "script", "style", "template"}):
            at = self._table()  # it isn't in a cell: browsers put it before the table
            before = self.open[at - 1].children
            before.insert(next(i for i in range(len(before) - 1, -1, -1) if before[i] is self.open[at]), node)
        else:
            self.open[-1].children.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in DOWN_TO and (tag in BLOCK or tag in SPACED):
            self._end_open({"p"}, {"button", "object", "caption", "table"})
        if tag in DOWN_TO:
            at = self._table()
            if not at:
                return  # parts of no table
            while self.open[-1].tag not in DOWN_TO[tag] and len(self.open) > at + 1:
                self.open.pop()
            if tag in CELLS and self.open[-1].tag != "tr":
                self.handle_starttag("tr", [])
        elif tag == "table" and self.open[-1].tag in INSIDE:
            del self.open[self._table() :]  # a table that isn't in a cell ends the one before
        elif tag == "form" and self.open[-1].tag in INSIDE:
            return  # a form around cells doesn't keep them from their row
        elif tag in ENDS:
            self._end_open(*ENDS[tag])
        if tag in ("html", "body") and any(x.tag == tag for x in self.open):
            return
        node = Node(tag, dict(attrs))
        self._add(node)
        if tag not in VOID and (len(self.open) < DEPTH or tag in INSIDE or tag in CELLS) and len(self.open) < 2 * DEPTH:
            self.open.append(node)
        if tag == "plaintext":  # all that follows is text
            self.set_cdata_mode(tag)

    def close(self) -> None:
        if self.cdata_elem == "plaintext" and self.rawdata:  # the parser gives no text of an element that is read as text and doesn't end
            data, self.rawdata = self.rawdata, ""
            self.handle_data(data)
        super().close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        parts = tag in DOWN_TO
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag == "table" or (not parts and tag != "table" and self.open[i].tag in ("td", "th", "caption")):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in INSIDE or data.strip(" \t\r\n\f"):
            self._add(data)


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction: pending space and blank lines appear only before further text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.space = self.gap = False
        self.indent = ""
        self.mark = ""

    def text(self, data: str) -> None:
        for i, word in enumerate(SPACES.split(data)):
            self.space |= i > 0
            if word:
                self._put((" " if self.space and self.line else "") + word)
                self.space = False

    def kept(self, data: str) -> None:
        """Text with its spaces and line ends, all of them."""
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self._put(first)
        for more in rest:
            self.lines.append(self.line.rstrip())
            self.line = ""
            self._put(more)

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.mark = ""
        self.line += text

    def end(self, gap: bool = False) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False
        self.gap |= gap


def _rows(table: Node) -> list[Node]:
    """The rows of a table in the order in which they are shown: feet last."""
    rows, feet = [], []
    for child in table.children:
        if isinstance(child, Node) and not child.gone():
            if child.tag == "tr":
                rows.append(child)
            elif child.tag in SECTIONS:
                (feet if child.tag == "tfoot" else rows).extend(x for x in child.children if isinstance(x, Node) and x.tag == "tr" and not x.gone())
    return rows + feet


def render_table(table: Node, unseen: bool) -> list[str]:
    """Rows of cells, columns padded to their widest cell; cells over several columns or rows take their places."""
    grid: list[list[tuple[int, int, list[str]]]] = []  # column, columns taken, lines
    taken: dict[int, int] = {}  # rows that a cell above still takes of a column
    for row in _rows(table):
        here, cells, column = row.unseen(unseen), [], 0
        below: dict[int, int] = {}
        for cell in row.children:
            if not (isinstance(cell, Node) and cell.tag in CELLS) or cell.gone():
                continue
            while taken.get(column):
                column += 1
            over = min(cell.number("colspan", 1), MOST_SPAN)
            lines = render(cell, here)
            while lines and not lines[-1]:
                lines.pop()
            cells.append((column, over, lines))
            if (rows := cell.number("rowspan", 1)) > 1:
                below |= dict.fromkeys(range(column, column + over), rows - 1)
            column += over
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | below
        grid.append(cells)
    wide: dict[int, int] = {}
    for cells in grid:
        for column, over, lines in cells:
            if over == 1:
                wide[column] = max(wide.get(column, 0), min(WIDEST, max(map(width, lines), default=0)))
    shown = sorted({c for cells in grid for c, _, _ in cells})  # columns in which no cell begins take no room
    out = []
    for cells in grid:
        for i in range(max((len(lines) for *_, lines in cells), default=0)):  # a row without text has no lines
            parts, end = [], 0
            by = {column: (over, lines) for column, over, lines in cells}
            for column in shown:
                if column < end:
                    continue
                over, lines = by.get(column, (1, []))
                end = column + over
                within = [c for c in shown if column <= c < end]
                text = lines[i] if i < len(lines) else ""
                parts.append(text + " " * max(0, sum(wide.get(c, 0) for c in within) + 3 * (len(within) - 1) - width(text)))
            line = " | ".join(parts).rstrip()
            out.append(line[:-2].rstrip() if line.endswith(" |") and not any(p.strip() for p in parts[1:]) else line)
    return out


def render(root: Node, hidden: bool = False) -> list[str]:
    page = Page()

    def item(node: Node, child: Node, outer: str, number: int) -> int:
        """Puts the mark of a list item and returns the next one's number."""
        number = child.number("value", number, -(10**8)) if node.tag == "ol" else number
        mark = f"{number}. " if node.tag == "ol" else "- "
        page.end()
        page.mark = mark
        page.indent = page.indent.ljust(len(outer) + len(mark))
        return number + (-1 if "reversed" in node.attrs else 1)

    def walk(node: Node, kept: bool, unseen: bool) -> None:
        if node.gone():
            return
        tag, unseen = node.tag, node.unseen(unseen)
        if tag == "br":
            page.end() if page.line else page.end(gap=bool(page.lines))
            return
        if tag in ("img", "input"):
            said = node.attrs.get("alt") if tag == "img" else node.attrs.get("value") if (node.attrs.get("type") or "").lower() in SAID_BY_VALUE else None
            if said and not unseen:
                page.text(said)
            return
        spaced, block = tag in SPACED, tag in BLOCK or tag in SPACED
        if tag in ("ul", "ol") and page.indent:
            spaced = False
        if block and not page.mark:
            page.end(gap=spaced)
        if tag == "table":
            caption = next((x for x in node.children if isinstance(x, Node) and x.tag == "caption"), None)
            for line in [*(render(caption, unseen) if caption and not caption.gone() else []), *render_table(node, unseen)]:
                if line.strip():
                    page.kept(line)
                    page.end()
                else:
                    page.lines.append("")
            page.end(gap=True)
            return
        if tag == "optgroup" and node.attrs.get("label") and not unseen:
            page.text(node.attrs["label"])
            page.end()
        outer, number = page.indent, 1
        if tag in ("ul", "ol", "menu", "dir"):
            page.indent += "   " if tag == "ol" else "  "
            backwards = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) if "reversed" in node.attrs else 1
            number = node.number("start", backwards, -(10**8))
        elif tag in ("blockquote", "dd"):
            page.indent += "  "
        closed = tag == "details" and "open" not in node.attrs
        kept |= tag in ("pre", "textarea", "plaintext")
        for i, child in enumerate(node.children):
            if isinstance(child, str):
                if not unseen and not closed:
                    page.kept(child.removeprefix("\n") if i == 0 and tag in ("pre", "textarea") else child) if kept else page.text(child)
                continue
            if closed and child.tag != "summary":
                continue
            if child.tag == "li" and not child.gone():
                number = item(node, child, outer, number)
            walk(child, kept, unseen)
            if child.tag == "li":
                page.end()
                page.mark = ""
        page.indent = outer
        if block:
            page.end(gap=spaced)

    walk(root, False, hidden)
    page.end()
    return page.lines


def html_to_text(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return "\n".join(render(tree.root))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of pages but `html`, and `out`, in place of a column of that name."""
    kept = [c for c in pages.columns if c != html and c.lower() != out.lower()]
    pages, schema = with_text(pages, kept, html)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [None if x is None else html_to_text(x) for x in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, out])

    return map_texts(pages, run, f"{schema}`{out}` string")
