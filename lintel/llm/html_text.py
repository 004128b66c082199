"""Layout-aware text of HTML pages.

A small tree builder closes what the markup leaves open (paragraphs, list items, cells and the like) and ignores end tags without a start.
A renderer then walks the tree by visibility and layout rules: hidden elements are left out, blocks begin new lines, paragraphs are
set apart by blank lines, list items get bullets or numbers, preformatted text stays, and table cells are padded into columns.
Spark deals pages out; a task renders one page at a time and keeps nothing between them.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, without visible text, blocks, and blocks with a margin of one line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title datalist object iframe audio video canvas".split())
BLOCKS = frozenset("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
# What a start tag closes, and the elements that this does not reach beyond.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "thead": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "p"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}
WALLS = ("table", "td", "th", "html", "body", "button", "caption")
#: What may stand in a head; anything else closes it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Drawings and formulas: elements whose content is HTML again, those that are not shown, and HTML's elements that end a drawing or formula.
ISLANDS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
UNDRAWN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc annotation annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
# Elements whose content is text up to their own end tag: as it stands, or with character references.
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
REFERENCES = frozenset("textarea title".split())
#: Elements nested deeper become siblings, as in the usual browsers.
DEPTH = 512
#: A name in a tag, and the blanks and strokes before it.
NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)\s*+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of a tag from behind its name on, whether it ends itself, and where it ends; -1 if the page ends first."""
    found: dict[str, str] = {}
    while True:
        m = NAME.match(html, at)
        name, at = m[1].lower(), m.end()
        value = ""
        if html.startswith("=", at) and name:
            at += 1
            while html[at : at + 1].isspace():
                at += 1
            quote = html[at : at + 1]
            if quote in ("'", '"'):
                end = html.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = html[at + 1 : end], end + 1
            else:
                end = UNQUOTED.match(html, at).end()
                value, at = html[at:end], end
        if name:
            found.setdefault(name, unescape(value))
        elif at >= len(html):
            return found, False, -1
        elif html[at] == ">":
            return found, html[at - 1] == "/", at + 1


UNQUOTED = re.compile(r"[^\s>]*+")


class TreeBuilder:
    """Reads markup once from left to right. What a browser drops (comments, declarations, a tag or comment that the page ends in) is dropped."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()
        self.drawn = self.fresh = False

    def push(self, node: Node):
        self.open.append(node)
        self.count[node.tag] += 1

    def cut(self, at: int):
        for x in self.open[at:]:
            self.count[x.tag] -= 1
        del self.open[at:]

    def feed(self, html: str):
        html = html.replace("\r\n", "\n").replace("\r", "\n")
        i, n = 0, len(html)
        while i < n:
            j = html.find("<", i)
            j = n if j < 0 else j
            if i < j:
                self.text(unescape(html[i:j]))
            next_ = html[j + 1 : j + 2]
            if j == n:
                return
            if next_.isascii() and next_.isalpha():
                i = self.start(html, j + 1)
            elif next_ == "/" and html[j + 2 : j + 3].isalpha() and html[j + 2].isascii():
                end = TAG.match(html, j + 2).end()
                i = attributes(html, end)[2]
                if i > 0:
                    self.end_tag(html[j + 2 : end].lower())
            elif html.startswith("<!--", j):
                ends = [x for x in ((html.find("-->", j + 2), 3), (html.find("--!>", j + 4), 4)) if x[0] >= 0]
                i = sum(min(ends)) if ends else -1
            elif html.startswith("<![CDATA[", j) and self.foreign():
                end = html.find("]]>", j)
                self.text(html[j + 9 : end if end >= 0 else n])
                i = end + 3 if end >= 0 else -1
            elif next_ in ("!", "?", "/") and next_:
                i = html.find(">", j) + 1 or -1
            else:
                self.text("<")
                i = j + 1
            if i < 0:
                return

    def start(self, html: str, at: int) -> int:
        end = TAG.match(html, at).end()
        tag = html[at:end].lower()
        attrs, empty, i = attributes(html, end)
        if i < 0:
            return i
        plain = not self.foreign()
        self.start_tag(tag, attrs, empty)
        if plain and tag == "plaintext":
            self.text(html[i:])
            return -1
        if plain and (tag in RAW or tag in REFERENCES):
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, i)
            stop = close.start() if close else len(html)
            if tag not in UNSEEN:
                self.text(html[i:stop] if tag in RAW else unescape(html[i:stop]))
            return stop
        return i

    def foreign(self) -> int:
        """Place of the open svg or math that a new element belongs to, or 0."""
        for i in range(len(self.open) - 1, 0, -1) if self.drawn else ():
            if self.open[i].tag in ("svg", "math"):
                return i
            if self.open[i].tag in ISLANDS:
                return 0
        return 0

    def start_tag(self, tag: str, attrs: dict, empty: bool):
        self.fresh = False
        while (at := self.foreign()) and tag in BREAKOUT:
            self.cut(at)
        if at or tag in ("svg", "math"):
            self.drawn = True
            if self.open[-1].tag == "head":
                self.cut(-1)
            node = Node(tag, attrs | ({"hidden": ""} if tag in UNDRAWN else {}))
            self.open[-1].kids.append(node)
            if not empty and len(self.open) < DEPTH:
                self.push(node)
            return
        if tag == "head" and (len(self.open) > 1 or any(not isinstance(x, str) or x.strip() for x in self.root.kids)):
            return
        if self.open[-1].tag == "head" and tag not in HEAD and tag != "html":
            self.cut(-1)
        closes, walls = CLOSES.get(tag, ()), SCOPES.get(tag, WALLS)
        left, lowest = sum(self.count[x] for x in closes), 0
        for i in range(len(self.open) - 1, 0, -1) if left else ():
            if self.open[i].tag in walls:
                break
            if self.open[i].tag in closes:
                lowest, left = i, left - 1
                if not left:
                    break
        if lowest:
            self.cut(lowest)
        if tag == "html" or (tag == "body" and self.count["body"]):
            return
        if tag in ("tr", "td", "th"):  # whatever is open between a row and its cell, or a table and its row, ends here
            for i in range(len(self.open) - 1, 0, -1) if self.count["table"] or self.count["tr"] else ():
                if self.open[i].tag in (("table", "thead", "tbody", "tfoot") if tag == "tr" else ("table", "tr")):
                    if self.open[i].tag != "table" or tag == "tr":
                        self.cut(i + 1)
                    break
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        if tag == "form" and self.open[-1].tag in ("table", "thead", "tbody", "tfoot", "tr"):
            return
        if tag not in VOID and len(self.open) < DEPTH:
            self.push(node)
            self.fresh = tag in ("pre", "listing", "textarea")

    def end_tag(self, tag: str):
        self.fresh = False
        if tag in ("html", "body") or not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def text(self, data: str):
        if self.fresh and data.startswith("\n"):
            data = data[1:]
        self.fresh = False
        if self.open[-1].tag == "head" and data.strip():
            self.cut(-1)
        if data:
            self.open[-1].kids.append(data)


TAG = re.compile(r"[^\s/>]++")


def hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").lower().replace(" ", "")
    return node.tag in UNSEEN or "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")


class Page:
    """Lines of text under construction. Blank lines and spaces wait until text follows."""

    def __init__(self):
        self.lines, self.line, self.breaks, self.space, self.prefix = [], "", 0, False, ""

    def end_line(self, blank: int = 0):
        if self.line or self.prefix.strip():
            self.lines.append(self.line.rstrip())
            self.line = ""
        self.breaks, self.space = max(self.breaks, blank), False

    def text(self, words: str, raw: bool = False):
        if raw:
            first, *rest = words.split("\n")
            self._add(first)
            for x in rest:
                self.lines.append(self.line.rstrip())
                self.line = ""
                self._add(x)
            return
        pieces = words.split()
        if not pieces:
            self.space = self.space or bool(words) and bool(self.line)
            return
        if (self.space or words[0].isspace()) and self.line and not self.line.endswith(" "):
            self._add(" ")
        self._add(" ".join(pieces))
        self.space = words[-1].isspace()

    def _add(self, x: str):
        if x and not self.line:
            if self.lines:
                self.lines.extend([""] * self.breaks)
            self.breaks = 0
            self.line, self.prefix = self.prefix, ""
        self.line += x

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def render(node: Node, page: Page, raw: bool = False) -> None:
    number = int(node.attrs.get("start", "1")) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "1")) else 1
    for kid in node.kids:
        if isinstance(kid, str):
            page.text(kid, raw)
            continue
        if hidden(kid) or (node.tag == "details" and "open" not in node.attrs and kid.tag != "summary"):
            continue
        if kid.tag == "br":
            if page.line:
                page.end_line()
            else:
                page.breaks = 1
            continue
        if kid.tag == "svg":
            render_drawing(kid, page)
            continue
        block = kid.tag in BLOCKS or kid.tag in SPACED or (kid.tag == "math" and kid.attrs.get("display", "").lower() == "block")
        nested = kid.tag in ("ul", "ol") and node.tag in ("li", "ul", "ol")
        margin = 1 if kid.tag in SPACED and not nested else 0
        if block:
            page.end_line(margin)
        if kid.tag == "table":
            for line in table_lines(kid):
                page.text(line, True)
                page.end_line()
        elif kid.tag == "li":
            if re.fullmatch(r"-?\d{1,9}", kid.attrs.get("value", "")):
                number = int(kid.attrs["value"])
            mark = f"{number}. " if node.tag == "ol" else "* "
            number += 1
            inner = Page()
            render(kid, inner, raw)
            for i, line in enumerate(inner.done() or [""]):
                page.text((mark if not i else " " * len(mark)) + line, True)
                page.end_line()
        elif kid.tag == "hr":
            page.text("---")
        else:
            render(kid, page, raw or kid.tag in ("pre", "textarea", "listing"))
        if block:
            page.end_line(margin)


def render_drawing(node: Node, page: Page) -> None:
    """The texts of a drawing, set apart by spaces; anything else of it is no text."""
    for kid in node.kids:
        if isinstance(kid, str) or hidden(kid):
            continue
        if kid.tag in ("text", "foreignobject"):
            page.space = bool(page.line)
            render(kid, page)
            page.space = bool(page.line)
        else:
            render_drawing(kid, page)


def _count(node: Node, name: str, most: int) -> int:
    """A number of rows or columns; 1 unless it is a number from 0 on."""
    value = node.attrs.get(name, "").strip()
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value) else 1


def table_lines(table: Node) -> list[str]:
    """Rows of cells padded to the widest of their column; a cell over several columns doesn't widen them.

    A cell over several rows stands in the first of them and leaves its columns blank in the others. What is misplaced stands before the rows.
    """
    rows, before = [], []  # the section and the cells of each row

    def outside(kids: list):
        page, holder = Page(), Node("div", {})
        holder.kids = kids
        render(holder, page)
        before.extend(page.done())

    def collect(node: Node):
        for kid in node.kids:
            if isinstance(kid, str) or hidden(kid):
                continue
            if kid.tag == "tr":
                cell = lambda c: not isinstance(c, str) and c.tag in ("td", "th")
                rows.append((node, [c for c in kid.kids if cell(c) and not hidden(c)]))
                outside([c for c in kid.kids if not cell(c)])
            elif kid.tag in ("thead", "tbody", "tfoot"):
                collect(kid)
            else:  # captions, and what is misplaced
                outside([kid])
        outside([x for x in node.kids if isinstance(x, str) and x.strip()])

    collect(table)
    grid, width, section, taken = [], {}, None, {}
    for of, row in rows:
        if of is not section:
            section, taken = of, {}
        cells, column = [], 0
        for cell in row:
            page = Page()
            render(cell, page)
            lines = page.done()
            while taken.get(column):
                column += 1
            span, down = _count(cell, "colspan", 1000) or 1, _count(cell, "rowspan", 65534) or 65534
            if span == 1:
                width[column] = max([width.get(column, 0), *map(len, lines)])
            if down > 1:
                taken.update((column + i, max(taken.get(column + i, 0), down)) for i in range(span))
            cells.append((column, span, lines))
            column += span
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
        grid.append(cells)
    out = before
    for cells in grid:
        for k in range(max((len(lines) for *_, lines in cells), default=0)):
            parts, at = [], 0
            for column, span, lines in cells:
                parts += [" " * width.get(i, 0) for i in range(at, column)]
                room = sum(width.get(column + i, 0) for i in range(span)) + 3 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                at = column + span
            out.append(" | ".join(parts).rstrip())
    return out


def page_text(html: str) -> str:
    builder = TreeBuilder()
    builder.feed(html)
    page = Page()
    render(builder.root, page)
    return "\n".join(page.done()).strip("\n")


def _text_batches(batches):
    import pyarrow as pa

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))
    for batch in batches:
        texts = [page_text(x.as_py() or "") for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text, all visible text of the page's html.

    Null or empty html gives an empty text. Null and repeated page_ids give a row each. Other columns are ignored; an empty table gives
    an empty result. Malformed markup never fails: what is open at the end of the page is closed, what a browser would drop is dropped.
    Very long pages take time in proportion; one page is held in memory at a time.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_text_batches, "page_id long, text string")
