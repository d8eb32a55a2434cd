"""Layout-aware HTML to text: implied tags, visibility, block spacing, lists and aligned tables."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterable, Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.worker import add_binary, rest_of

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist object svg math audio video canvas".split())
#: Blocks that stand apart by an empty line, and those that only begin a line.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote figure form fieldset hgroup".split())
LINES = frozenset("html body div section article aside header footer main nav address details summary figcaption dt dd li tr td th caption legend option optgroup center search menu dir".split())
BLOCKS = APART | LINES | {"hr"}

#: Open elements that a start tag ends, and the elements that the search for them does not leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "table"}),
    "optgroup": ({"option", "optgroup"}, {"select", "table"}),
    "body": ({"head"}, set()),
}
ENDS_P = ({"p"}, {"td", "th", "table", "caption", "button", "object"})
#: An end tag does not reach beyond these, unless it is theirs.
WALLS = frozenset(("table", "td", "th", "caption", "object", "template"))
#: Items, cells and quotations inside each other; what begins further inside is laid out flat. All other elements may nest as deep as they come.
DEEPEST = 512
NESTED = frozenset(("li", "blockquote", "dd", "td", "th"))
HEAD_ONLY = frozenset("title base link meta style script noscript template head html".split())


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text as they are laid out. Empty lines are kept between blocks, not before the first or after the last."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.blank = False

    def write(self, text: str) -> None:
        for i, part in enumerate(SPACE.split(text)):
            if i and self.parts:
                self.gap = True
            if part:
                if self.gap:
                    self.parts.append(" ")
                self.parts.append(part)
                self.gap = False

    def write_raw(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts += [" ", first] if self.gap else [first]
        self.gap = False
        for line in rest:
            self.end_line(True)
            self.parts.append(line)

    def end_line(self, keep_empty: bool = False) -> None:
        line = "".join(self.parts).rstrip()
        if line or keep_empty:
            self.add([line])
        self.parts, self.gap = [], False

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines += lines

    def apart(self) -> None:
        self.end_line()
        self.blank = True

    def close(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []

    def layout(self) -> list[str]:
        """Cells side by side; each column is as wide as its widest cell that spans no other."""
        widths: list[int] = []
        for row in self.rows:
            at = 0
            for cell, span in row:
                widths += [0] * (at + span - len(widths))
                if span == 1:
                    widths[at] = max(widths[at], max(map(width, cell), default=0))
                at += span
        lines = []
        for row in self.rows:
            for k in range(max((len(cell) for cell, _ in row), default=0)):
                line, at, room = "", 0, 0
                for cell, span in row:
                    line += " " * (room - width(line)) + (cell[k] if k < len(cell) else "")
                    room += sum(w + 3 for w in widths[at : at + span])
                    at += span
                    room = max(room, width(line) + 3)
                lines.append(line.rstrip())
        return lines


class Page:
    """Builds the tree of open elements from tags and lays out what is visible as it goes."""

    def __init__(self):
        self.flow = Flow()
        self.open: list[tuple[str, bool, object]] = []  # tag, hidden, what was in use before
        self.where: dict[str, list[int]] = {}  # the places of each tag in ``open``
        self.nested = 0
        self.hidden = 0
        self.raw = 0
        self.counters: list[int | None] = []
        self.tables: list[Table] = []

    def start(self, tag: str, attributes: str) -> None:
        if tag not in HEAD_ONLY and any(t == "head" for t, _, _ in self.open[:3]):
            self.close_through({"head"}, set())
        if tag in BLOCKS:
            self.close_through(*ENDS_P)
        if tag in ENDS:
            self.close_through(*ENDS[tag])
        if tag in ("td", "th") and self.inside("table") and not self.inside("tr"):
            self.start("tr", "")
        values = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        gone = tag in HIDDEN or "hidden" in values or bool(HIDING.search(values.get("style", "")))
        if tag in VOID:
            if not self.hidden and not gone:
                self.void(tag, values)
            return
        before: object = None
        if gone:
            self.hidden += 1
        elif not self.hidden and tag in NESTED and self.nested >= DEEPEST:
            self.flow.end_line()
        elif not self.hidden:
            self.nested += tag in NESTED
            before = self.enter(tag, values)
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, gone, before))

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of ``tags``, or -1."""
        return max((self.where[tag][-1] for tag in tags if self.where.get(tag)), default=-1)

    def inside(self, tag: str) -> bool:
        at = self.last((tag,))
        return at >= 0 and at >= self.last(("table",))

    def void(self, tag: str, values: dict[str, str]) -> None:
        if tag == "br":
            self.flow.end_line(True)
        elif tag == "hr":
            self.flow.apart()
        elif tag == "img" and values.get("alt"):
            self.flow.write(values["alt"])
        elif tag == "input" and values.get("type", "text").lower() in ("button", "submit", "reset", "text") and values.get("value"):
            self.flow.write(values["value"])

    def enter(self, tag: str, values: dict[str, str]) -> object:
        outer = self.flow
        if tag in APART:
            if tag in ("ul", "ol") and self.counters:
                outer.end_line()
            else:
                outer.apart()
        elif tag in BLOCKS:
            outer.end_line()
        if tag in ("ul", "menu", "dir"):
            self.counters.append(None)
        elif tag == "ol":
            start = values.get("start", "1")
            self.counters.append(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
        elif tag == "pre":
            self.raw += 1
        elif tag == "table":
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        if tag in ("li", "blockquote", "dd") or (tag in ("td", "th") and self.tables):
            self.flow = Flow()
            span = values.get("colspan", "1")
            return outer, (min(int(span), 1000) or 1) if re.fullmatch(r"\d{1,4}", span) else 1
        return outer, 1

    def leave(self, tag: str, before: object) -> None:
        outer, span = before
        if tag in ("li", "blockquote", "dd") or (tag in ("td", "th") and self.tables):
            lines, self.flow = self.flow.close(), outer
            if tag in ("td", "th"):
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append((lines, span))
                return
            head = "  "
            if tag == "li":
                head = "- "
                if self.counters and self.counters[-1] is not None:
                    head = f"{self.counters[-1]}. "
                    self.counters[-1] += 1
            indent = " " * len(head)
            outer.add([(head if i == 0 and tag == "li" else indent) + line if line else "" for i, line in enumerate(lines)])
        if tag in ("ul", "ol", "menu", "dir"):
            self.counters.pop()
        elif tag == "pre":
            self.raw -= 1
        elif tag == "table":
            self.flow = outer
            outer.end_line()
            outer.add(self.tables.pop().layout())
        if tag in APART and not (tag in ("ul", "ol") and self.counters):
            self.flow.apart()
        elif tag in BLOCKS:
            self.flow.end_line()

    def pop(self) -> None:
        tag, gone, before = self.open.pop()
        self.where[tag].pop()
        if gone:
            self.hidden -= 1
        elif before is not None:
            self.nested -= tag in NESTED
            self.leave(tag, before)

    def close_through(self, tags: set[str], walls: set[str]) -> None:
        """End the outermost open element of ``tags`` that no wall encloses, and all within it."""
        if self.last(tags) < 0:
            return
        wall = self.last(walls)
        found = [self.where[tag][bisect(self.where[tag], wall)] for tag in tags if self.last((tag,)) > wall]
        if found:
            while len(self.open) > min(found):
                self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        at = self.last((tag,))
        if at >= 0 and (tag in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") or at >= self.last(WALLS)):
            while len(self.open) > at:
                self.pop()

    def text(self, text: str) -> None:
        if text and not self.hidden:
            if self.raw:
                self.flow.write_raw(unescape(text))
            else:
                self.flow.write(unescape(text))


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    page, at, size = Page(), 0, len(html)
    while at < size:
        sign = html.find("<", at)
        if sign < 0:
            break
        page.text(html[at:sign])
        found = TOKEN.match(html, sign)
        if not found:
            page.text("<")
            at = sign + 1
            continue
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            page.end(tag)
            continue
        page.start(tag, found[3])
        if tag in RAW and page.open and page.open[-1][0] == tag:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            end = stop.start() if stop else size
            if not page.hidden:
                page.flow.write_raw(unescape(html[at:end]))
            at = end
    page.text(html[at:])
    while page.open:
        page.pop()
    return "\n".join(page.flow.close()).strip("\n")


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Replace the pages by their visible text in ``text_col``.

    Hidden are head, scripts, styles, templates, embedded media, and elements with ``hidden`` or a style that hides
    them. Paragraphs, headings, lists, tables and quotations stand apart by an empty line, other blocks begin a line;
    list items carry ``-`` or their number and are indented by depth; the cells of a table stand in aligned columns;
    preformatted text keeps its spaces. Missing tags are implied as browsers do. Null and empty pages give an empty
    text, broken markup what is visible of it. A column named like ``text_col`` is replaced; repeated rows stay.
    """
    kept = rest_of(pages.columns, html_col, text_col)
    source = pages.select(*kept, F.col(html_col).cast("string").alias("_llm_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add_binary(batches, "_llm_html", [text_col], lambda html: (render(html).encode(),))

    made = source.mapInArrow(run, source.select(*kept).schema.add(text_col, "binary"))
    return made.withColumn(text_col, F.col(text_col).cast("string"))
