"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

Tags open and close elements on a stack (missing end tags are implied as in browsers); each element's
display decides line breaks, list marks and table cells. All visible text comes out, navigation and
advertisements included; only what a browser would not show is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*+(?:>|\Z)|<[!?/]>|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++|[\"'])*+)(?:>|\Z)",
    re.S,
)
_SPACE = re.compile(r"[ \t\n\f\r]+")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?")
_CONCEALED = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NUMBER = re.compile(r"\s*(-?\d{1,9})")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown, with all that they hold.
UNSEEN = frozenset("head title script style template noscript noframes iframe object audio video canvas datalist".split())
#: Shown within svg as lines; its other texts (title, desc, metadata, definitions) are not.
SVG_UNSEEN = frozenset("title desc metadata defs symbol clippath mask marker pattern style script".split())
#: What a head may hold; any other tag, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title noscript noframes iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption".split())
#: Set off by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu dir".split())
ENDS_P = BLOCK - frozenset("li dd dt body html option optgroup caption legend".split())
#: Open elements of the first kinds are closed by a start tag, up to one of the second kinds.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option"]), frozenset(["select"])),
}
_WALL = frozenset(["td", "th", "caption", "table", "html", "template"])
_LISTS = frozenset(["ul", "ol", "menu", "dir"])
#: Layout ends here, text does not: deeper lists and quotations are not indented further, and the cells
#: of deeper tables are lines.
MOST_INDENT, MOST_TABLES = 80, 16
_raw_end = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in RAW}


def attributes_of(s: str) -> dict[str, str]:
    """Names in lower case with their values; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(s):
        value = "".join(values)
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def concealed(a: dict[str, str]) -> bool:
    return "hidden" in a or "style" in a and bool(_CONCEALED.search(_COMMENT.sub("", a["style"])))


class Page:
    """Lines of text under construction: collapsed spaces, and breaks that are due before more text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.mark = ""
        self.space = False
        self.due = 0
        self.indent = 0

    def margin(self) -> str:
        return " " * min(self.indent, MOST_INDENT)

    def text(self, s: str) -> None:
        parts = _SPACE.sub(" ", s)
        if not parts:
            return
        if parts == " ":
            self.space = True
            return
        if self.due:
            self.settle()
        if self.line:
            if self.space or parts[0] == " ":
                self.line.append(" ")
        else:
            self.line.append(self.margin() + self.mark)
            self.mark = ""
        self.space = parts[-1] == " "
        self.line.append(parts.strip(" "))

    def verbatim(self, s: str) -> None:
        for i, x in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.flush(True)
            if x:
                if self.due:
                    self.settle()
                if not self.line:
                    self.line.append(self.margin() + self.mark)
                    self.mark = ""
                self.line.append(x)
        self.space = False

    def flush(self, even_empty: bool = False) -> None:
        if self.line or even_empty:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def settle(self) -> None:
        self.flush()
        if self.lines:
            while self.due > 1 and self.lines[-1] != "":
                self.lines.append("")
        self.due = 0

    def breaks(self, n: int) -> None:
        """At least ``n`` line ends before whatever follows: 1 ends the line, 2 leaves one empty line."""
        self.flush()
        self.due = max(self.due, n)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int]]] = []
        self.caption: list[str] = []

    def render(self) -> list[str]:
        """Rows of cells whose columns begin at the same place; a cell of several lines makes a row as high."""
        width: list[int] = []
        for row in self.rows:
            at = 0
            for lines, span in row:
                while len(width) < at + span:
                    width.append(0)
                if span == 1:
                    width[at] = max(width[at], max(map(len, lines), default=0))
                at += span
        out = list(self.caption)
        for row in self.rows:
            for k in range(max((len(lines) for lines, _ in row), default=0)):
                parts, at = [], 0
                for lines, span in row:
                    room = sum(width[at : at + span]) + 2 * (span - 1)
                    parts.append((lines[k] if k < len(lines) else "").ljust(room))
                    at += span
                out.append("  ".join(parts).rstrip(" "))
        return out


class Element:
    __slots__ = ("attributes", "hidden", "mark", "name", "number", "options", "page", "table")

    def __init__(self, name: str, hidden: bool):
        self.name, self.hidden = name, hidden
        self.number: int | None = None
        self.page: Page | None = None
        self.table: Table | None = None
        self.mark = 0
        self.attributes: dict[str, str] = {}
        #: Of a drop-down list: the text of each option, whether it is selected and whether it is enabled.
        self.options: list[tuple[str, bool, bool]] | None = None


class Renderer:
    """Builds the element stack from tags and renders on the way."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[Element] = []
        #: Where elements of each name are open, outermost first.
        self.places: dict[str, list[int]] = {}
        #: Open tables, None for those too deep for a layout; open drop-down lists.
        self.tables: list[Table | None] = []
        self.choices: list[Element] = []
        self.unseen = 0
        self.pre = 0

    def feed(self, html: str) -> str:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m[1]:
                self.end(m[1].lower())
            elif m[2]:
                name = m[2].lower()
                self.begin(name, m[3])
                if name in RAW:
                    stop = _raw_end[name].search(html, at)
                    if name == "textarea":
                        self.area(html[at : stop.start() if stop else end])
                    if name == "xmp":
                        self.page.verbatim(html[at : stop.start() if stop else end])
                    at = stop.start() if stop else end
            elif m[0].startswith("<![CDATA["):
                self.text(m[0][9:].removesuffix("]]>"))
        while self.stack:
            self.pop()
        return "\n".join(self.page.done())

    def area(self, s: str) -> None:
        """A text area shows its characters as they are, but for a first line end."""
        if not self.unseen:
            s = s.replace("\r\n", "\n")
            self.page.verbatim(unescape(s[1:] if s[:1] == "\n" else s))

    def text(self, s: str) -> None:
        if self.stack and self.stack[-1].name == "head" and s.strip():
            self.pop()
        if self.unseen or self.stack and self.stack[-1].name in ("select", "optgroup"):
            return
        if self.place("svg") > max(self.place("text"), self.place("foreignobject")):
            return
        # Text between table parts, outside cells, is only shown if it is not white space.
        if self.stack and self.stack[-1].name in ("table", "tr", "tbody", "thead", "tfoot") and not s.strip():
            return
        s = unescape(s) if "&" in s else s
        self.page.verbatim(s) if self.pre else self.page.text(s)

    def begin(self, name: str, attributes: str) -> None:
        if name in ("select", "input", "textarea") and self.inside("select"):
            self.close(frozenset(["select"]), frozenset())
            if name == "select":
                return
        if name in ENDS_P:
            self.close(frozenset(["p"]), _WALL | {"button"})
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if name not in IN_HEAD and name not in ("html", "head"):
            self.close(frozenset(["head"]), frozenset(["body", *RAW, "template"]))
        if name in ("td", "th") and not (self.stack and self.stack[-1].name == "tr") and self.inside("table"):
            self.begin("tr", "")
        if name == "br":
            if not self.unseen:
                if self.page.due:
                    self.page.settle()
                self.page.flush(True)
            return
        if name in VOID:
            if name == "hr" and not self.unseen:
                self.page.breaks(2)
            return
        if name == "html" and self.inside("html") or name == "body" and self.inside("body"):
            return
        a = attributes_of(attributes) if attributes else {}
        unseen = name in UNSEEN or concealed(a) or name in SVG_UNSEEN and self.inside("svg") or name in ("annotation", "annotation-xml") and self.inside("math")
        # A drop-down list shows its selected option even if that is hidden in the list.
        listed = name in ("option", "optgroup") and bool(self.choices)
        e = Element(name, unseen and not listed)
        e.attributes = a
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)
        if e.hidden:
            self.unseen += 1
        if self.unseen:
            return
        page = self.page
        if listed:
            if name == "option":
                e.page, self.page = page, Page()
            return
        if name == "select" and "multiple" not in a and not ((size := _NUMBER.match(a.get("size", ""))) and int(size[1]) > 1):
            e.options = []
            self.choices.append(e)
            return
        if name == "optgroup" and a.get("label"):
            page.breaks(1)
            page.text(a["label"])
        elif name == "option" and a.get("label"):
            page.breaks(1)
            page.text(a["label"])
            e.hidden = True
            self.unseen += 1
            return
        if name == "text" and self.inside("svg"):
            page.breaks(1)
        if name in ("td", "th", "caption") and (table := self.table()):
            e.page, self.page = page, Page()
            span = _NUMBER.match(a.get("colspan", ""))
            e.number = min(max(int(span[1]), 1), 100) if span else 1
            return
        if name == "tr" and (table := self.table()):
            table.rows.append([])
            return
        if name in ("td", "th", "tr", "caption") and self.tables:
            page.breaks(1)
        if name in BLOCK:
            nested = (name in _LISTS or name == "dl") and self.inside("li")
            page.breaks(2 if name in SPACED and not nested else 1)
        if name == "table":
            e.table = Table() if len(self.tables) < MOST_TABLES else None
            self.tables.append(e.table)
        elif name == "pre":
            self.pre += 1
        elif name == "ol":
            start = _NUMBER.match(a.get("start", ""))
            e.number = int(start[1]) if start else 1
        elif name == "li":
            k = max(map(self.place, _LISTS))
            owner = self.stack[k] if k >= 0 else None
            if owner is not None and owner.name == "ol" and owner.number is not None:
                page.mark = f"{owner.number}. "
                owner.number += 1
            else:
                page.mark = "- "
            e.mark = len(page.mark)
            page.settle()
        elif name in ("blockquote", "dd"):
            page.indent += 2
        if name in _LISTS and self.inside("li"):
            page.indent += 2

    def place(self, name: str) -> int:
        """Where the innermost open element of this name is; -1 for none."""
        at = self.places.get(name)
        return at[-1] if at else -1

    def inside(self, name: str) -> bool:
        return bool(self.places.get(name))

    def table(self) -> Table | None:
        return self.tables[-1] if self.tables else None

    def close(self, kinds: frozenset[str], walls: frozenset[str]) -> None:
        """Pop up to the innermost open element of ``kinds``, unless one of ``walls`` stands before it."""
        k = max(map(self.place, kinds), default=-1)
        if k < 0 or k < max(map(self.place, walls), default=-1):
            return
        while len(self.stack) > k:
            self.pop()

    def end(self, name: str) -> None:
        if name == "br":
            self.begin("br", "")
            return
        if name in ("html", "body"):
            return
        if name == "p" and not self.inside("p"):
            self.begin("p", "")
        walls = frozenset(["table"]) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else frozenset() if name == "table" else frozenset(["td", "th", "table"])
        self.close(frozenset([name]), walls - {name})

    def pop(self) -> None:
        e = self.stack.pop()
        self.places[e.name].pop()
        if e.hidden:
            self.unseen -= 1
            return
        if self.unseen:
            return
        page, name = self.page, e.name
        if e.options is not None:
            self.choices.pop()
            shown = [x for x, selected, _ in e.options if selected][-1:] or [x for x, _, enabled in e.options if enabled][:1]
            for x in shown:
                page.text(x)
            return
        if name == "option" and e.page is not None:
            text, self.page = e.attributes.get("label") or " ".join(filter(None, page.done())), e.page
            group = self.stack[self.place("optgroup")].attributes if self.inside("optgroup") else {}
            self.choices[-1].options.append((text, "selected" in e.attributes, "disabled" not in e.attributes and "disabled" not in group))
            return
        if name == "optgroup" and self.choices:
            return
        if name == "text" and self.inside("svg"):
            page.breaks(1)
        if name == "table":
            self.tables.pop()
        if e.page is not None:
            lines, self.page = page.done(), e.page
            table = self.table()
            if table is None:
                for x in lines:
                    self.page.verbatim(x + "\n")
            elif name == "caption":
                table.caption += lines
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((lines, e.number or 1))
            return
        if e.table is not None:
            for x in e.table.render():
                if page.due:
                    page.settle()
                page.line = [page.margin() + x]
                page.flush(True)
            page.breaks(2)
            return
        if name == "pre":
            self.pre -= 1
        if name in ("blockquote", "dd"):
            page.indent -= 2
        if name == "li" and page.mark:
            page.mark = ""
        if name in _LISTS and self.inside("li"):
            page.indent -= 2
            page.breaks(1)
        elif name in BLOCK:
            page.breaks(2 if name in SPACED else 1)


def extract(html: str | None) -> str:
    """The visible text of a page; null and empty pages have none."""
    return Renderer().feed(html) if html else ""


def rendered(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys``, text and n_chars of every row.

    Defined results: a null or empty page, or one without visible text, gives an empty text; markup
    that is cut off or badly nested is closed as browsers do; plain text is a page of one paragraph;
    repeated rows give equal rows; an empty table gives an empty result. Very long pages are rendered
    whole, in time that grows with their length however deep their elements are; layout (not text) stops
    at ``MOST_INDENT`` and ``MOST_TABLES``. Columns other than ``keys`` and ``html`` are not read; a key
    may not be named text or n_chars.
    """
    took = pages.select(*keys, html)
    schema = pages.select(*keys).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html, 4 << 20):
                texts = [extract(x) for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return took.mapInArrow(run, schema)
