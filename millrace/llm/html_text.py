"""HTML to text by layout: all visible text, laid out as a plain-text browser would.

A tree builder keeps the stack of open elements, with the tags that HTML implies: a new block ends an open paragraph, a
list item the one before it, a cell or row the one before it; end tags close what they match and are ignored where they
match nothing. Elements that a browser doesn't show (head, script, style, template, closed details, the hidden
attribute, display:none, visibility:hidden) are left out with all that they hold. Text goes to a canvas: white space
collapses outside of pre, blocks start lines, paragraphs, headings, lists and tables keep a blank line around them, list
items their marks and indentation, and the cells of a table are aligned in columns (a cell wider than max_column pads no
other).

Each page is rendered for itself, in time linear in its length but for the padding of tables: where open elements stand is
kept by name, so that no tag looks through the stack. Null or empty html gives empty text. Null and repeated ids, and
repeated rows, are kept. Pages of any length are rendered whole; columns besides page_id and html are not read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object canvas audio video datalist area".split())
#: Hidden within an element of the first: what drawings and formulas hold beside their text.
UNDRAWN = {"svg": frozenset("title desc defs metadata".split()), "math": frozenset(("annotation", "annotation-xml"))}
HEAD_ONLY = frozenset("base link meta title style script noscript template head html".split())
#: Blank lines around a block.
BLOCKS = dict.fromkeys("address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption".split(), 0)
BLOCKS |= dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split(), 1)
ENDS_P = frozenset(BLOCKS) - {"body", "html", "option", "optgroup", "caption"}
#: A start tag ends open elements of the second set, but not beyond one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
#: An end tag looks for its element no further than these, unless it is one of them.
SCOPE = frozenset(("table", "td", "th", "caption"))
TABLE_PARTS = frozenset(("table", "tr", "tbody", "thead", "tfoot", "td", "th"))

MARKUP = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>?|(?P<end>/)?+(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<broken>[^>]*+)(?:>|\Z))|/[^>]*+>?)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


@dataclass(frozen=True)
class LayoutPolicy:
    list_indent: int = 2
    most_indent: int = 40
    max_column: int = 120
    gutter: str = "  "


class Canvas:
    """Lines of text that blocks and words are put on."""

    def __init__(self, policy: LayoutPolicy):
        self.policy = policy
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.margin = 0
        self.indent = 0
        self.mark = ""

    def words(self, text: str) -> None:
        """Text in which white space collapses."""
        if not (flat := SPACES.sub(" ", text)):
            return
        if flat == " ":
            self.space = self.space or bool(self.parts)
            return
        if self.parts and (self.space or flat[0] == " "):
            self.parts.append(" ")
        self.parts.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def kept(self, text: str) -> None:
        """Text whose white space counts."""
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.line(True)
            self.parts.append(line)

    def line(self, even_empty: bool = False) -> None:
        """Ends the line; one without text counts only if even_empty."""
        text = "".join(self.parts).replace("\xa0", " ")
        self.parts, self.space = [], False
        if not text.strip():
            if even_empty and self.lines:
                self.lines.append("")
            return
        if self.lines and self.margin:
            self.lines += [""] * (self.margin - (self.lines[-1] == ""))
        self.margin = 0
        indent = min(self.indent, self.policy.most_indent)
        self.lines.append(" " * max(0, indent - len(self.mark)) + self.mark + text.rstrip())
        self.mark = ""

    def block(self, margin: int) -> None:
        self.line()
        self.margin = max(self.margin, margin)

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


@dataclass
class Cell:
    lines: list[str]
    span: int


@dataclass
class Table:
    rows: list[list[Cell]] = field(default_factory=list)

    def rendered(self, policy: LayoutPolicy) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for cell in row:
                if cell.span == 1:
                    width = max(map(len, cell.lines), default=0)
                    widths[at] = max(widths.get(at, 0), width if width <= policy.max_column else 0)
                at += cell.span
        out: list[str] = []
        for row in self.rows:
            for k in range(max((len(c.lines) for c in row), default=0)):
                line, at, due = "", 0, 0
                for n, cell in enumerate(row):
                    line = line.ljust(due) + (policy.gutter if n else "") + (cell.lines[k] if k < len(cell.lines) else "")
                    due += len(policy.gutter) * bool(n) + sum(widths.get(x, 0) for x in range(at, at + cell.span)) + len(policy.gutter) * (cell.span - 1)
                    at += cell.span
                out.append(line.rstrip())
        return out


@dataclass
class Element:
    name: str
    hides: bool = False
    canvas: Canvas | None = None  # where a cell's text goes
    table: Table | None = None
    count: int | None = None  # of an ordered list
    span: int = 1


class Page:
    def __init__(self, policy: LayoutPolicy):
        self.policy = policy
        self.canvases = [Canvas(policy)]
        self.open: list[Element] = []
        self.hidden = 0  # open elements that hide what they hold
        self.pre = 0
        self.tables = 0
        self.items = 0
        self.seen: dict[str, int] = {}  # open elements by name
        self.at: dict[str, list[int]] = {}  # their places in the stack
        self.built: list[Table] = []  # open tables that are shown
        self.holders: list[Element] = []  # open lists

    @property
    def canvas(self) -> Canvas:
        return self.canvases[-1]

    def render(self, source: str) -> list[str]:
        at, end = 0, len(source)
        while at < end:
            found = MARKUP.search(source, at)
            if not found:
                self.text(source[at:])
                break
            if found.start() > at:
                self.text(source[at : found.start()])
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if found["end"]:
                self.close(name)
                continue
            attrs = found["attrs"] if found["attrs"] is not None else found["broken"]
            self.start(name, attrs or "")
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                inner = source[at : stop.start() if stop else end]
                at = stop.start() if stop else end
                if name in ("textarea", "xmp") and not self.hidden:
                    self.canvas.kept(inner if name == "xmp" else html.unescape(inner))
        while self.open:
            self.pop()
        return self.canvas.done()

    def text(self, text: str) -> None:
        if self.seen.get("head") and text.strip(" \t\n\r\f"):
            self.close("head")
        if self.hidden:
            return
        if self.open and self.open[-1].name in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip(" \t\n\r\f"):
            return
        if "&" in text:
            text = html.unescape(text)
        if self.pre:
            self.canvas.kept(text)
        else:
            self.canvas.words(text)

    def start(self, name: str, attrs: str) -> None:
        if self.seen.get("head") and name not in HEAD_ONLY:
            self.close("head")
        if name in ENDS_P and self.seen.get("p"):
            self.end_within("p", SCOPE)
        if name in IMPLIED:
            closing, walls = IMPLIED[name]
            self.end_implied(closing, walls)
        if name in ("td", "th") and not self.row_open():
            self.start("tr", "")
        if name in VOID:
            if self.hidden:
                return
            if name == "br":
                self.canvas.line(True)
            elif name == "hr":
                self.canvas.block(1)
            return
        found = {}
        if attrs.strip():
            for x in ATTRIBUTE.finditer(attrs):
                found.setdefault(x[1].lower(), html.unescape(x[2] or x[3] or x[4] or ""))
        hides = name in HIDDEN or any(self.seen.get(x) and name in held for x, held in UNDRAWN.items()) or ("hidden" in found and found["hidden"].lower() != "until-found") or bool(UNSEEN.search(found.get("style", "")))
        if self.open and self.open[-1].name == "details" and self.open[-1].count == 0 and name != "summary":
            hides = True
        element = Element(name, hides)
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append(element)
        self.seen[name] = self.seen.get(name, 0) + 1
        if name in ("ul", "ol", "menu"):
            self.holders.append(element)
        self.hidden += hides
        if name == "details":
            element.count = 1 if "open" in found else 0
        if self.hidden:
            return
        canvas = self.canvas
        if name in BLOCKS:
            nested = name in ("ul", "ol", "menu") and (self.seen.get("ul", 0) + self.seen.get("ol", 0) + self.seen.get("menu", 0)) > 1
            canvas.block(0 if nested else BLOCKS[name])
        if name in ("pre",):
            self.pre += 1
        elif name in ("ul", "ol", "menu"):
            element.count = int(found["start"]) if name == "ol" and re.fullmatch(r"-?\d{1,9}", found.get("start", "")) else 1
            canvas.indent += self.policy.list_indent
        elif name == "li":
            self.items += 1
            holder = self.holders[-1] if self.holders else None
            mark = f"{holder.count}. " if holder and holder.name == "ol" else "* "
            if holder and holder.name == "ol":
                holder.count += 1
            canvas.mark = mark
        elif name in ("dd", "blockquote"):
            canvas.indent += self.policy.list_indent
        elif name == "table":
            self.tables += 1
            element.table = Table()
            self.built.append(element.table)
        elif name == "tr":
            if (table := self.table()) is not None:
                table.rows.append([])
        elif name in ("td", "th"):
            span = found.get("colspan", "")
            element.span = min(max(int(span), 1), 1000) if re.fullmatch(r"\d{1,6}", span) else 1
            element.canvas = Canvas(self.policy)
            self.canvases.append(element.canvas)

    def table(self) -> Table | None:
        return self.built[-1] if self.built else None

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element with one of the names, -1 if there is none."""
        return max((at[-1] for name in names if (at := self.at.get(name))), default=-1)

    def row_open(self) -> bool:
        """A cell outside of tables is no part of a row."""
        return self.last(("tr",)) >= self.last(("table",))

    def end_implied(self, closing: set[str], walls: set[str]) -> None:
        """Ends all elements of closing that stand within the innermost wall."""
        wall = self.last(walls)
        first = min((at[bisect.bisect_right(at, wall)] for name in closing if (at := self.at.get(name)) and at[-1] > wall), default=-1)
        while 0 <= first < len(self.open):
            self.pop()

    def end_within(self, name: str, walls: Iterable[str]) -> None:
        at = self.last((name,))
        if at >= 0 and at >= self.last(x for x in walls if x != name):
            while len(self.open) > at:
                self.pop()

    def close(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif self.seen.get(name):
            self.end_within(name, frozenset(("table",)) if name in TABLE_PARTS - {"table"} else frozenset() if name in ("table", "body", "html") else SCOPE)

    def pop(self) -> None:
        element = self.open.pop()
        name, shown = element.name, not self.hidden
        self.seen[name] -= 1
        self.at[name].pop()
        self.hidden -= element.hides
        if name in ("ul", "ol", "menu"):
            self.holders.pop()
        if element.table is not None:
            self.built.pop()
        if element.canvas is not None:
            self.canvases.pop()
            table = self.table()
            cell = Cell(element.canvas.done(), element.span)
            if table is not None:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append(cell)
            else:
                self.put(cell.lines)
        elif not shown:
            return
        elif element.table is not None:
            self.put(element.table.rendered(self.policy))
            self.canvas.margin = 1
        else:
            canvas = self.canvas
            if name in BLOCKS:
                canvas.block(0 if name in ("ul", "ol", "menu") and self.seen.get("li") else BLOCKS[name])
            if name == "pre":
                self.pre -= 1
            elif name in ("ul", "ol", "menu", "dd", "blockquote"):
                canvas.indent -= self.policy.list_indent
            elif name == "li":
                canvas.mark = ""

    def put(self, lines: list[str]) -> None:
        for line in lines:
            self.canvas.parts = [line] if line else []
            self.canvas.line(True)


def render(source: str | None, policy: LayoutPolicy | None = None) -> tuple[str, int, int]:
    """(text, number of tables, number of list items)."""
    page = Page(policy or LayoutPolicy())
    lines = page.render(source or "")
    return "\n".join(lines), page.tables, page.items


def html_to_text(source: Column, policy: LayoutPolicy | None = None) -> Column:
    """struct(text, n_lines, n_tables, n_items)."""
    policy = policy or LayoutPolicy()
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_tables", pa.int64()), ("n_items", pa.int64())])

    def rendered(pages: pa.Array) -> pa.Array:
        out = []
        for x in pages:
            text, tables, items = render(x.as_py(), policy)
            out.append({"text": text, "n_lines": text.count("\n") + bool(text), "n_tables": tables, "n_items": items})
        return pa.array(out, kind)

    rendered.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(rendered, "text string, n_lines long, n_tables long, n_items long")(source)


def op9_html_extraction(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_to_text(F.col("html")).alias("page")).select("page_id", "page.*")
