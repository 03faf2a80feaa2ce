"""All visible text of an HTML page, laid out as a browser would."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
#: Widest column of a table. After a longer cell the row goes on below, so that every cell begins where its column does.
WIDEST_COLUMN = 80
#: Widest table, in characters, whose columns are aligned; in wider ones cells stand two spaces apart.
WIDEST_TABLE = 4096
#: Deepest indentation, in characters; what is nested deeper is indented as much.
DEEPEST_INDENT = 80
#: Elements nested deeper than this are put beside each other, as browsers do.
MOST_DEPTH = 512
# Fixed values of the HTML standard: most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
ESCAPABLE = frozenset("textarea title".split())
INVISIBLE = frozenset(
    "head script style template noembed noframes iframe title meta link datalist object audio video canvas rp".split()
)
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search "
    "section summary table caption ul xmp".split()
)
#: Blocks with an empty line around them.
SPACED = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol menu dl pre listing xmp plaintext blockquote table figure fieldset hr".split()
)
#: Elements that keep white space.
KEEPS_SPACE = frozenset("pre listing xmp plaintext textarea".split())
#: Types of inputs that show no text: boxes, sliders, pictures, and passwords, which are masked.
MUTE_INPUTS = frozenset("hidden checkbox radio file image range color password".split())
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}

#: What an opening tag ends if it is open: the tags ended, and those that the search for them stops at.
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "caption", "legend", "li", "dd", "dt"} | {"li", "dd", "dt"}
_SCOPE = frozenset("table td th caption html body button object template".split())
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), _SCOPE | {"ul", "ol", "menu"}),
    "dt": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), _SCOPE | {"dl"}),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
}

# A quote counts only after "="; a tag or quote that never ends takes the rest of the page, as in a browser.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_DECLARATION = re.compile(r"\s*(display|visibility|white-space)\s*:\s*([a-z-]+)\s*(!\s*important\s*)?", re.IGNORECASE)
_SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?([.#][\w-]+)?")
_ON_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)|", re.IGNORECASE)
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")
_SPACES = re.compile(r"[ \t\n\r\f]+")


#: How much a declaration counts: important, in the element, ids, classes, tags, place.
_Rank = tuple[bool, bool, bool, bool, bool, int]


def _declared(text: str) -> Iterator[tuple[str, str, bool]]:
    for part in text.split(";"):
        said = _DECLARATION.fullmatch(part)
        if said:
            yield said[1].lower(), said[2].lower(), bool(said[3])


class StyleSheet:
    """What a page's style sheets say of being displayed, being visible and keeping white space.

    Of their rules those count that hold on any screen and whose selector is a tag, a class, an id, a tag with one of
    these, or ``*``: looked up for an element by its own names, so time is linear in both. Other selectors are left out.
    """

    def __init__(self) -> None:
        self.said: dict[tuple[str, str], dict[str, tuple[_Rank, str]]] = {}
        self.place = 0

    def add(self, css: str, media: str = "") -> None:
        if not any(_ON_SCREEN.fullmatch(m.strip()) for m in media.split(",")):
            return
        holds: list[bool] = []  # of each open block, whether it counts
        selectors = ""
        for part in re.split(r"([^{}]*[{}])", _COMMENT.sub("", css)):
            if part[-1:] == "{":
                selectors = part[:-1].rpartition(";")[2].strip()
                name, _, condition = selectors.partition(" ")
                plain = name[:1] != "@"
                screen = name.lower() == "@media" and any(_ON_SCREEN.fullmatch(m.strip()) for m in condition.split(","))
                holds.append((plain or screen) and (not holds or holds[-1]))
            elif part[-1:] == "}" and holds:
                if holds.pop() and selectors and selectors[0] != "@":
                    self._rule(selectors, part[:-1])
                selectors = ""

    def _rule(self, selectors: str, declarations: str) -> None:
        found = list(_declared(declarations))
        for selector in selectors.split(",") if found else ():
            names = _SELECTOR.fullmatch(selector.strip())
            if not names or not names[0]:
                continue
            tag, own = (names[1] or "*").lower(), names[2] or ""
            told = self.said.setdefault((tag, own), {})
            for name, value, important in found:
                self.place += 1
                rank = (important, False, own[:1] == "#", own[:1] == ".", tag != "*", self.place)
                told[name] = max(told.get(name, (rank, value)), (rank, value))

    def of(self, node: Node) -> dict[str, str]:
        """The declarations that hold for an element, those of its own attribute included."""
        best: dict[str, tuple[_Rank, str]] = {}
        if self.said:
            own = ["", *(f".{name}" for name in node.attributes.get("class", "").split())]
            if "id" in node.attributes:
                own.append(f"#{node.attributes['id']}")
            for key in ((tag, name) for name in own for tag in (node.tag, "*")):
                for name, said in self.said.get(key, {}).items():
                    best[name] = max(best.get(name, said), said)
        for place, (name, value, important) in enumerate(_declared(node.attributes.get("style", ""))):
            said = ((important, True, False, False, False, place), value)
            best[name] = max(best.get(name, said), said)
        return {name: value for name, (_, value) in best.items()}


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def displayed(self, display: str | None) -> bool:
        """Whether it is there at all, with what it contains; ``display`` is what its style says."""
        if self.tag in INVISIBLE or display is not None:
            return self.tag not in INVISIBLE and display != "none"
        return "hidden" not in self.attributes and (self.tag != "dialog" or "open" in self.attributes)

    def number(self, name: str) -> int | None:
        said = _NUMBER.match(self.attributes.get(name, ""))
        return int(said[1]) if said else None

    def shown(self) -> list[Node | str]:
        """The children that are displayed, in that order.

        Of closed details only the first summary; of a table the first head first and the first foot last; of an option
        with a label that label.
        """
        if self.tag == "details" and "open" not in self.attributes:
            return self._first("summary")
        if self.tag == "table":
            head, foot = self._first("thead"), self._first("tfoot")
            moved = {id(node) for node in head + foot}
            return head + [child for child in self.children if id(child) not in moved] + foot
        if self.tag == "option" and self.attributes.get("label"):
            return [self.attributes["label"]]
        return self.children

    def _first(self, tag: str) -> list[Node | str]:
        return [child for child in self.children if isinstance(child, Node) and child.tag == tag][:1]


def _attributes(text: str) -> dict[str, str]:
    return {
        m[1].lower(): html.unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        for m in reversed(list(_ATTRIBUTE.finditer(text)))  # of a repeated attribute the first counts
    }


class TreeBuilder:
    """A tree of elements from tag soup. What a tag implies is opened or closed; no input is an error."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open, the last one last
        self.styles: list[Node] = []

    def _cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.at[self.stack.pop().tag].pop()

    def _last(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these tags is; 0 if none is."""
        return max((self.at[tag][-1] for tag in tags if self.at[tag]), default=0)

    def _end(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        at = self._last(tags)
        if at and at >= self._last(stop):
            self._cut(at)

    def _open(self, tag: str, attributes: dict[str, str] | None = None) -> Node:
        node = Node(tag, dict(attributes or {}))
        self.stack[min(len(self.stack) - 1, MOST_DEPTH)].children.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.stack))
            self.stack.append(node)
        return node

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._end(frozenset(["head"]), frozenset())
                self._open(tag, attributes)
            else:
                self.root.attributes |= attributes
            return
        if self.stack[-1].tag == "head" and tag not in HEAD_ONLY:
            self._cut(len(self.stack) - 1)
        if tag in CLOSES_P:
            self._end(frozenset(["p"]), _SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        table = self._last(["table"])
        if table and tag in ("td", "th", "tr"):
            self._end(frozenset(["caption", "colgroup"]), frozenset(["table"]))
            if self._last(["thead", "tbody", "tfoot"]) < table:
                self._open("tbody")
            if tag != "tr" and self._last(["tr"]) < table:
                self._open("tr")
        if tag[0] == "h" and len(tag) == 2 and self.stack[-1].tag[:1] == "h" and self.stack[-1].tag[1:].isdigit():
            self._cut(len(self.stack) - 1)
        self._open(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._open("br")
            return
        if tag == "p" and not self.at["p"]:
            self._open("p")
        stop = frozenset(["table"]) if tag not in ("table", "body", "html") else frozenset()
        if tag not in ("html", "body"):  # what comes after them belongs to the body
            self._end(frozenset([tag]), stop - {tag})

    def text(self, text: str) -> None:
        if self.stack[-1].tag == "head" and text.strip():
            self._cut(len(self.stack) - 1)
        if text:
            self.stack[-1].children.append(text)


def parse(page: str) -> tuple[Node, StyleSheet]:
    """The tree of a page and what its style sheets say."""
    builder, sheet, at = TreeBuilder(), StyleSheet(), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            builder.text(html.unescape(page[at:]))
            break
        builder.text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                builder.text(m[0][9:].removesuffix("]]>"))
            continue
        if m[0][-1] != ">":
            break
        tag = m[2].lower()
        if m[1]:
            builder.end(tag)
            continue
        builder.start(tag, _attributes(m[3]) if m[3] else {})
        if tag in RAW or tag in ESCAPABLE:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            until = close.start() if close else len(page)
            inner = page[at:until]
            builder.text(html.unescape(inner) if tag in ESCAPABLE else inner)
            if tag == "style" and not builder.at["template"]:
                sheet.add(inner, builder.stack[-1].attributes.get("media", ""))
            at = until
            if not close:
                break
    return builder.root, sheet


class Writer:
    """Lines of laid out text: white space collapses, breaks between blocks do not add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0  # empty lines wanted before the next line
        self.indent = 0
        self.marker = ""

    def text(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words[:-1] if self.space else words)

    def verbatim(self, text: str) -> None:
        first, *others = text.replace("\r\n", "\n").split("\n")
        self.parts += [" ", first] if self.space and self.parts else [first]
        self.space = False
        for line in others:
            self.line(keep=True)
            self.parts.append(line)

    def lines_of(self, text: str) -> None:
        """Text whose line breaks count and whose other white space collapses."""
        for n, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if n:
                self.line(keep=True)
            self.text(line)

    def line(self, keep: bool = False) -> None:
        """End the line. An empty one counts only if it is to be kept."""
        line = "".join(self.parts)
        self.parts, self.space = [], False
        if not line and not keep:
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        marker, self.marker = self.marker, ""
        head = " " * min(max(0, self.indent - len(marker)), DEEPEST_INDENT) + marker
        self.lines.append((head + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced and self.lines:
            self.gap = max(self.gap, 1)

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


@dataclass(slots=True)
class _Cell:
    lines: list[str]
    columns: int = 1
    rows: int = 1
    at: int = 0  # its first column


@dataclass(slots=True)
class _Table:
    rows: list[list[_Cell]] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)  # rows that a row group begins with


def _width(text: str) -> int:
    """Places that a text takes: two for wide characters, none for those that combine with the one before."""
    if text.isascii():
        return len(text)
    wide = sum(unicodedata.east_asian_width(c) in "WF" for c in text)
    return len(text) + wide - sum(unicodedata.category(c) in ("Mn", "Me", "Cf") for c in text)


def _placed(table: _Table) -> list[int]:
    """Give every cell its column: the first that no cell from above reaches into. Returns the widths of the columns."""
    widths: list[int] = []
    taken: list[int] = []  # of each column the first row that is free again
    ends = sorted({*table.groups, len(table.rows)})
    for n, row in enumerate(table.rows):
        at, group_end = 0, next(end for end in ends if end > n)
        for cell in row:
            while at < len(taken) and taken[at] > n:
                at += 1
            cell.at = at
            cell.columns = min(cell.columns, max(1, MOST_COLUMNS - at))  # so that only cells make a table wider than that
            taken += [0] * (at + cell.columns - len(taken))
            until = min(n + cell.rows if cell.rows else group_end, group_end)
            for column in range(at, at + cell.columns):
                taken[column] = max(taken[column], until)
            widths += [0] * (at + cell.columns - len(widths))
            if cell.columns == 1:
                widths[at] = max(widths[at], min(max(map(_width, cell.lines)), WIDEST_COLUMN))
            at += cell.columns
    return widths


def lay_out(table: _Table) -> list[str]:
    """Lines of a table: every line of a cell begins where its column does, columns two spaces apart."""
    begins = [0]
    for width in _placed(table):
        begins.append(begins[-1] + width + 2)
    aligned = begins[-1] <= WIDEST_TABLE
    lines = []
    for row in table.rows:
        if not any(any(cell.lines) for cell in row):
            continue
        for n in range(max(len(cell.lines) for cell in row)):
            parts, length = [], 0
            for cell in row:
                text = cell.lines[n] if n < len(cell.lines) else ""
                if not text:
                    continue
                begin = begins[cell.at] if aligned else length + 2 * bool(parts)
                if parts and length + 2 > begin:  # a longer cell reaches into this column
                    lines.append("".join(parts))
                    parts, length = [], 0
                parts += [" " * (begin - length), text]
                length = begin + _width(text)
            lines.append("".join(parts).rstrip())
    return lines


@dataclass(slots=True)
class _List:
    """An open list: what its next item is numbered, by how much that grows; no number for bullets."""

    number: int | None = None
    step: int = 1


def _opened_list(node: Node) -> _List:
    if node.tag != "ol":
        return _List()
    start = node.number("start")
    if "reversed" not in node.attributes:
        return _List(1 if start is None else start)
    items = sum(isinstance(child, Node) and child.tag == "li" for child in node.children)
    return _List(items if start is None else start, -1)


def _marker(node: Node, lists: list[_List]) -> str:
    if not lists or lists[-1].number is None:
        return "- "
    own = node.number("value")
    if own is not None:
        lists[-1].number = own
    number = lists[-1].number
    lists[-1].number += lists[-1].step
    return f"{number}. "


def _typed(node: Node) -> str:
    """What an input shows: what was typed into it or else its placeholder, the label of a button."""
    kind, value = node.attributes.get("type", "").strip().lower(), node.attributes.get("value")
    if kind in BUTTONS:
        return BUTTONS[kind] if value is None else value
    return "" if kind in MUTE_INPUTS else value or node.attributes.get("placeholder", "")


def visible_text(page: str | None) -> str:
    """The page's visible text. Iterative, so depth is no limit."""
    if not page:
        return ""
    writers = [Writer()]
    tables: list[_Table] = []
    lists: list[_List] = []
    indents: list[int] = []  # of each open list item, by how much it is indented
    visible = [True]  # of each open element, whether its own text is
    spaces = ["normal"]  # of each open element, what becomes of white space
    quotes = 0
    root, sheet = parse(page)
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, opening = todo.pop()
        out = writers[-1]
        if isinstance(node, str):
            if not visible[-1] or (tables and len(writers) <= len(tables) and not node.strip()):
                continue
            if spaces[-1] in ("pre", "pre-wrap", "break-spaces"):
                out.verbatim(node)
            elif spaces[-1] == "pre-line":
                out.lines_of(node)
            else:
                out.text(node)
            continue
        tag = node.tag
        if opening:
            said = sheet.of(node)
            if not node.displayed(said.get("display")):
                continue
            if tag == "br":
                out.line(keep=True)
                continue
            if tag == "hr":
                out.block(True)
                out.parts.append("---")
                out.block(True)
                continue
            shown = {"visible": True, "hidden": False, "collapse": False}.get(said.get("visibility", ""), visible[-1])
            if tag == "input":
                if shown:
                    out.text(_typed(node))
                continue
            visible.append(shown)
            spaces.append(said.get("white-space", "pre" if tag in KEEPS_SPACE else spaces[-1]))
            todo.append((node, False))
            todo += [(child, True) for child in reversed(node.shown())]
            if tag == "table":
                out.block(True)
                tables.append(_Table())
            elif tables and tag in ("thead", "tbody", "tfoot"):
                tables[-1].groups.append(len(tables[-1].rows))
            elif tables and tag == "tr":
                tables[-1].rows.append([])
            elif tables and tag in ("td", "th"):
                writers.append(Writer())
            elif tag in BLOCKS:
                out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag in ("ul", "menu", "ol"):
                lists.append(_opened_list(node))
            elif tag == "li":
                marker = _marker(node, lists)
                out.marker = marker if visible[-1] else ""
                indents.append(len(marker))
                out.indent += len(marker)
            elif tag in ("dd", "blockquote"):
                out.indent += 2
            elif tag == "optgroup" and shown:
                out.text(node.attributes.get("label", ""))
                out.line()
            elif tag == "q":
                out.text("\u201c\u2018"[quotes % 2] if shown else "")
                quotes += 1
            elif tag in KEEPS_SPACE and node.children and isinstance(node.children[0], str):
                todo[-1] = (re.sub(r"\A\r?\n", "", node.children[0]), True)
            elif tag == "textarea" and shown:
                out.text(node.attributes.get("placeholder", ""))
            continue
        shown = visible.pop()
        spaces.pop()
        if tag == "table":
            for line in lay_out(tables.pop()):
                out.parts.append(line)
                out.line(keep=True)
            out.block(True)
        elif tables and tag in ("thead", "tbody", "tfoot"):
            tables[-1].groups.append(len(tables[-1].rows))
        elif tables and tag in ("td", "th"):
            lines = writers.pop().done().split("\n")
            columns, rows = node.number("colspan"), node.number("rowspan")
            columns = min(columns, MOST_COLUMNS) if columns and columns > 0 else 1
            rows = 1 if rows is None or rows < 0 else min(rows, MOST_ROWS)
            if not tables[-1].rows:
                tables[-1].rows.append([])
            tables[-1].rows[-1].append(_Cell(lines, columns, rows))
        else:
            if tag in BLOCKS:
                out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
            if tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            elif tag == "li":
                out.indent, out.marker = out.indent - indents.pop(), ""
            elif tag in ("dd", "blockquote"):
                out.indent -= 2
            elif tag == "q":
                quotes -= 1
                out.text("\u201d\u2019"[quotes % 2] if shown else "")
    return writers[0].done()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, size, out = 0, 0, []
        for i in range(batch.num_rows):
            out.append(visible_text(batch.column(1)[i].as_py()))
            size += len(out[-1])
            if size >= BATCH_BYTES or i == batch.num_rows - 1:
                ids = batch.column(0).slice(start, i + 1 - start)
                yield pa.record_batch([ids, pa.array(out, pa.string())], names=["id", "text"])
                start, size, out = i + 1, 0, []


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: ``id_col`` and text, the page's visible text.

    A tree builder opens and closes what tags imply. Elements that a browser does not display (scripts, styles, the head,
    templates, ``hidden``, ``display: none``, a ``dialog`` that isn't open, what closed ``details`` hold but their summary)
    are left out with all they contain. ``visibility`` is inherited, so visible parts of invisible elements are there.
    Style sheets of the page count as :class:`StyleSheet` says, ``style`` attributes and ``!important`` above them. All
    else is emitted: what inputs hold or else their placeholders (passwords never), labels of option groups, quotation
    marks of ``q``; a table's ``thead`` first and its ``tfoot`` last. Paragraphs, headings, lists and tables have an empty line around them, other blocks a line break;
    list items have bullets or numbers (``start``, ``value`` and ``reversed`` count) and nested ones are indented; table
    cells begin where their columns do (wide characters take two places), with what spans columns or rows in its place;
    ``pre``, ``textarea`` and ``white-space`` keep white space. Time is linear in the page, whatever its markup, but for
    tables in tables, whose lines are laid out once a level, of which ``MOST_DEPTH`` bounds the number. Pages are
    independent: no shuffle.

    Null and empty pages give empty texts; broken markup is no error. Repeated rows and null ids are passed through.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"id {kind}, text string").withColumnRenamed("id", id_col)
