"""Layout-aware text of HTML pages.

A tokenizer and tree builder with implied tags (head and body, list items,
paragraphs, table sections, rows and cells, options, definition lists) make a tree; a
renderer walks it.  It leaves out what a browser does not show, by its own rules for elements and by
the page's styles as cascade.py reads them: display takes an element with all that is in it,
visibility is inherited and may come back further down.  It emits all the rest, also the text of
drawings, what objects have for want of their data, a select's options, and values (or else
placeholders) of fields: blocks start on lines of their own, paragraphs, headings, lists and
tables are set off by an empty line, list items have their bullet or number (by the list's start, order
and type and the item's value) and
indent by depth, ``pre`` keeps its spacing, and table cells are padded to their columns.  What is a block, a
list item or a part of a table is told by the display value that styles give an element, else by its name.

Both walks use explicit stacks, so nesting depth is not limited, and the patterns
are possessive, so damaged markup costs linear time.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .cascade import VISIBILITY, Cascade, on_screen
from .common import id_text, rows_of, small_batches

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<[!?/](?![a-zA-Z])[^>]*+>?|<!\w[^>]*+>?"  # comments, declarations and what browsers take for comments
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:/?>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?")
BLANK = re.compile(r"[ \t\n\f\r]+")
#: Element classes of the HTML standard.  Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("title textarea".split())
HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
HIDDEN = frozenset("annotation annotation-xml area audio base basefont canvas datalist embed frame frameset head iframe link meta noembed noframes noscript param rp script source style template title track video".split())
#: Of drawings: elements that show nothing themselves; text is shown in ``text`` alone.
SVG_HIDDEN = frozenset("clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split())
SVG_TEXT = frozenset("text tspan textpath a".split())
#: Types of fields that show their value as text, and those of buttons.
FIELDS = frozenset("date datetime-local email month number search tel text time url week".split())
BUTTONS = frozenset("submit button reset".split())
BLOCK = frozenset("address article aside blockquote body center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp tr caption thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre listing hr figure fieldset".split())
CLOSES_P = BLOCK - frozenset("html body dd dt li option optgroup tr caption thead tbody tfoot legend".split()) | frozenset("li dd dt".split())
#: Start tag -> open elements that it closes, and the elements that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "h1": ({"h1", "h2", "h3", "h4", "h5", "h6"}, None), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
IMPLIED |= {f"h{i}": IMPLIED["h1"] for i in range(2, 7)}
#: Parts of tables that are laid out, and the values of display that make them.
PARTS = frozenset("table thead tbody tfoot tr td colgroup".split())
ROLES = {"table": "table", "inline-table": "table", "table-header-group": "thead", "table-row-group": "tbody", "table-footer-group": "tfoot", "table-row": "tr", "table-cell": "td", "table-column": "colgroup", "table-column-group": "colgroup"}
SCOPE = frozenset("html body table td th caption button object template".split())


class Node:
    """An element; shown: it has a box, seen: its own text is visible, display: that of the page's styles
    (styled() sets them); lines: of a table, once it is laid out."""

    __slots__ = ("attrs", "display", "kids", "lines", "name", "seen", "shown")

    def __init__(self, name: str, attrs: dict | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []
        self.shown = self.seen = True
        self.display = self.lines = None

    def role(self) -> str | None:
        """The part of a table that it is, by the element that has it; None if it's none."""
        if self.display is None:
            return "td" if self.name == "th" else self.name if self.name in PARTS else None
        return ROLES.get(self.display)

    def is_item(self) -> bool:
        return self.name == "li" if self.display is None else self.display == "list-item"


def parse(text: str) -> tuple[Node, list[str]]:
    """(tree, texts of style elements)."""
    root = Node("html")
    body = Node("body")
    head = Node("head")
    root.kids = [head, body]
    stack, styles, at, end, in_head = [root, body], [], 0, len(text), True

    opened: Counter = Counter()  # open elements by name, so that deep trees are searched only with cause

    def push(n: Node) -> None:
        stack.append(n)
        opened[n.name] += 1

    def pop_to(i: int) -> None:
        for n in stack[i:]:
            opened[n.name] -= 1
        del stack[i:]

    def open_of(names, stops) -> int | None:
        if not any(opened[x] for x in names):
            return None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stops and stack[i].name in stops:
                return None
        return None

    def data(raw: str) -> None:
        nonlocal in_head
        if raw:
            if in_head and raw.strip(" \t\n\f\r"):
                in_head = False
            stack[-1].kids.append(html.unescape(raw) if "&" in raw else raw)

    while at < end:
        i = text.find("<", at)
        if i < 0:
            data(text[at:])
            break
        m = TOKEN.match(text, i)
        if not m:
            data(text[at : i + 1])
            at = i + 1
            continue
        data(text[at:i])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in ("html", "body", "head"):
                in_head = in_head and name == "head"
                continue
            if name == "p" and open_of({"p"}, SCOPE) is None:
                stack[-1].kids.append(Node("p"))
                continue
            stops = {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else None if name == "table" else {"td", "th", "caption"}
            if (k := open_of({name}, stops)) is not None:
                if k == 1:
                    continue
                pop_to(k)
            elif name == "br":
                stack[-1].kids.append(Node("br"))
            continue
        attrs = {}
        if m["attrs"]:
            for a in ATTR.finditer(m["attrs"]):
                v = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                attrs.setdefault(a[1].lower(), html.unescape(v) if "&" in v else v)
        if name in ("html", "body"):
            target = root if name == "html" else body
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            in_head = in_head and name == "html"
            continue
        if name == "head":
            continue
        if name in HEAD and in_head:
            parent = head
        else:
            in_head = False
            if name in CLOSES_P and (k := open_of({"p"}, SCOPE)) is not None:
                pop_to(k)
            if name in IMPLIED:
                closes, stops = IMPLIED[name]
                if stops is None:
                    if stack[-1].name in closes:
                        pop_to(len(stack) - 1)
                else:
                    while (k := open_of(closes, stops)) is not None:
                        pop_to(k)
            if name == "tr" and stack[-1].name == "table":
                stack[-1].kids.append(n := Node("tbody"))
                push(n)
            elif name in ("td", "th"):
                if stack[-1].name == "table":
                    stack[-1].kids.append(n := Node("tbody"))
                    push(n)
                if stack[-1].name in ("tbody", "thead", "tfoot"):
                    stack[-1].kids.append(n := Node("tr"))
                    push(n)
            parent = stack[-1]
        node = Node(name, attrs)
        parent.kids.append(node)
        if name in RAW or name in RCDATA:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(text, at)
            inner, at = (text[at : close.start()], close.end()) if close else (text[at:], end)
            if name == "style":
                if attrs.get("type", "").strip().lower() in ("", "text/css") and on_screen(attrs.get("media", "")):
                    styles.append(inner)
            elif name == "textarea":
                node.kids.append(html.unescape(inner))
            elif name == "xmp":
                node.kids.append(inner)
        elif name == "plaintext":
            node.kids.append(text[at:])
            at = end
        elif name not in VOID and parent is not head and not (m[0].endswith("/>") and (opened["svg"] or opened["math"])):
            push(node)
        elif name == "template":
            push(node)
    return root, styles


def _display(value: str | None) -> str | None:
    """A value of display in one word: what is in the line is inline; None where the element's name tells."""
    words = (value or "revert").replace("-webkit-", "").split()
    if words[0] in ("revert", "revert-layer", "inherit"):
        return None
    for part in ("list-item", "table"):
        if part in words:
            return part
    if words[0].startswith("table-") or words[0] == "inline-table":
        return words[0]
    return "inline" if words[0] in ("contents", "initial", "unset") or any(w.startswith(("inline", "ruby", "-ms-inline")) for w in words) else "block"


def styled(root: Node, styles: list[str]) -> None:
    """Sets shown and seen of the elements from the root down; below what is not shown they are
    not set."""
    cascade, none = Cascade(styles), frozenset()
    stack = [(root, True, False, none, none)]
    while stack:
        node, visible, drawing, above, parent = stack.pop()
        name, a = node.name, node.attrs
        display, visibility = None, None
        if a or cascade.steps:
            display, visibility, above, parent = cascade.look(name, a, above, parent)
        if display in ("revert", "revert-layer"):
            display = None
        drawing = drawing and name != "foreignobject" or name == "svg"
        if name in HIDDEN or drawing and name in SVG_HIDDEN or name == "input" and a.get("type", "").strip().lower() == "hidden":
            node.shown = False
        elif display is not None:
            node.shown = display != "none"
        else:
            node.shown = not ("hidden" in a or name == "dialog" and "open" not in a)
        if node.shown:
            visible = VISIBILITY.get(visibility, visible)
            node.display = _display(display)
            node.seen = visible and (not drawing or name in SVG_TEXT)
            stack += [(k, visible, drawing, above, parent) for k in node.kids if not isinstance(k, str)]


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines under construction; block() and gap() ask for a break before the next text."""

    def __init__(self):
        self.lines, self.line, self.want, self.space, self.prefix, self.first = [], [], 0, False, "", None

    def block(self, want: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.want = max(self.want, want)

    def _open(self) -> None:
        if not self.line:
            if self.want > 1 and self.lines:
                self.lines.append("")
            self.want = 0
            lead = self.first if self.first is not None else self.prefix
            self.first = None
            if lead:
                self.line.append(lead)

    def text(self, s: str) -> None:
        parts = BLANK.sub(" ", s)
        if not parts:
            return
        if parts == " ":
            self.space = bool(self.line) or self.space
            return
        self.space = (self.space or parts[0] == " ") and bool(self.line) and not self.line[-1].endswith(" ")
        if self.space:
            self.line.append(" ")
        self._open()
        self.line.append(parts.strip(" "))
        self.space = parts[-1] == " "

    def pre(self, s: str) -> None:
        for i, row in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if row:
                self._open()
                self.line.append(row)

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif self.lines and not self.want:
            self.lines.append("")
        self.space = False

    def done(self) -> str:
        self.block(0)
        return "\n".join(self.lines).strip("\n")


def _rows(kids: list, css: bool) -> list:
    """A table's kids; cells outside rows get a row, and so does, in a table made by styles, all else."""
    out: list = []
    loose = None  # the row under way
    for kid in kids:
        blank = isinstance(kid, str) and not kid.strip(" \t\n\f\r")
        if blank or not isinstance(kid, str) and not kid.shown:
            continue
        role = None if isinstance(kid, str) else kid.role()
        if role == "td" or css and (role is None or role == "table") and getattr(kid, "display", None) != "table-caption":
            if loose is None:
                out.append(loose := Node("tr"))
                loose.display = "table-row"
            loose.kids.append(kid)
        else:
            out.append(kid)
            loose = None
    return out


def _cell_groups(row: Node, seen: bool):
    """(cell or None, kids, seen) of a row's cells; kids of no cell come with False for the cell.  What styles
    make no cell of shares one with its neighbours; text outside the cells of a tr element is not in the row."""
    shared: list = []
    for kid in row.kids:
        if isinstance(kid, str) and not kid.strip(" \t\n\f\r") or isinstance(kid, Node) and not kid.shown:
            continue
        if isinstance(kid, Node) and kid.role() == "td":
            if shared:
                yield None, shared, seen
                shared = []
            yield kid, kid.kids, kid.seen
        elif row.display is not None or isinstance(kid, Node) and kid.name in ("td", "th"):
            shared = [*shared, kid]
        else:
            yield False, [kid], seen
    if shared:
        yield None, shared, seen


def _table(node: Node) -> list[str]:
    """Rows of cells, each column padded to its widest line; what is outside rows comes before."""
    out, grid, spans = [], [], {}
    rows = []
    for kid in _rows(node.kids, node.name != "table"):
        role = None if isinstance(kid, str) else kid.role()
        if role == "colgroup":
            continue
        if role in ("tbody", "thead", "tfoot"):
            inner = _rows(kid.kids, kid.display is not None)
            rows += [(role, r) for r in inner if isinstance(r, Node) and r.role() == "tr"]
            if stray := [r for r in inner if not (isinstance(r, Node) and r.role() == "tr")]:
                out += _lines(stray, kid.seen)
        elif role == "tr":
            rows.append(("tbody", kid))
        else:
            out += _lines([kid], node.seen)
    rows = [r for k in ("thead", "tbody", "tfoot") for s, r in rows if s == k]
    for y, row in enumerate(rows):
        cells, x = {}, 0
        for cell, kids, seen in _cell_groups(row, row.seen):
            if cell is False:
                out += _lines(kids, seen)
                continue
            while spans.get(x, 0) > y:
                x += 1
            attrs = cell.attrs if cell else {}
            cols, down = (min(1000, int(v)) if (v := attrs.get(k, "1").strip()).isdigit() and int(v) else 1 for k in ("colspan", "rowspan"))
            cells[x] = (_lines(kids, seen), cols)
            for k in range(cols):
                if down > 1:
                    spans[x + k] = y + down
            x += cols
        grid.append(cells)
    sizes: dict[int, int] = {}
    for cells in grid:
        for x, (lines, cols) in cells.items():
            if cols == 1:
                sizes[x] = max([sizes.get(x, 0), *map(width, lines)])
    for cells in grid:
        columns, at, want = [], 0, 0  # lines of the cells and where they start
        for x in sorted(cells):
            lines, cols = cells[x]
            want += sum(sizes.get(i, 0) + 2 for i in range(at, x))
            columns.append((lines, want))
            want += sum(sizes.get(i, 0) + 2 for i in range(x, x + cols))
            at = x + cols
        for k in range(max((len(lines) for lines, _ in columns), default=0)):
            line = ""
            for lines, want in columns:
                if k < len(lines) and lines[k]:
                    line += " " * max(2 * bool(line), want - width(line)) + lines[k] if want else lines[k]
            out.append(line)
    return out


def _lines(kids: list, seen: bool) -> list[str]:
    """Lines of what is in a cell; those of a table that is alone in it as they are."""
    alone = [k for k in kids if not isinstance(k, str) and k.shown or isinstance(k, str) and k.strip(" \t\n\f\r")]
    if len(alone) == 1 and not isinstance(alone[0], str) and (lines := alone[0].lines) and lines[0] and lines[-1]:
        return lines
    text = render_nodes(kids, seen)
    return text.split("\n") if text else []


#: Elements that browsers keep open within each other at most, and so many tables with a section, a row
#: and a cell each; tables deeper than that are rendered as blocks.
OPEN_ELEMENTS = 512
TABLE_DEPTH = OPEN_ELEMENTS // 4


def lay_out_tables(root: Node) -> None:
    """Sets the lines of the tables below root, inner ones first, so that no table waits for another."""
    found, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node.role() == "table":
            depth += 1
            if depth <= TABLE_DEPTH:
                found.append(node)
        stack += [(k, depth) for k in node.kids if isinstance(k, Node) and k.shown]
    while found:
        table = found.pop()
        table.lines = _table(table)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def _number(n: int, kind: str) -> str:
    """An item's number in the list's type; decimal where the type has no sign for it."""
    if kind in ("a", "A") and n > 0:
        return _letters(n) if kind == "a" else _letters(n).upper()
    if kind in ("i", "I") and 0 < n < 4000:
        return _roman(n) if kind == "i" else _roman(n).upper()
    return str(n)


def _integer(value: str | None, other: int) -> int:
    m = re.match(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})(?![0-9])", value or "")
    return int(m[1]) if m else other


def render_nodes(kids: list, seen: bool = True) -> str:
    """Text of nodes whose parent's own text is seen or not."""
    page = Page()
    stack: list[tuple] = [("kids", iter(kids), False, seen)]
    lists: list[list] = []
    while stack:
        kind, it, pre, seen = stack[-1]
        kid = next(it, None) if kind == "kids" else None
        if kid is None:
            stack.pop()
            if kind == "after":
                it()
            continue
        if isinstance(kid, str):
            if seen:
                page.pre(kid) if pre else page.text(kid)
            continue
        name = kid.name
        if not kid.shown:
            continue
        seen = kid.seen
        if name == "br":
            page.newline()
            continue
        if name == "input":
            sort = kid.attrs.get("type", "").strip().lower() or "text"
            value = kid.attrs.get("value") or (kid.attrs.get("placeholder") if sort not in BUTTONS else "")
            if seen and value and (sort in BUTTONS or sort in FIELDS):
                page.text(f" {value} ")
            continue
        inner = kid.kids
        if name == "textarea" and not any(inner) and kid.attrs.get("placeholder"):
            inner = [kid.attrs["placeholder"]]
        if name == "details" and "open" not in kid.attrs:
            inner = [k for k in inner if isinstance(k, Node) and k.name == "summary"][:1]
        if kid.lines is not None:
            page.block(2)
            for line in kid.lines:
                if line:
                    page._open()
                    page.line.append(line)
                page.newline()
            page.block(2)
            continue
        if kid.display == "table-cell" and seen:
            page.text(" ")
        block = name in BLOCK or name in ("td", "th", "text") if kid.display is None else kid.display not in ("inline", "table-cell")
        want = 0 if not block else 2 if name in SPACED and not (name in ("ul", "ol", "menu", "dir") and lists) else 1
        before = (page.prefix, page.first)
        if block:
            page.block(want)
        if name in ("ul", "menu", "dir"):
            lists.append(["-", 0])
        elif name == "ol":
            step = -1 if "reversed" in kid.attrs else 1
            first = sum(isinstance(k, Node) and k.shown and k.is_item() for k in inner) if step < 0 else 1
            lists.append([kid.attrs.get("type", "1").strip(), _integer(kid.attrs.get("start"), first) - step, step])
        elif kid.is_item():
            mark = "- "
            if lists and lists[-1][0] != "-":
                lists[-1][1] = _integer(kid.attrs.get("value"), lists[-1][1] + lists[-1][2])
                mark = _number(lists[-1][1], kid.attrs.get("type", lists[-1][0]).strip()) + ". "
            page.first, page.prefix = page.prefix + mark if seen else None, page.prefix + " " * len(mark)
        elif name == "dd" and block:
            page.prefix += "    "
        elif name == "blockquote" and block:
            page.prefix += "> "
        elif name == "hr" and seen:
            page._open()
            page.line.append("---")

        def after(name=name, block=block, want=want, before=before, indented=kid.is_item() or block and name in ("dd", "blockquote"), cell=kid.display == "table-cell" and seen):
            if cell:
                page.text(" ")
            if block:
                page.block(want)
            if name in ("ul", "menu", "dir", "ol"):
                lists.pop()
            if indented:
                page.prefix, page.first = before[0], None

        stack.append(("after", after, pre, seen))
        if name == "q" and seen:
            page.text('"')
        stack.append(("kids", iter([*inner, '"'] if name == "q" else inner), pre or name in ("pre", "textarea", "listing", "xmp", "plaintext"), seen))
    return page.done()


def html_text(source: str) -> str:
    """All visible text of a page; the empty string of an empty page."""
    root, styles = parse(source.replace("\x00", ""))
    styled(root, styles)
    if not root.shown:
        return ""
    lay_out_tables(root)
    return render_nodes(root.kids, root.seen)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text): one row per row of pages.  Null html is an empty page, whose text
    is empty; repeated rows give repeated results; rows with a null id are left out."""
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            rows = list(rows_of([b]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_text(t) for _, t in rows], pa.string())], names=["page_id", "text"])

    return id_text(pages, id_col, html_col).mapInArrow(run, "page_id long, text string")
