"""HTML extraction by layout-aware rendering.

A tree builder reads tags with the implied ones (open paragraphs, list items, cells and rows end where HTML ends
them), raw-text elements and stray end tags; visibility rules leave out what a browser doesn't show (head, scripts,
styles, templates, hidden attributes, closed details, and display and visibility of style attributes and of style
sheets' simple selectors, by weight and order, with media rules as on a screen of SCREEN pixels).  The renderer then writes
all visible text: white space collapses outside pre, blocks start on lines of their own and paragraphs after a blank line,
list items get bullets or numbers with indentation, and the cells of tables are aligned in columns, line by line.  The
work is one map over pages, each page by itself; nothing is shuffled.

Defined cases: null or empty html gives an empty text; repeated rows are rendered each on its own; a null page_id is
carried; an empty table gives no rows; elements nested deeper than MAX_DEPTH hang at that depth, their text is kept;
broken or unclosed markup never fails; other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import trimmed

#: Browsers bound the depth of a tree too.
MAX_DEPTH = 512
#: Columns are not padded beyond this width; wider cells run over.
MAX_WIDTH = 60
# Fixed values of HTML: cells span so many columns and rows at most.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
TOKEN = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Fixed values of HTML: which elements have no content, hold raw text, are blocks, are never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
UNSEEN = frozenset("annotation area audio base canvas datalist defs desc head iframe link meta metadata noembed noframes noscript object param rp script source style template title track video".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
LISTS = frozenset(("ul", "ol", "menu", "dir"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What an opening tag ends: itself among these, up to the nearest of the scopes.
IMPLIED = {
    "li": (("li",), LISTS),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist"))),
    "optgroup": (("option", "optgroup"), frozenset(("select",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "tr": (("tr", "td", "th"), frozenset(("table",))),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(("table",))),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(("table",))),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), frozenset(("table",))),
}
WALLS = frozenset(("table", "td", "th", "caption", "html", "template", "button", "object"))


COMMENT = re.compile(r"(?s)/\*.*?\*/")
SIMPLE = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
SHOWN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
MEDIA = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)\s*(px|em|rem)\s*\)")
#: The window that conditions of style sheets are tried on: a screen of so many pixels, and pixels of 1em.
SCREEN, EM = 1280, 16


def applies(query: str) -> bool:
    """Whether a media query holds for the screen; conditions other than on its width don't."""

    def one(part: str) -> bool:
        words = part.split()
        negated = bool(words) and words[0] == "not"
        rest = MEDIA.sub(" ", " ".join(words[1:] if words and words[0] in ("not", "only") else words))
        names = [w for w in rest.split() if w != "and"]
        widths = all((SCREEN >= px if low == "min" else SCREEN <= px) for low, px in ((m[0], float(m[1]) * (1 if m[2] == "px" else EM)) for m in MEDIA.findall(part)))
        return (widths and all(n in ("all", "screen") for n in names)) != negated

    try:
        return any(one(part) for part in query.lower().split(","))
    except ValueError:  # a number such as 1.2.3
        return False


def rules(css: str):
    """(selectors, declarations) of a style sheet that apply: at-rules of conditions are entered where these hold."""
    css = COMMENT.sub(" ", css)
    at, stack, start = 0, [True], 0
    for m in re.finditer(r"[{};]", css):
        if m.start() < at:
            continue
        mark = m.group()
        if mark == "{":
            head = css[start : m.start()].strip()
            if head.startswith("@"):
                name, _, query = head[1:].partition(" ") if " " in head else (head[1:], "", "")
                name, paren, more = name.lower().partition("(")
                # of other at-rules (fonts, key frames, containers) nothing applies to elements as they are
                inside = applies(paren + more + " " + query) if name == "media" else name in ("supports", "layer", "document", "scope")
                stack.append(stack[-1] and inside)
                start = m.end()
            else:
                end = css.find("}", m.end())
                end = len(css) if end < 0 else end
                if stack[-1]:
                    yield head, css[m.end() : end]
                at = start = end + 1
        elif mark == "}":
            if len(stack) > 1:
                stack.pop()
            start = m.end()
        else:
            start = m.end()


def sheet(css: str) -> dict[str, list]:
    """What a style sheet says of showing elements, by simple selectors: for each tag, .class or #id one of a selector's
    parts, (all parts, property, value, weight); more weight wins. Selectors of other kinds are passed over."""
    out: dict[str, list] = {}
    for order, (head, body) in enumerate(rules(css)):
        found = SHOWN.findall(body)
        if not found:
            continue
        for part in head.split(","):
            m = SIMPLE.fullmatch(part.strip())
            if not m or not m.group(0):
                continue
            tag, marks = (m.group(1) or "*").lower(), re.findall(r"[.#][\w-]+", m.group(2))
            names = ([tag] if tag != "*" else []) + marks
            specific = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), len(names) - len(marks))
            key = next((x for x in marks if x[0] == "#"), marks[0] if marks else tag)
            out.setdefault(key, []).extend((names, name.lower(), value.lower(), (bool(important), False, specific, order, k)) for k, (name, value, important) in enumerate(found))
    return out


def styled(node: "Node", held: dict[str, str], by: dict[str, list]) -> None:
    """Sets whether the node is shown, by its attributes and the style sheet."""
    names = {node.tag, "*", "#" + held.get("id", ""), *("." + c for c in held.get("class", "").split())}
    best: dict[str, tuple] = {}
    found = [x for n in names for x in by.get(n, ()) if all(y in names for y in x[0])] if by else []
    if "style" in held:
        found += [([], name.lower(), value.lower(), (bool(important), True, (0, 0, 0), 0, k)) for k, (name, value, important) in enumerate(SHOWN.findall(held["style"]))]
    for _, name, value, weight in found:
        if name not in best or weight > best[name][0]:
            best[name] = weight, value
    display = best.get("display", (None, ""))[1]
    away = "hidden" in held and held["hidden"].lower() != "until-found"
    if node.tag == "input" and held.get("type", "").lower() == "hidden":
        display = "none"
    node.seen = node.tag not in UNSEEN and (display != "none" if display else not away)
    if "visibility" in best:
        node.visible = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(best["visibility"][1])


class Node:
    """An element: seen if it has a box; visible or not if its style says so, None if it is as its parent is."""

    __slots__ = ("tag", "attrs", "children", "seen", "visible")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []
        self.seen, self.visible = tag not in UNSEEN, None
        if attrs and self.seen and ("hidden" in (low := attrs.lower()) or "style" in low):
            styled(self, attributes(attrs), {})

    def attr(self, name: str) -> str | None:
        return attributes(self.attrs).get(name) if self.attrs else None


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def tree(html: str) -> Node:
    """The document's tree: nodes and strings."""
    root = Node("#root", "")
    stack, at, text_from = [root], 0, 0
    sheets: list[str] = []
    search, last = TOKEN.search, html.rfind(">")
    paragraphs = 0

    def end_to(depth: int) -> None:
        nonlocal paragraphs
        for node in stack[depth:]:
            paragraphs -= node.tag == "p"
        del stack[depth:]

    def find(tags, walls) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in walls:
                return 0
        return 0

    while at <= last or html.startswith("<!--", at):
        m = search(html, at)
        if m is None:
            break
        if m.start() > text_from:
            stack[-1].children.append(html[text_from : m.start()])
        at = text_from = m.end()
        name = m.group(2)
        if not name:
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "p" and not paragraphs:
                stack[-1].children.append(Node("p", ""))
            elif tag in ("br",):
                stack[-1].children.append(Node("br", ""))
            else:
                walls = () if tag in ("table", "html", "body") else ("table",) if tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption") else WALLS - {tag}
                i = find(HEADINGS if tag in HEADINGS else (tag,), walls)
                if i:
                    end_to(i)
            continue
        if paragraphs and tag in ENDS_P:
            i = find(("p",), WALLS)
            if i:
                end_to(i)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            end_to(len(stack) - 1)
        implied = IMPLIED.get(tag)
        if implied:
            tags, walls = implied
            while i := find(tags, walls):
                end_to(i)
        elif stack[-1].tag in ("head",) and tag not in UNSEEN and tag not in ("style", "script"):
            end_to(len(stack) - 1)
        node = Node(tag, m.group(3))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            stop = end.start() if end else len(html)
            node.children.append(html[at:stop])
            if tag == "style" and applies(node.attr("media") or "all"):
                sheets.append(html[at:stop])
            at = text_from = end.end() if end else len(html)
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
            paragraphs += tag == "p"
    if text_from < len(html):
        stack[-1].children.append(html[text_from:])
    if sheets and (by := sheet("\n".join(sheets))):
        below = [root]
        while below:
            for c in below.pop().children:
                if isinstance(c, Node):
                    if c.seen or c.tag not in UNSEEN:
                        styled(c, attributes(c.attrs) if c.attrs else {}, by)
                    below.append(c)
    return root


class Writer:
    """Collects words, and puts the space or line breaks between them that are due."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap = 0
        self.space = False
        self.indents: list[str] = []
        self.marker = ""
        self.fresh = True  # at a line's start

    def block(self, gap: int) -> None:
        if self.out and not (self.marker and self.fresh):
            self.gap = max(self.gap, gap)
        self.space = False

    def _lead(self) -> None:
        if self.gap and self.out:
            self.out.append("\n" * self.gap)
            self.fresh = True
        self.gap = 0
        if self.fresh:
            indent = "".join(self.indents)
            self.out.append(indent[: len(indent) - len(self.marker)] + self.marker if self.marker else indent)
            self.marker = ""
        elif self.space:
            self.out.append(" ")
        self.fresh = self.space = False

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.space = self.space or bool(s) and not self.fresh and not self.gap
            return
        if s[0].isspace() and not self.fresh and not self.gap:
            self.space = True
        self._lead()
        self.out.append(" ".join(words))
        self.space = s[-1].isspace()

    def lines(self, s: str) -> None:
        """Text whose white space stays."""
        for i, line in enumerate(s.split("\n")):
            if i:
                self.gap = min(self.gap + 1, 2)
            if line.strip():
                self._lead()
                self.out.append(line.rstrip())

    def done(self) -> str:
        return "".join(self.out)


def render(root: Node, depth: int = 0, visible: bool = True) -> str:
    w = Writer()
    stack: list = [(root, False, visible)]
    counters: list[list] = []
    pre = 0
    while stack:
        node, closing, visible = stack.pop()
        if isinstance(node, str):
            if "&" in node:
                node = unescape(node)
            if not visible:
                node = " " if node.strip() == "" or node[0].isspace() or node[-1].isspace() else ""
            w.lines(node) if pre else w.text(node)
            continue
        tag = node.tag
        visible = visible if node.visible is None else node.visible
        if closing:
            if tag in LISTS:
                counters.pop()
            elif tag == "pre":
                pre -= 1
            elif tag in ("li", "dd", "blockquote"):
                w.indents.pop()
                w.marker = ""
            w.block(2 if tag in SPACED and not (tag in LISTS and counters) else 1)
            continue
        if not node.seen:
            continue
        if tag == "br":
            w.gap = min(w.gap + 1, 2) if w.out else 0
            w.space = False
            continue
        if tag == "wbr":
            continue
        if tag in ("input",):
            kind = (node.attr("type") or "text").lower()
            if visible and kind in ("submit", "button", "reset") and node.attr("value"):
                w.text(f" {node.attr('value')} ")
            continue
        if tag == "table" and depth < 20:
            w.block(2)
            for line in table(node, depth, visible):
                w.lines(line)
                w.block(1)
            w.block(2)
            continue
        children = node.children
        if tag in ("details", "dialog") and node.attr("open") is None:
            children = [c for c in children if tag == "details" and isinstance(c, Node) and c.tag == "summary"]
        if tag in BLOCK:
            w.block(2 if tag in SPACED and not (tag in LISTS and counters) else 1)
            if tag in LISTS:
                first = node.attr("start") if tag == "ol" else None
                counters.append([tag, int(first) if first and re.fullmatch(r"-?[0-9]{1,9}", first) else 1])
            elif tag == "li":
                marker = "- "
                if counters and counters[-1][0] == "ol":
                    marker = f"{counters[-1][1]}. "
                    counters[-1][1] += 1
                w.indents.append(" " * len(marker))
                w.marker, w.fresh = marker if visible else "", w.fresh or bool(w.gap)
            elif tag in ("dd", "blockquote"):
                w.indents.append("  ")
            elif tag == "pre":
                pre += 1
            stack.append((node, True, visible))
        stack.extend((c, False, visible) for c in reversed(children))
    return w.done()


def has_cells(node: Node) -> bool:
    """Whether cells of the row around are below node: those of a table within are its own."""
    stack = [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node) and c.seen and c.tag != "table":
                if c.tag in ("td", "th"):
                    return True
                stack.append(c)
    return False


def shown(node: Node, visible: bool) -> bool:
    return visible if node.visible is None else node.visible


def cells_of(row: Node, visible: bool) -> tuple[list[tuple[Node, bool]], list[tuple[Node, bool]]]:
    """Cells of a row, also those within forms and other elements, and what else is in it; each with its visibility."""
    cells, others = [], []
    stack: list = [(c, visible) for c in reversed(row.children)]
    while stack:
        c, v = stack.pop()
        if isinstance(c, str):
            if c.strip():
                others.append((around(c), v))
        elif not c.seen:
            continue
        elif c.tag in ("td", "th"):
            cells.append((c, shown(c, v)))
        elif c.tag != "table" and has_cells(c):
            stack.extend((x, shown(c, v)) for x in reversed(c.children))
        else:
            others.append((around(c), v))
    return cells, others


def around(child) -> Node:
    """A root with one child, which keeps its own tag, as it may be a table or a button."""
    root = Node("#root", "")
    root.children = [child]
    return root


def rows_of(node: Node, visible: bool) -> tuple[list, list[list[tuple[Node, bool]]], list]:
    """Captions, rows of cells, and what else is in a table; each with its visibility."""
    captions, rows, rest = [], [], []
    stack: list = [(c, visible) for c in reversed(node.children)]
    while stack:
        c, v = stack.pop()
        if isinstance(c, str):
            if c.strip():
                rest.append((around(c), v))
            continue
        if not c.seen:
            continue
        if c.tag == "caption":
            captions.append((c, shown(c, v)))
        elif c.tag == "tr":
            cells, others = cells_of(c, shown(c, v))
            rows.append(cells)
            rest += others
        elif c.tag in ("td", "th"):
            rows.append([(c, shown(c, v))])
        elif c.tag in ("thead", "tbody", "tfoot", "colgroup", "form"):
            stack.extend((x, shown(c, v)) for x in reversed(c.children))
        else:
            rest.append((around(c), v))
    return captions, rows, rest


def spans(cell: Node, name: str, most: int) -> int:
    value = cell.attr(name) or "1"
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def inside(node: Node) -> Node:
    """A copy of a cell or other element as a root of its own."""
    root = Node("#root", "")
    root.children = node.children
    return root


def holds_table(node: Node) -> bool:
    stack = [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node) and c.seen:
                if c.tag == "table":
                    return True
                stack.append(c)
    return False


def table(node: Node, depth: int, visible: bool) -> list[str]:
    """The lines of a table: cells stand in columns of one width, each below the other where a cell has several lines.
    Rows with a table in a cell are layout: their cells follow one another."""
    captions, rows, rest = rows_of(node, visible)
    out = [line for c, v in captions for line in render(inside(c), depth + 1, v).split("\n")]
    out += [line for r, v in rest for line in render(r, depth + 1, v).split("\n")]
    grid: list[tuple[bool, list[tuple[int, list[str]]]]] = []  # per row: whether layout; (column, lines) of its cells
    taken: dict[int, int] = {}  # rows that columns are still taken by a cell from above
    for row in rows:
        line: list[tuple[int, list[str]]] = []
        column = 0
        now = taken
        taken = {k: n - 1 for k, n in now.items() if n > 1}
        for cell, v in row:
            while now.get(column):
                column += 1
            wide, tall = spans(cell, "colspan", MAX_COLSPAN), spans(cell, "rowspan", MAX_ROWSPAN)
            line.append((column, render(inside(cell), depth + 1, v).split("\n")))
            if tall > 1:
                taken.update((k, max(tall - 1, taken.get(k, 0))) for k in range(column, column + wide))
            column += wide
        grid.append((any(holds_table(cell) for cell, _ in row), line))
    widths: dict[int, int] = {}
    for layout, line in grid:
        for k, lines in line:
            widths[k] = max(widths.get(k, 0), 0 if layout else max(min(len(x), MAX_WIDTH) for x in lines))
    columns = sorted(widths)
    for layout, line in grid:
        if layout:
            out += [x for _, lines in line for x in lines]
            continue
        held = dict(line)
        for i in range(max((len(lines) for _, lines in line), default=0)):
            s = " | ".join((held[k][i] if k in held and i < len(held[k]) else "").ljust(widths[k]) for k in columns).rstrip()
            if s.strip(" |"):
                out.append(s)
    return out


def visible_text(html: str | None) -> str:
    return render(tree(html)).strip("\n") if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in trimmed(batches):
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                out = [visible_text(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long")
