"""HTML extraction by layout-aware rendering.

A tokenizer reads tags and attributes as browsers do; a tree builder with implied start
and end tags turns them into nodes; visibility rules drop what a browser would not show;
a renderer then writes all visible text, with blank lines round paragraphs, markers
before list items and table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
PLAIN = frozenset(("textarea", "title"))
HIDDEN = frozenset("head script style template noscript title meta link iframe object embed audio video canvas datalist param source track area map noembed noframes rp meter progress".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr menu fieldset xmp listing plaintext".split())
BLOCK = SPACED | frozenset("html body dialog address article aside details dd div dt figcaption footer form header hgroup legend li main nav search section summary center caption tr thead tbody tfoot td th option optgroup textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
EXACT = frozenset("pre textarea xmp listing plaintext".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt xmp listing plaintext".split())
#: A start tag closes an open element of these names, up to the scope beside them.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}
#: Elements only found in a head; anything else closes an open head.
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
#: An end tag looks no further than these for its start tag.
FENCES = frozenset("table td th caption button template".split())
TABLE_PARTS = frozenset("tr td th tbody thead tfoot table caption".split())
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: A table part closes what is open between it and these, as a form or link that stands round cells.
PLACES = {"td": {"tr"}, "th": {"tr"}, "tr": ROW_GROUPS | {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Parts of svg and math that show no text.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask annotation annotation-xml".split())
#: Inputs that show their value.
VALUED = frozenset(("", "text", "search", "url", "tel", "email", "number", "submit", "button", "reset"))
#: Values of the display property beside none; others are no declarations.
DISPLAYS = frozenset("block inline inline-block flow flow-root list-item flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption ruby contents run-in initial inherit unset revert revert-layer".split())
VISIBILITIES = frozenset(("visible", "hidden", "collapse"))

#: A tree is at most so deep, as in browsers; what would stand deeper follows its parent.
DEPTH = 512
#: Columns of a table are aligned as far as this character of a line; cells beyond just follow.
LINE = 320

#: White space of markup. It collapses in text; a no-break space does not.
COLLAPSE = re.compile(r"[ \t\n\f\r]+")
_ATTRIBUTE = r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|(?!["'])([^ \t\n\f\r>]*+)))?+"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<\?[^>]*(?:>|\Z)|<!(?!--)[^>]*(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + r")*+)(>|\Z)",
    re.S,
)
_ENDS: dict[str, re.Pattern] = {n: re.compile(rf"</{n}(?=[ \t\n\f\r/>])[^>]*(?:>|\Z)", re.I) for n in RAW | PLAIN}
DECLARATION = re.compile(r"([-\w]++)\s*+:((?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z)|[^;\"'(])*+)")
INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,18})(?![0-9])")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str] | None = None):
        self.name, self.attributes, self.children = name, attributes or {}, []


def _attributes(source: str) -> dict[str, str]:
    """The first of each name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def tokens(markup: str):
    """Triples of a document: ("text", text, None), ("start", name, attributes) and ("end", name, None).

    Comments, declarations and processing instructions give none, nor does a tag that the
    markup's end cuts off. Start tags of raw elements are followed by their text and end."""
    at = 0
    for_text = lambda s: html.unescape(s) if "&" in s else s
    while at < len(markup):
        m = TOKEN.search(markup, at)
        if not m:
            yield "text", for_text(markup[at:]), None
            return
        if m.start() > at:
            yield "text", for_text(markup[at : m.start()]), None
        at = m.end()
        if not m[2] or not m[4]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "end", name, None
            continue
        own = _attributes(m[3]) if m[3] else {}
        if m[3].endswith("/") and ":" in name:
            own = own | {"/": ""}
        yield "start", name, own
        if name in _ENDS:
            end = _ENDS[name].search(markup, at)
            body, at = (markup[at : end.start()], end.end()) if end else (markup[at:], len(markup))
            if body:
                yield "text", body if name in RAW else for_text(body), None
            yield "end", name, None
        elif name == "plaintext":
            if at < len(markup):
                yield "text", markup[at:], None
            return


class Builder:
    """Open elements, with the places of each name, so that scopes are told without a walk."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        if len(self.open) >= DEPTH:
            self.pop()
        self.open[-1].children.append(node)
        self.places.setdefault(node.name, []).append(len(self.open))
        self.open.append(node)

    def pop(self) -> None:
        self.places[self.open.pop().name].pop()

    def last(self, names) -> int:
        """The place of the last open element of some names, 0 for none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def in_scope(self, names, fence) -> int:
        found = self.last(names)
        return found if found and found >= self.last(fence) else 0

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.pop()

    def text(self, text: str) -> None:
        if self.places.get("head") and self.open[-1].name in ("head", "html") and text.strip(" \t\n\f\r"):
            self.close_from(self.last(("head",)))
        self.open[-1].children.append(text)

    def end(self, name: str) -> None:
        if name == "br":
            self.open[-1].children.append(Node("br"))
        elif name == "p" and not self.in_scope(("p",), FENCES):
            self.open[-1].children.append(Node("p"))
        elif name in HEADINGS and (place := self.in_scope(HEADINGS, FENCES)):
            self.close_from(place)
        elif place := self.in_scope((name,), ("table",) if name in TABLE_PARTS and name != "table" else () if name == "table" else FENCES):
            self.close_from(place)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name not in IN_HEAD and self.places.get("head"):
            self.close_from(self.last(("head",)))
        if name in ("html", "body") and self.places.get(name):
            return
        if name in CLOSES_P and (place := self.in_scope(("p",), FENCES)):
            self.close_from(place)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.pop()
        if name in IMPLIED_ENDS:
            names, fence = IMPLIED_ENDS[name]
            while place := self.in_scope(names, fence):
                self.close_from(place)
        if name in PLACES and self.places.get("table"):
            place = name if name not in ("td", "th") or self.in_scope(("tr",), ("table",)) else "tr"
            if found := self.in_scope(PLACES[place], ("template", "table")):
                self.close_from(found + 1)
        if name in ("td", "th") and self.places.get("table") and not self.in_scope(("tr",), ("table",)):
            self.push(Node("tr"))
        node = Node(name, attributes)
        if name in VOID or "/" in attributes:
            self.open[-1].children.append(node)
        else:
            self.push(node)


def build(markup: str) -> Node:
    """The tree of a document; never fails, and closes at the end what is still open."""
    tree = Builder()
    for kind, value, attributes in tokens(markup):
        if kind == "text":
            tree.text(value)
        elif kind == "end":
            tree.end(value)
        else:
            tree.start(value, attributes)
    return tree.root


def style(node: Node) -> tuple[bool | None, bool | None]:
    """(displayed, visible) as the style attribute says, None where it doesn't; of several declarations the last counts, important ones before others."""
    own = node.attributes.get("style")
    if not own:
        return None, None
    out: dict[str, tuple[bool, bool]] = {}
    for m in DECLARATION.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", " ", own, flags=re.S)):
        name, value = m[1].lower(), m[2].strip().lower()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if important:
            value = value[:-9].rstrip()[:-1].rstrip()
        if name == "display" and (value == "none" or value.split(" ")[0] in DISPLAYS):
            said = value != "none"
        elif name == "visibility" and value in VISIBILITIES:
            said = value == "visible"
        else:
            continue
        if name not in out or important or not out[name][1]:
            out[name] = said, important
    return out.get("display", (None,))[0], out.get("visibility", (None,))[0]


def displayed(node: Node) -> bool:
    """Whether an element has a box: not those kinds that show no text, nor closed dialogs and elements with the hidden attribute, unless their style gives them one."""
    if node.name in HIDDEN or node.name in UNDRAWN:
        return False
    own = node.attributes
    if not own and node.name != "dialog":
        return True
    said = style(node)[0] if "style" in own else None
    if said is not None:
        return said
    return "hidden" not in own and (node.name != "dialog" or "open" in own)


@dataclass
class State:
    """What children have from their parents."""

    exact: bool = False
    visible: bool = True


class Writer:
    """Lines of text; collapses white space across inline pieces and keeps blank lines between blocks to one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent = ""
        self.marker = ""

    def text(self, text: str) -> None:
        for i, piece in enumerate(COLLAPSE.split(text)):
            if i:
                self.space = True
            if piece:
                if self.line and self.space:
                    self.line.append(" ")
                self.line.append(piece)
                self.space = False

    def exact(self, text: str) -> None:
        for i, piece in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.end(True)
            if piece:
                if self.line and self.space:
                    self.line.append(" ")
                self.line.append(piece)
                self.space = False

    def end(self, even_empty: bool = False) -> None:
        """Ends the line, if it has begun."""
        if self.line or even_empty:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            own = "".join(self.line)
            lead, self.marker = self.marker or self.indent, ""
            self.lines.append((lead + own).rstrip(" ") if not own else lead + own)
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = self.blank or not self.marker  # a marker waits for its item's first line


def _whole(text: str, otherwise: int) -> int:
    """A number as attributes have it; one beyond 18 digits is none, as in browsers beyond theirs."""
    return int(m[1]) if (m := INTEGER.match(text)) else otherwise


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """(captions, row groups) of a table itself, head first and foot last; rows of nested tables are theirs."""
    captions, groups = [], []
    loose: list[Node] | None = None
    for child in table.children:
        if not isinstance(child, Node) or not displayed(child):
            continue
        if child.name == "caption":
            captions.append(child)
        elif child.name == "tr":
            if loose is None:
                groups.append((1, loose := []))
            loose.append(child)
        elif child.name in ROW_GROUPS:
            rows = [x for x in child.children if isinstance(x, Node) and x.name == "tr" and displayed(x)]
            groups.append(({"thead": 0, "tfoot": 2}.get(child.name, 1), rows))
            loose = None
    return captions, [rows for _, rows in sorted(groups, key=lambda g: g[0])]


def _loose(part: Node) -> list:
    """What stands in a table, row group or row outside its cells and is shown before it."""
    out = []
    for child in part.children:
        if not isinstance(child, Node):
            out.append(child)
        elif child.name in ROW_GROUPS and part.name == "table" or child.name == "tr" and part.name in PLACES["tr"] or child.name == "colgroup":
            out += _loose(child) if displayed(child) else []
        elif not (child.name in ("td", "th") and part.name == "tr" or child.name == "caption" and part.name == "table"):
            out.append(child)
    return out


def _grid(groups: list[list[Node]], state: State) -> list[list[tuple[int, list[str] | None]]]:
    """Rows of (column, lines): cells at the columns that spans of cells before and above leave them, and None where such spans reach."""
    grid = []
    for rows in groups:
        taken: dict[int, int] = {}  # column: rows still taken from above
        for n, row in enumerate(rows):
            cells, column = [], 0
            below: dict[int, int] = {}
            before = state.visible if (said := style(row)[1]) is None else said
            for cell in row.children:
                if not (isinstance(cell, Node) and cell.name in ("td", "th") and displayed(cell)):
                    continue
                while taken.get(column):
                    column += 1
                inner = Writer()
                said = style(cell)[1]
                _flow(cell.children, inner, State(state.exact, before if said is None else said))
                inner.end()
                cells.append((column, [x for x in inner.lines if x.strip()] or [""]))
                own = cell.attributes
                wide = min(max(1, _whole(own.get("colspan", ""), 1)), 1000)
                high = _whole(own.get("rowspan", ""), 1)
                high = len(rows) - n if high == 0 else min(max(1, high), len(rows) - n)
                if high > 1:
                    # columns beyond a line's aligned part just follow, so none is left free for them
                    below.update((c, high) for c in range(column, min(column + wide, LINE // 3)))
                column += wide
                cells += [(c, None) for c in range(column - wide + 1, min(column, LINE // 3))]
            cells += [(c, None) for c in taken]
            taken = {c: h - 1 for c, h in (taken | below).items() if h > 1}
            grid.append(sorted(cells, key=lambda c: c[0]))
    return grid


def _table(node: Node, out: Writer, state: State) -> None:
    out.gap()
    captions, groups = _rows(node)
    _flow(_loose(node), out, State(state.exact, state.visible))
    out.end()
    for caption in captions:
        _flow([caption], out, State(state.exact, state.visible))
        out.end()
    grid = [cells for cells in _grid(groups, state) if any(lines and any(lines) for _, lines in cells)]
    width: dict[int, int] = {}
    for cells in grid:
        for column, lines in cells:
            if lines:
                width[column] = max(width.get(column, 0), *map(len, lines))
    offset, at = {}, 0
    for column in sorted(width):
        offset[column] = at
        at += width[column] + 3
    for cells in grid:
        # a column that only spans reach is none, and beyond the aligned part nothing is left free
        cells = [(column, lines or [""]) for column, lines in cells if lines or column in width and offset[column] <= LINE]
        for i in range(max(len(lines) for _, lines in cells)):
            line, length = [], 0
            for column, lines in cells:
                if i and i >= len(lines):
                    continue
                if at := offset[column]:
                    if length < at - 3 and at <= LINE:
                        line.append(" " * (at - 3 - length))
                        length = at - 3
                    line.append(" | ")
                    length += 3
                line.append(lines[i])
                length += len(lines[i])
            out.exact("".join(line).rstrip(" "))
            out.end()
    out.blank = True


def _flow(start: list, out: Writer, state: State) -> None:
    """Writes nodes in order, with a stack; only tables in cells of tables recur, and a tree's depth is bounded."""
    stack: list = [iter(((None, x) for x in start))]
    lists: list[list] = []
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            continue
        action, node = step
        if action:
            action()
            continue
        if isinstance(node, str):
            if state.visible:
                (out.exact if state.exact else out.text)(node)
            continue
        name, own = node.name, node.attributes
        if not displayed(node):
            continue
        afters: list = []
        if own and (said := style(node)[1]) is not None:

            def show(before=state.visible):
                state.visible = before

            afters.append(show)
            state.visible = said
        if name == "br":
            out.end(True)
        elif name == "img" and state.visible:
            out.text(own.get("alt", ""))
        elif name == "input" and state.visible and own.get("type", "").strip().lower() in VALUED:
            out.text(own.get("value", ""))
        elif name == "hr":
            out.gap()
        elif name == "table":
            _table(node, out, state)
        else:
            stack.append(iter([*((None, x) for x in _open(node, out, state, lists, afters)), *((x, None) for x in reversed(afters))]))
            continue
        for after in reversed(afters):
            after()


def _open(node: Node, out: Writer, state: State, lists: list[list], afters: list) -> list:
    """Begins an element; gives its children, and adds what is to be done after them, last first."""
    name, own, children = node.name, node.attributes, node.children
    if name == "details" and "open" not in own:
        children = [x for x in children if isinstance(x, Node) and x.name == "summary"][:1]
    if name in ("ul", "ol", "menu", "dl"):
        (out.end if lists else out.gap)()
        step = -1 if name == "ol" and "reversed" in own else 1
        first = sum(isinstance(x, Node) and x.name == "li" and displayed(x) for x in children) if step < 0 else 1
        lists.append([name, _whole(own.get("start", ""), first), step])

        def after():
            lists.pop()
            (out.end if lists else out.gap)()

        afters.append(after)
    elif name == "li":
        out.end()
        before = out.indent
        kind = lists[-1] if lists else ["ul", 1, 1]
        if kind[0] == "ol":
            kind[1] = _whole(own.get("value", ""), kind[1])
            mark = f"{kind[1]}. "
            kind[1] += kind[2]
        else:
            mark = "- "
        if state.visible:
            out.marker, out.indent = (out.marker or before) + mark, before + " " * len(mark)

        def after():
            out.end()
            out.indent, out.marker = before, ""

        afters.append(after)
    elif name in ("dd", "blockquote"):
        close = out.end if name == "dd" else out.gap
        close()
        before, out.indent = out.indent, out.indent + "  "

        def after():
            close()
            out.indent = before

        afters.append(after)
    elif name in EXACT:
        out.gap()
        was, state.exact = state.exact, True
        if children and isinstance(children[0], str) and name != "xmp":
            children = [re.sub(r"\A\r?\n", "", children[0]), *children[1:]]

        def after():
            state.exact = was
            out.gap()

        afters.append(after)
    elif name in SPACED:
        out.gap()
        afters.append(out.gap)
    elif name in BLOCK:
        out.end()
        if name == "optgroup" and state.visible:
            out.text(own.get("label", ""))
            out.end()
        afters.append(out.end)
    elif name == "q" and state.visible:
        out.text("“")

        def after():
            space, out.space = out.space, False
            out.text("”")
            out.space = space

        afters.append(after)
    return children


def render(markup: str | None) -> str:
    """All visible text of a page, as lines."""
    if not markup:
        return ""
    out = Writer()
    _flow(build(markup).children, out, State())
    out.end()
    while out.lines and not out.lines[-1].strip():
        out.lines.pop()
    return "\n".join(out.lines)


def extract_text(pages: DataFrame, html_column: str = "html", added: str = "text") -> DataFrame:
    """Adds the rendered text of each page.

    Left out are scripts, styles, embedded and media content, templates, elements without
    a box or made invisible by their attributes, closed dialogs and what closed details
    hide. Styles are those of the style attribute; style sheets are not read. Form values
    and all options of a select are kept.

    Null and empty markup and markup without visible text give the empty text. Pages
    are whole, however long: the work grows with the page, and one page is the most a task
    holds of rows that are not yet sent. Repeated rows all stay, and there are no ties to break. A column of the
    input with the added name is replaced, and others pass through. An empty table gives an empty table."""
    from .common import lean, small_batches

    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c != added]
    if html_column not in kept:
        raise ValueError("the added column needs a name of its own")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = pa.array([render(x) for x in batch.column(html_column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], made], names=[*kept, added])

    return pages.mapInArrow(lean(run), T.StructType([*[pages.schema[c] for c in kept], T.StructField(added, T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id", "text")


#: For pages of the elements that the tables' pages have: paragraphs, headings and lists stand apart, other blocks on lines of their own.
SQL = r"""
WITH a AS (
  SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<head>.*?</head>|<script>.*?</script>', '', 'gs'), '<[a-zA-Z/!][^>]*$', '') AS h FROM pages
), b AS (
  SELECT page_id, regexp_replace(regexp_replace(h, '[ \t\n\f\r]+', ' ', 'g'), '</?(?:p|ul|h1)(?: [^>]*)?>|</article>', chr(1), 'g') AS h FROM a
), c AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<li>', chr(2) || '- ', 'g'), '<(?:/?(?:div|article|nav|footer|html|body|br)(?: [^>]*)?|/li|!DOCTYPE[^>]*)>', chr(2), 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS h FROM b
), d AS (
  SELECT page_id, regexp_replace(regexp_replace(h, '[ \x02]*\x01[ \x01\x02]*', chr(10) || chr(10), 'g'), ' *\x02[ \x02]*', chr(10), 'g') AS h FROM c
)
SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '^\s+|\s+$', '', 'g'), '&copy;', '©', 'g'), '&middot;', '·', 'g'), '&lt;', '<'), '&quot;', '"'), '&amp', '&') AS text FROM (SELECT page_id, replace(h, '&amp;', '&amp') AS h FROM d)
"""
