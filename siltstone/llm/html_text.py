"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a renderer.

The tokenizer is one regular expression; raw-text elements run to their end tag. The tree
builder closes what HTML closes by implication (paragraphs before blocks, list items, table
rows and cells, options), ignores end tags that match nothing within their scope, and
never fails. Invisible: head and its elements, scripts, styles, templates, noscript, media
and what stands in for them (iframe, object, video, audio, canvas), data lists, in svg all
but text elements and embedded html, in math the annotations, `hidden`, `display:none`,
`visibility:hidden`, closed dialogs, and all but the summary of closed details. All other
text is emitted, that of text areas and of all options too.

Layout: white space collapses outside `pre`; blocks start lines; paragraphs, headings,
lists, quotes and tables keep a blank line around them; list items have bullets or numbers
and hang; the cells of a table are aligned in columns, spanning cells over several.

An element that is not shown ends with its own end tag or that of an element around it,
whatever is open in it, and a quote
that nothing closes is an ordinary sign within its tag, so neither swallows the rest of a
page; a tag that the page's end cuts off is no text, as in browsers.

Defined results: null or empty html gives an empty text; nesting has no limit and costs no
stack: lists, quotes and tables within MOST_BOXES others are not indented or aligned any
further, all else stays as it is; spans are bounded as in the HTML standard; repeated rows
keep their rows; an empty table gives an empty result. Only the two named columns are
looked at.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.shared import arrow_bounds

MOST_BOXES = 40
#: comments, declarations, and tags: slash, name, attributes, and the closing sign unless a quote stays open or the page ends
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S)
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")

HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object video audio canvas datalist input area col colgroup param source track embed".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav search section summary caption tr tbody thead tfoot td th option optgroup".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup caption tr tbody thead tfoot td th legend".split())
#: a start tag closes these open elements, looking no further up than a barrier
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SVG_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
#: these start tags end an open svg in a browser
BREAKOUT = SPACED | frozenset("b big br center code dd div dt em embed i img li nobr ruby s small span strong strike sub sup tt u var".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = SECTIONS | frozenset("td th tr caption".split())
ROW_LEVEL = SECTIONS | {"tr"}
#: shown, but their end tags close them whatever is open inside, as what they hold is set apart
FORCED = frozenset("select option optgroup button svg math".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Tree:
    """The tree under construction: the open elements, and the places in that stack where each tag stands."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.stack = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # lowest last
        self.blocks: list[int] = []  # places of block elements
        self.unseen: list[int] = []  # places of elements that are not shown

    def last(self, tags: Iterable[str]) -> int:
        """The lowest place of any of the tags; 0 if none is open."""
        get = self.places.get
        return max((at[-1] for t in tags if (at := get(t))), default=0)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        if not visible(node):
            self.unseen.append(len(self.stack))
        self.stack.append(node)

    def close_to(self, k: int) -> None:
        """Close the element at place k and all in it."""
        for node in self.stack[k:]:
            self.places[node.tag].pop()
        del self.stack[k:]
        for places in (self.blocks, self.unseen):
            while places and places[-1] >= k:
                places.pop()

    def text(self, s: str) -> None:
        if s:
            if self.stack[-1].tag == "head" and not s.isspace():
                self.close_to(len(self.stack) - 1)
            self.stack[-1].kids.append(unescape(s) if "&" in s else s)

    def end(self, tag: str) -> None:
        """An end tag closes the lowest element of its name, unless a barrier of its kind stands in between and all is shown."""
        if tag in HEADING:
            k, barrier = self.last(HEADING), self.last(("td", "th", "table", "li"))
        elif not self.places.get(tag):
            return
        else:
            k = self.places[tag][-1]
            if tag in CELLS:
                barrier = self.last(("table",))
            elif tag in ("table", "body", "html") or tag in UNSEEN or tag in FORCED:
                barrier = 0
            elif tag in BLOCK:
                barrier = self.last(("td", "th", "table", "caption", *(("ul", "ol") if tag == "li" else ())))
            else:
                barrier = self.blocks[-1] if self.blocks else 0
        if k and (k >= barrier or self.unseen and self.unseen[-1] >= k):
            self.close_to(k)

    def imply(self, tag: str) -> None:
        """Close what a start tag closes by implication."""
        if tag in CLOSES_P and self.places.get("p") and (k := self.places["p"][-1]) > self.last(("td", "th", "table", "caption", "button")):
            self.close_to(k)
        if tag in HEADING and self.stack[-1].tag in HEADING:
            self.close_to(len(self.stack) - 1)
        if tag in IMPLIED:
            closed, barrier = IMPLIED[tag]
            k = self.last(closed)
            if k and k > self.last(barrier):
                while tag in ROW_LEVEL and self.stack[k - 1].tag in closed:
                    k -= 1
                self.close_to(k)


def parse(html: str) -> Node:
    tree, at, size = Tree(), 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            tree.text(html[at:])
            break
        tree.text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, inside, whole = m[2].lower(), m[3], m[4]
        while not whole and at < size:  # a quote that nothing closes
            rest = REST.match(html, at + 1)
            inside, whole, at = inside + " " + rest[1], rest[2], rest.end()
        if not whole:
            break
        if m[1]:
            if tag == "br":
                tree.stack[-1].kids.append(Node("br", {}))
            else:
                tree.end(tag)
            continue
        attrs = attributes(inside) if inside and not inside.isspace() else {}
        if tag in ("html", "body"):
            if k := tree.last(("head",)):
                tree.close_to(k)
            if GONE.search(attrs.get("style", "")) or "hidden" in attrs:
                tree.stack[-1].attrs.update(attrs)
            continue
        if tree.stack[-1].tag == "head" and tag not in HEAD:
            tree.close_to(len(tree.stack) - 1)
        tree.imply(tag)
        node = Node(tag, attrs)
        tree.stack[-1].kids.append(node)
        if tag in VOID or inside.endswith("/") and tree.last(("svg", "math")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if tag in ("textarea", "xmp"):
                inner = html[at : end.start() if end else size]
                node.kids.append(unescape(inner) if tag == "textarea" else inner)
            at = end.end() if end else size
            continue
        tree.push(node)
    return tree.root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a:
        return False
    return not a or not ("hidden" in a or "style" in a and GONE.search(a["style"]))


def width(line: str) -> int:
    return len(line) if line.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in line)


class Lines:
    """Output lines of one box that lies in `depth` others; inline text gathers in `line` until the line ends."""

    def __init__(self, depth: int = 0) -> None:
        self.depth = depth
        self.done: list[str] = []
        self.line: list[str] = []
        self.blank = self.space = False

    def text(self, s: str) -> None:
        t = SPACE.sub(" ", s)
        if t == " " or not t:
            self.space = self.space or t == " "
            return
        if t[0] == " " or self.space:
            t = (" " if self.line else "") + t.lstrip(" ")
        self.space = t[-1] == " "
        self.start()
        self.line.append(t[:-1] if self.space else t)

    def start(self) -> None:
        if self.blank and not self.line:
            if self.done:
                self.done.append("")
            self.blank = False

    def end(self) -> None:
        if self.line:
            self.done.append("".join(self.line))
            self.line = []
        self.space = False

    def raw(self, lines: list[str]) -> None:
        self.end()
        if lines:
            self.start()
            self.done += lines

    def gap(self) -> None:
        self.end()
        self.blank = True


def box(node: Node, depth: int) -> list[str]:
    out = Lines(depth)
    flow(node, out)
    out.end()
    return out.done


END, GAP, WORD = 1, 2, 3  # what follows the content of an element


def flow(node: Node, out: Lines) -> None:
    """Lay out what a node holds; open elements wait on a stack of (their children, themselves, what follows, in svg)."""
    stack = [(iter(node.kids), node, 0, node.tag == "svg")]
    while stack:
        kids, parent, after, drawn = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if after == END:
                out.end()
            elif after == GAP:
                out.gap()
            elif after == WORD:
                out.text(" ")
            continue
        if isinstance(kid, str):
            if not drawn:
                out.text(kid)
            continue
        if not visible(kid):
            continue
        tag = kid.tag
        if drawn:  # only text elements of a drawing are shown, and html in it
            if tag in SVG_UNSEEN:
                continue
            if tag not in ("text", "foreignobject") and tag not in BREAKOUT and tag not in BLOCK:
                stack.append((iter(kid.kids), kid, 0, True))
                continue
            out.text(" ")
            if tag not in BLOCK and tag != "br":
                stack.append((iter(kid.kids), kid, WORD, False))
                continue
        if tag not in BLOCK:
            if tag == "br":
                if not out.line:
                    out.start()
                    out.line.append("")
                out.end()
            elif tag == "wbr" or parent.tag == "semantics" and tag in ("annotation", "annotation-xml"):
                pass
            elif tag in ("textarea", "xmp"):
                if (inner := verbatim(kid).strip("\n").expandtabs()) and not inner.isspace():
                    out.raw(inner.split("\n"))
            else:
                stack.append((iter(kid.kids), kid, 0, tag == "svg"))
            continue
        spaced = tag in SPACED and not (tag in LISTS and parent.tag in ("li", "dd"))  # lists within lists are tight
        out.gap() if spaced else out.end()
        deep, lines = out.depth + 1, None
        if tag == "pre":
            lines = verbatim(kid).strip("\n").expandtabs().split("\n")
        elif tag == "hr":
            lines = ["---"]
        elif deep > MOST_BOXES:  # no more boxes: marks and text as they come
            if tag == "li":
                out.text("- ")
        elif tag in LISTS:
            lines = listing(kid, deep)
        elif tag == "li":
            lines = hang("- ", box(kid, deep))
        elif tag == "dd":
            lines = hang("    ", box(kid, deep))
        elif tag == "blockquote":
            lines = [f"> {x}".rstrip() for x in box(kid, deep)]
        elif tag == "table":
            lines = table(kid, deep)
        if lines is not None:
            out.raw(lines)
            out.gap() if spaced else out.end()
        elif tag == "details" and "open" not in kid.attrs:
            stack.append((iter([x for x in kid.kids if isinstance(x, Node) and x.tag == "summary"]), kid, GAP if spaced else END, False))
        else:
            stack.append((iter(kid.kids), kid, GAP if spaced else END, False))


def verbatim(node: Node) -> str:
    out, stack = [], [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, str):
            out.append(kid)
        elif kid.tag == "br":
            out.append("\n")
        elif visible(kid):
            stack.append(iter(kid.kids))
    return "".join(out).replace("\r\n", "\n").replace("\r", "\n")


def hang(mark: str, lines: list[str]) -> list[str]:
    return [mark + lines[0]] + [(" " * len(mark) + x).rstrip() for x in lines[1:]] if lines else []


def number(s: str | None, other: int) -> int:
    s = (s or "").strip()
    return int(s) if re.fullmatch(r"-?[0-9]{1,9}", s) else other


def alone(kid: Node | str, depth: int) -> list[str]:
    """What stands outside of its place, as a block of its own."""
    wrap = Node("div", {})
    wrap.kids = [kid]
    return box(wrap, depth)


def listing(node: Node, depth: int) -> list[str]:
    out, n = [], number(node.attrs.get("start"), 1)
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li":
            if visible(kid):
                n = number(kid.attrs.get("value"), n)
                out += hang(f"{n}. " if node.tag == "ol" else "- ", box(kid, depth))
                n += 1
        elif not isinstance(kid, str) or not kid.isspace():
            out += hang("  ", alone(kid, depth))
    return out


def holds_rows(form: Node) -> bool:
    stack = [form]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, Node) and (k.tag in ROW_LEVEL or k.tag in ("td", "th")):
                return True
            if isinstance(k, Node) and k.tag == "form":
                stack.append(k)
    return False


def rows_of(node: Node, strays: list[Node | str]) -> list[Node]:
    """Rows of a table, cells outside of rows as a row of their own; what stands outside of rows goes to strays."""
    rows: list[Node] = []
    stack = [(iter(node.kids), Node("tr", {}))]
    while stack:
        kids, loose = stack[-1]
        kid = next(kids, None)
        cell = isinstance(kid, Node) and kid.tag in ("td", "th")
        if cell:
            loose.kids.append(kid)
            continue
        if kid is not None and (kid.isspace() if isinstance(kid, str) else not visible(kid)):
            continue
        into = isinstance(kid, Node) and (kid.tag in SECTIONS or kid.tag == "form" and holds_rows(kid))
        row = isinstance(kid, Node) and kid.tag == "tr"
        if loose.kids and (kid is None or row or into or isinstance(kid, Node) and kid.tag == "form"):
            rows.append(loose)
            stack[-1] = kids, Node("tr", {})
        if kid is None:
            stack.pop()
        elif row:
            rows.append(kid)
        elif into:
            stack.append((iter(kid.kids), Node("tr", {})))
        else:
            strays.append(kid)
    return rows


def table(node: Node, depth: int) -> list[str]:
    out: list[str] = []
    strays: list[Node | str] = []
    rows = rows_of(node, strays)
    for kid in strays:  # captions, and text or elements that stand outside of rows
        out += alone(kid, depth)
    grid: list[list[tuple[int, int, list[str]]]] = []
    above: list[tuple[int, int, int]] = []  # first column, column after the last, and row after the last of cells that reach down
    for r, tr in enumerate(rows):
        row, col, stray, cells = [], 0, Node("td", {}), []
        for kid in tr.kids:
            if isinstance(kid, Node) and kid.tag in ("td", "th"):
                cells.append(kid)
            elif not isinstance(kid, str) or not kid.isspace():
                stray.kids.append(kid)
        above = sorted(x for x in above if x[2] > r)
        k, new = 0, []
        for cell in cells + [stray] * bool(stray.kids):
            if not visible(cell):
                continue
            while k < len(above) and above[k][0] <= col:
                col, k = max(col, above[k][1]), k + 1
            span = max(1, min(1000, number(cell.attrs.get("colspan"), 1)))
            down = min(65534, number(cell.attrs.get("rowspan"), 1))
            row.append((col, col + span, box(cell, depth)))
            if down > 1 or down == 0:  # 0 reaches to the end
                new.append((col, col + span, r + down if down else len(rows)))
            col += span
        above += new
        grid.append(row)
    # columns in which no cell starts take no room
    starts = sorted({a for row in grid for a, *_ in row})
    wide = [0] * len(starts)
    spans = [[(bisect_left(starts, a), bisect_left(starts, b), lines) for a, b, lines in row] for row in grid]
    for row in spans:
        for a, b, lines in row:
            if b - a == 1 and lines:
                wide[a] = max(wide[a], *map(width, lines))
    for row in spans:
        for a, b, lines in row:
            if b - a > 1 and lines:
                wide[b - 1] += max(0, max(map(width, lines)) - sum(wide[a:b]) - 3 * (b - a - 1))
    edges, at = [], 0
    for w in wide:
        edges.append(at)
        at += w + 3
    for row in spans:
        for i in range(max((len(x) for *_, x in row), default=0)):
            line, used = [], 0
            for q, (a, _, lines) in enumerate(row):
                cell, edge = lines[i] if i < len(lines) else "", edges[a]
                if q:
                    line.append(" " * max(0, edge - 3 - used) + " | ")
                    used = max(used + 3, edge)
                elif edge:
                    line.append(" " * edge)
                    used = edge
                line.append(cell)
                used += width(cell)
            if "".join(line).replace("|", "").strip():
                out.append("".join(line).rstrip())
    return out


def render(html: str | None) -> str:
    return "\n".join(x.rstrip() for x in box(parse(html), 0)).strip("\n") if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and text for every row."""
    arrow_bounds(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(x) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return own.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
