"""HTML extraction by layout: a tree with implied tags, visibility rules, and a rendering of all that is visible.

Blocks stand on lines of their own, paragraphs and headings between blank lines, list items behind their marker and
indented by depth, table cells in aligned columns, and preformatted text as it is. Partitions are read and written by
Spark; each page is laid out alone. Nesting may be of any depth: the tree is walked by generators on a stack of our own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas datalist annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
#: An open element that a start tag ends, and where the search for it stops.
IMPLIED_END: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), LISTS | {"table", "td", "th"}),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
}
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "option", "optgroup", "legend"}

# Bounds that HTML itself sets on spans of cells, and buttons whose value is their text.
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534
BUTTONS = frozenset({"submit", "button", "reset"})
#: Levels of lists that are indented; items of deeper ones stand as far in as these.
INDENTED = 30

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?](?P<other>[^>]*)>?|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_UNQUOTED = re.compile(r"<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>")
_BEGINS_TAG = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SHOWN = re.compile(r"display\s*:\s*(?!none)[a-z]", re.I)
_AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_BLANK = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "attrs", "inside")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.inside = name, attrs or {}, []


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag; of repeated names the first holds."""
    out: dict[str, str] = {}
    if "=" in text or text.strip(" /\t\n\r\f"):
        for name, value in _ATTR.findall(text):
            out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def next_tag(page: str, at: int) -> tuple[int, re.Match | None]:
    """Where the next tag, comment or declaration begins and its match; (size, None) where none follows.

    A tag whose quotes do not close ends at the first `>`; one without any is unfinished, and the rest of the page goes with
    it, so that None comes with the place where it begins. Each `<` is tried once, so the work is in proportion to the page.
    """
    while (at := page.find("<", at)) >= 0:
        m = _TAG.match(page, at)
        if not m and _BEGINS_TAG.match(page, at):
            return at, _UNQUOTED.match(page, at)
        if m:
            return at, m
        at += 1
    return len(page), None


def parse(page: str) -> Node:
    """The tree of a page: tags that HTML leaves out are put in, unmatched end tags are passed over."""
    root = Node("html")
    stack = [root]
    opened: Counter[str] = Counter()
    at, size = 0, len(page)

    def text(piece: str) -> None:
        if piece:
            stack[-1].inside.append(html.unescape(piece) if "&" in piece else piece)

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.name] += 1

    def pop(k: int) -> None:
        for node in stack[k:]:
            opened[node.name] -= 1
        del stack[k:]

    def end(names: frozenset[str], stop: frozenset[str]) -> bool:
        if not any(opened[x] for x in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                pop(k)
                return True
            if stack[k].name in stop:
                return False
        return False

    while at < size:
        begin, m = next_tag(page, at)
        text(page[at:begin])
        if not m:
            break
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            if name == "br":
                stack[-1].inside.append(Node("br"))
            elif name in HEADINGS:
                end(HEADINGS, frozenset({"table", "td", "th"}))
            elif name == "p" and not opened["p"]:
                stack[-1].inside.append(Node("p"))
            elif name not in ("html", "body"):
                end(frozenset({name}), frozenset() if name in ("table", "div") else frozenset({"table"}) if name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else frozenset({"table"}))
            continue
        if name in ("html", "body") and (name == "html" or opened["body"]):
            continue
        if name == "body":
            end(frozenset({"head"}), frozenset())
        elif stack[-1].name == "head" and name not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            pop(len(stack) - 1)  # the head's end tag may be left out
        if name in ENDS_P:
            end(frozenset({"p"}), frozenset({"table", "td", "th", "button", "object"}))
        if name in IMPLIED_END:
            end(*IMPLIED_END[name])
        if name in HEADINGS and stack[-1].name in HEADINGS:
            pop(len(stack) - 1)
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].inside.append(row)
            push(row)
        node = Node(name, attributes(m["attrs"]))
        stack[-1].inside.append(node)
        if name in VOID or m["attrs"].endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            inner = page[at : stop.start()] if stop else page[at:]
            node.inside.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            at = stop.end() if stop else size
            continue
        push(node)
    return root


class Sheet:
    """What the style sheets of a page hide by selectors of one element: a name, classes and ids; others are passed over."""

    def __init__(self, tree: Node):
        rules: dict[str, bool] = {}
        todo = [tree]
        while todo:
            node = todo.pop()
            if node.name == "style":
                text = _AT_RULE.sub("", re.sub(r"/\*.*?\*/", "", "".join(x for x in node.inside if isinstance(x, str)), flags=re.S))
                for names, body in _RULE.findall(text):
                    if _NONE.search(body) or _SHOWN.search(body):
                        rules.update({x.strip(): bool(_NONE.search(body)) for x in names.split(",")})
            todo.extend(x for x in reversed(node.inside) if isinstance(x, Node))
        self.hides: list[tuple[str, set[str]]] = []
        for selector, hides in rules.items():
            m = _SELECTOR.fullmatch(selector)
            if hides and selector and m:
                self.hides.append(((m[1] or "*").lower(), set(re.findall(r"[.#][\w-]+", m[2]))))

    def hidden(self, node: Node) -> bool:
        """Whether an element and all in it is not shown."""
        a = node.attrs
        if node.name in HIDDEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
            return True
        if node.name == "input":
            return a.get("type", "").lower() not in BUTTONS
        if node.name == "dialog" and "open" not in a:
            return True
        if "style" in a:
            if _NONE.search(a["style"]):
                return True
            if _SHOWN.search(a["style"]):
                return False
        if self.hides:
            marks = {"." + x for x in a.get("class", "").split()} | ({"#" + a["id"]} if "id" in a else set())
            return any(tag in ("*", node.name) and need <= marks for tag, need in self.hides)
        return False


def width(s: str) -> int:
    """Columns of a string: two for wide characters, none for combining ones."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Collects text as lines with collapsed blanks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = self.gap = False

    def add(self, s: str) -> None:
        s = _BLANK.sub(" ", s)
        if not s:
            return
        if s[0] == " " and self.now:
            self.blank = True
        words = s.strip(" ")
        if words:
            if self.gap and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = False
            if self.blank and self.now:
                self.now.append(" ")
            self.now.append(words)
            self.blank = s[-1] == " "
        elif self.now:
            self.blank = True

    def close(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
        self.now, self.blank = [], False

    def space(self) -> None:
        self.close()
        self.gap = True

    def verbatim(self, lines: list[str]) -> None:
        self.close()
        if self.gap and self.lines and self.lines[-1] != "" and lines:
            self.lines.append("")
        self.gap = False
        self.lines.extend(lines)


def inside_of(node: Node, sheet: Sheet) -> Iterator[Node | str]:
    """Visible nodes and strings within a node, in order, each element before what it holds."""
    todo = [iter(node.inside)]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
        elif isinstance(x, str):
            yield x
        elif not sheet.hidden(x):
            yield x
            todo.append(iter(x.inside))


def flat_text(node: Node, sheet: Sheet) -> str:
    return "".join(x if isinstance(x, str) else "\n" if x.name == "br" else "" for x in inside_of(node, sheet))


def table_rows(node: Node, sheet: Sheet) -> Iterator[Node]:
    for x in node.inside:
        if isinstance(x, Node) and not sheet.hidden(x):
            if x.name == "tr":
                yield x
            elif x.name in ("tbody", "thead", "tfoot"):
                yield from (y for y in x.inside if isinstance(y, Node) and y.name == "tr" and not sheet.hidden(y))


def span_of(node: Node | str, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip() if isinstance(node, Node) else "1"
    return min(int(value[:9]), most) if value.isascii() and value.isdigit() else 1


#: A step of the layout: it yields further steps, which run before it goes on.
Step = Generator["Step", None, None]


def run(step: Step) -> None:
    """Run a step and all that it yields, on a stack of its own."""
    stack = [step]
    while stack:
        ahead = next(stack[-1], None)
        if ahead is None:
            stack.pop()
        else:
            stack.append(ahead)


def render_table(node: Node, out: Lines, sheet: Sheet, lists: int) -> Step:
    """Rows with columns aligned; a cell of several lines takes several lines of its row, one of several columns their
    width, and one of several rows keeps its columns free in those below."""
    for x in node.inside:
        loose = isinstance(x, Node) and x.name not in ("tr", "tbody", "thead", "tfoot", "col", "colgroup") or isinstance(x, str) and x.strip()
        if loose:
            yield render([x], out, sheet, lists=lists)
            out.close()
    rows: list[list[tuple[int, int, list[str]]]] = []  # column, columns, lines
    below: dict[int, int] = {}
    for tr in table_rows(node, sheet):
        row, at, ahead = [], 0, {k: n - 1 for k, n in below.items() if n > 1}
        for x in tr.inside:
            if isinstance(x, str) and not x.strip() or isinstance(x, Node) and sheet.hidden(x):
                continue
            cell = Lines()
            yield render(x.inside if isinstance(x, Node) and x.name in ("td", "th") else [x], cell, sheet, lists=lists)
            cell.close()
            while at in below:
                at += 1
            across, down = max(1, span_of(x, "colspan", MOST_COLSPAN)), span_of(x, "rowspan", MOST_ROWSPAN) or MOST_ROWSPAN
            row.append((at, across, [y for y in cell.lines if y]))
            if down > 1:
                ahead |= dict.fromkeys(range(at, at + across), down - 1)
            at += across
        rows.append(row)
        below = ahead
    wide: Counter[int] = Counter()
    for at, across, lines in sorted((c for r in rows for c in r), key=lambda c: c[1]):
        need = max(map(width, lines), default=0)
        have = sum(wide[k] + 2 for k in range(at, at + across) if wide[k]) - 2
        if need > max(have, 0):
            last = max((k for k in range(at, at + across) if wide[k]), default=at)
            wide[last] += need - max(have, 0)
    starts, used = {}, 0
    for k in range(max((at + across for r in rows for at, across, _ in r), default=0)):
        starts[k] = used
        used += wide[k] + 2 if wide[k] else 0
    for row in rows:
        height = max((len(lines) for _, _, lines in row), default=0)
        for k in range(height):
            line = ""
            for at, _, lines in row:
                if k < len(lines):
                    line += " " * (starts[at] - width(line)) + lines[k]
            out.verbatim([line] if line else [])


def render_list(node: Node, out: Lines, sheet: Sheet, inner: bool, lists: int) -> Step:
    """Items behind their marker, what they hold indented under it."""
    out.close() if inner and lists else out.space()
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    for y in node.inside:
        if not (isinstance(y, Node) and y.name == "li") or sheet.hidden(y):
            yield render([y], out, sheet, True, lists + 1)
            continue
        value = y.attrs.get("value", "")
        number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
        sign = f"{number}. " if node.name == "ol" else "- "
        number += 1
        if lists >= INDENTED:
            out.close()
            out.add(sign)
            yield render(y.inside, out, sheet, True, lists + 1)
            out.close()
            continue
        item = Lines()
        yield render(y.inside, item, sheet, True, lists + 1)
        item.close()
        lines = [z for z in item.lines if z]
        if lines:
            out.verbatim([sign + lines[0], *(" " * len(sign) + z for z in lines[1:])])
    out.close() if inner else out.space()


def choices(node: Node, sheet: Sheet) -> list[str]:
    """What a select shows: all its options where it is a list box, else the one selected, or the first."""
    options = [x for x in inside_of(node, sheet) if isinstance(x, Node) and x.name == "option"]
    if "multiple" not in node.attrs and span_of(node, "size", 1000) <= 1:
        options = [x for x in options if "selected" in x.attrs][-1:] or options[:1]
    return [x.attrs.get("label") or flat_text(x, sheet) for x in options]


def render(nodes: list, out: Lines, sheet: Sheet, inner: bool = False, lists: int = 0) -> Step:
    """Lay out nodes in order; inner says whether they stand in a list item."""
    for x in nodes:
        if isinstance(x, str):
            out.add(x)
            continue
        if sheet.hidden(x):
            continue
        name = x.name
        if name == "br":
            if not out.now and not out.gap and out.lines and out.lines[-1] != "":
                out.gap = True
            out.close()
        elif name == "hr":
            out.space()
        elif name == "img":
            out.add(x.attrs.get("alt", ""))
        elif name == "input":
            out.add(f" {x.attrs.get('value', '')} ")
        elif name == "svg":
            for y in inside_of(x, sheet):
                if isinstance(y, Node) and y.name == "text":
                    out.add(f" {flat_text(y, sheet)} ")
        elif name == "select":
            for said in choices(x, sheet):
                out.add(f" {said} ")
        elif name == "pre":
            out.space()
            out.verbatim(flat_text(x, sheet).strip("\n").split("\n"))
            out.space()
        elif name == "table":
            out.space()
            yield render_table(x, out, sheet, lists)
            out.space()
        elif name in LISTS:
            yield render_list(x, out, sheet, inner, lists)
        elif name == "li":
            out.close()
            out.add("- ")
            yield render(x.inside, out, sheet, True, lists)
            out.close()
        elif name in BLOCK:
            out.space() if name in SPACED else out.close()
            yield render(x.inside, out, sheet, inner, lists)
            out.space() if name in SPACED else out.close()
        else:
            yield render(x.inside, out, sheet, inner, lists)


def layout(page: str) -> str:
    """All visible text of a page."""
    tree, out = parse(page), Lines()
    run(render(tree.inside, out, Sheet(tree)))
    out.close()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id, text (the laid-out visible text), n_lines and n_chars.

    A null page gives a null text with 0 lines, an empty one an empty text. Rows are laid out one by one, repeated rows
    and null ids too; extra columns are ignored and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if x is None else layout(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, "id long, text string")
    lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n")))
    return rows.select(F.col("id").alias(id_col), "text", lines.cast("long").alias("n_lines"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
