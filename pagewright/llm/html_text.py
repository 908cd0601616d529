"""Visible text of HTML pages, laid out as it is shown.

A tokenizer feeds a tree builder that supplies implied end tags (p, li, dt, dd, rows, cells,
options, head), ignores unmatched end tags, and lets inline elements end across blocks. What isn't
shown goes from the tree (head, scripts, styles, templates, ``hidden``, ``display:none``, and the text of
``visibility:hidden`` up to a ``visibility:visible`` within). The renderer keeps the rest: blocks on lines of
their own, blank lines around paragraphs and headings, list markers with indents and numbers (start, value,
reversed, type), preformatted text as it is, and table cells padded into columns (spans of both kinds, head
rows first, foot rows last).

Edge cases: null or empty html gives an empty text; comments end with the input, and a tag that the
input ends within is dropped, as the standard has it; elements nested deeper than ``DEPTH`` are laid out at
that depth, text included; time and memory grow with a page's length, malformed or not; repeated rows and
null ids are rendered like others; other columns have no part; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import freeing

DEPTH = 200

# The element classes of the HTML standard that matter for layout.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base object iframe svg math datalist select audio video canvas noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEAD = frozenset("title meta link style script base noscript template".split())
#: An opening tag ends open elements of these kinds, up to an element of those.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("tr td th thead tbody tfoot caption", "table"), "tbody": ("tr td th thead tbody tfoot caption", "table"), "tfoot": ("tr td th thead tbody tfoot caption", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
_TOKEN = re.compile(r"""[^<]+|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)|<""", re.S)
#: An opening tag of a table part ends all that is open within the closest of these; and table parts alone end across a cell.
CONTEXT = {"td": "tr thead tbody tfoot table", "th": "tr thead tbody tfoot table", "tr": "thead tbody tfoot table", "thead": "table", "tbody": "table", "tfoot": "table"}
CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
PARTS = frozenset("table thead tbody tfoot tr td th caption body html".split())
#: These end all that is open within them.
CLOSING = BLOCK | UNSEEN | {"button"}
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|\S*))?""")
_MAYBE = re.compile(r"hidden|none|visible|&", re.I)
_GONE = re.compile(r"(?:^|[;{])\s*display\s*:\s*none\b", re.I)
_SEEN = re.compile(r"(?:^|[;{])\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Rows or columns that a cell may span, as the standard bounds them.
_MOST = 1000


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def tree(source: str) -> Node:
    """The element tree; text is in str children."""
    root = Node("#root")
    stack = [root]
    at, end = 0, len(source)
    token = _TOKEN.match

    def close(kinds: frozenset, scope: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in scope:
                return
            if stack[k].tag in kinds:
                del stack[k:]
                if not any(s.tag in kinds for s in stack[1:]):
                    return
                return close(kinds, scope)

    while at < end:
        m = token(source, at)
        at = m.end()
        tag = m[2]
        if tag is not None and not m[4]:
            break  # the input ends within a tag
        if tag is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                if stack[-1].tag == "head" and not text.isspace():
                    stack.pop()
                stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in CLOSING or not any(s.tag in BLOCK for s in stack[k + 1 :]):
                        del stack[k:]
                    else:  # an inline element ends across blocks, which stay open
                        del stack[k]
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in PARTS:
                    break
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        if tag in ENDS_P:
            close(frozenset(("p",)), frozenset(("td", "th", "table", "button")))
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CONTEXT:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in CONTEXT[tag]), None)
            if k is not None:
                del stack[k + 1 :]
        node = Node(tag, m[3] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(source, at)
            text = source[at : stop.start() if stop else end]
            node.children.append(html.unescape(text) if tag in ("title", "textarea") else text)
            at = end if not stop else (source.find(">", stop.end()) + 1 or end)
        elif tag not in VOID and not node.attrs.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    """Names in lower case and values; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(node.attrs):
        value = m[2] or ""
        found.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def _number(found: dict[str, str], name: str) -> int | None:
    m = re.match(r"\s*([+-]?\d{1,9})", found.get(name, ""))
    return int(m[1]) if m else None


def prune(root: Node) -> Node:
    """The tree without what isn't shown."""
    todo = [(root, False)]
    while todo:
        node, mute = todo.pop()
        kept: list = []
        for c in node.children:
            if isinstance(c, str):
                if not mute:
                    kept.append(c)
                continue
            own = mute
            if c.tag in UNSEEN:
                continue
            if c.attrs and _MAYBE.search(c.attrs):
                found = attributes(c)
                style = found.get("style", "")
                if "hidden" in found or _GONE.search(style) or c.tag == "input" and found.get("type", "").lower() == "hidden":
                    continue
                if seen := _SEEN.findall(style):
                    own = seen[-1].lower() != "visible"
            if own and c.tag in ("hr", "br"):
                continue
            kept.append(c)
            if c.children:
                todo.append((c, own))
        node.children = kept
    return root


def _list_item(node: Node, marker: str) -> list[str]:
    lines = layout(node)
    pad = " " * len(marker)
    return [(marker if k == 0 else pad if x else "") + x for k, x in enumerate(lines)] if lines else []


def _rows(node: Node) -> list[Node]:
    """A table's rows as they are shown: head sections first, foot sections last."""
    parts: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == "tr":
                parts["tbody"].append(c)
            elif c.tag in parts:
                parts[c.tag] += _rows(c)
    return parts["thead"] + parts["tbody"] + parts["tfoot"]


def _loose(node: Node):
    """What a table, section or row holds beside its parts; each row's own apart."""
    for c in node.children:
        if isinstance(c, str):
            yield c
        elif c.tag in ("thead", "tbody", "tfoot") and node.tag != "tr":
            yield from _loose(c)
        elif c.tag == "tr" and node.tag != "tr":
            row = Node("div")
            row.children = list(_loose(c))
            yield row
        elif not (c.tag in ("td", "th") and node.tag == "tr" or c.tag == "caption" and node.tag == "table"):
            yield c


def _table(node: Node) -> list[str]:
    grid: list[list[tuple[int, list[str]]]] = []
    head = [x for c in node.children if isinstance(c, Node) and c.tag == "caption" for x in layout(c)]
    taken: dict[int, int] = {}  # column -> rows that a cell from above still spans
    for row in _rows(node):
        cells, column, spans = [], 0, []
        for c in row.children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                while taken.get(column):
                    column += 1
                found = attributes(c) if c.attrs else {}
                wide = min(_MOST, max(1, _number(found, "colspan") or 1))
                high = _number(found, "rowspan")
                cells.append((column, layout(c)))
                spans.append((column, wide, _MOST if high == 0 else min(_MOST, max(1, high or 1))))
                column += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
        for at, wide, high in spans:
            if high > 1:
                taken.update((k, high - 1) for k in range(at, at + wide))
        grid.append(cells)
    stray = Node("div")
    stray.children = list(_loose(node))
    head = layout(stray) + head  # text put beside the rows is shown before the table
    width: dict[int, int] = {}
    for cells in grid:
        for column, lines in cells:
            width[column] = max(width.get(column, 0), max(map(len, lines), default=0))
    places, at = {}, 0
    for column in sorted(width):
        places[column] = at
        at += width[column] + 2
    out = []
    for cells in grid:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for column, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(places[column]) + ("" if len(line) <= places[column] else "  ") + lines[k]
            out.append(line.rstrip())
    return head + out


def _numeral(n: int, kind: str) -> str:
    """A list number in the style of the type attribute."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


def _markers(node: Node):
    """The marker of each list item in turn: a function of the item."""
    if node.tag != "ol":
        return lambda item: "- "
    found = attributes(node) if node.attrs else {}
    step = -1 if "reversed" in found else 1
    first = _number(found, "start")
    if first is None:
        first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if step < 0 else 1
    last = first - step

    def marker(item: Node) -> str:
        nonlocal last
        value = _number(attributes(item), "value") if item.attrs else None
        last = last + step if value is None else value
        return f"{_numeral(last, found.get('type', ''))}. "

    return marker


def layout(node: Node, pre: bool = False) -> list[str]:
    """The lines of a node's children."""
    lines: list[str] = []
    inline: list[str] = []
    gap = 0

    def put(more: list[str], margin: int) -> None:
        nonlocal gap
        if more:
            if lines:
                lines.extend([""] * max(gap, margin))
            lines.extend(more)
            gap = margin

    def flush(keep: bool) -> None:
        text = "".join(inline)
        inline.clear()
        if keep:
            text = text.strip("\n")
            if text.strip():
                put([x.rstrip() for x in text.split("\n")], 0)
        elif text and not text.isspace() or "\0" in text:
            shown = [_SPACE.sub(" ", x).strip() for x in text.split("\0")]
            while shown and not shown[-1]:
                shown.pop()
            put(shown, 0)

    def walk(children: list, keep: bool) -> None:
        for c in children:
            if isinstance(c, str):
                inline.append(c.replace("\0", ""))
                continue
            tag = c.tag
            if tag == "br":
                inline.append("\n" if keep else "\0")
            elif tag == "li":
                flush(keep)
                put(_list_item(c, marker(c)), 0)
            elif tag in BLOCK:
                flush(keep)
                margin = 1 if tag in SPACED else 0
                if tag == "table":
                    put(_table(c), margin)
                elif tag == "hr":
                    put(["---"], margin)
                elif tag == "pre":
                    put(layout(c, True), margin)
                elif tag in ("blockquote", "dd"):
                    put(["  " + x if x else "" for x in layout(c, keep)], margin)
                elif tag in ("ul", "ol", "menu", "dir") and node.tag == "li":
                    put(layout(c, keep), 0)
                else:
                    put(layout(c, keep), margin)
            else:
                walk(c.children, keep)

    marker = _markers(node)
    walk(node.children, pre)
    flush(pre)
    return lines


def render(source: str | None) -> str:
    return "\n".join(layout(prune(tree(source)))) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                texts = [render(x) for x in batch.column(1).slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(freeing(run), f"page_id {kind}, text string, n_chars long, n_lines long")
