"""HTML extraction by layout-aware rendering.

A tree is built from the markup with the tags that HTML implies (a paragraph ends where a block
begins, a list item where the next one does, cells and rows likewise). The tree is
then laid out: hidden parts are left out, white space collapses except in ``pre`` and ``textarea``, blocks start
on lines of their own with blank lines where browsers leave a margin, lists are marked and indented,
and the cells of a table stand in aligned columns. All visible text is put out, menus and
advertisements included; choosing among it is another operator's work.

Defined results. A null or empty page gives an empty text. Markup that never ends is dropped from
its last ``<`` on, as browsers do. Nesting of any depth is walked without recursion. Cells
are padded up to ``WIDEST`` characters, longer ones are whole but unpadded, so a table's
text grows with its content. A quote opens a value only straight after ``=``; anywhere else in a
tag it is a plain character and the tag ends at ``>``. Repeated rows get equal texts, an empty table an empty result;
columns besides id and html are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "annotation annotation-xml audio canvas datalist dialog embed head iframe mphantom noembed noframes noscript "
    "object rp script style svg template title video".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table ul".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SECTIONS = frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))

#: What a start tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table", "thead", "tbody", "tfoot"))),
    "td": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    **{s: (SECTIONS | {"tr", "td", "th"}, frozenset(("table",))) for s in SECTIONS},
}
WIDEST = 80

_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.DOTALL)
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_EQUALS = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+"
_VALUE = r""""[^"]*+"|'[^']*+'|[^ \t\n\r\f"'>][^ \t\n\r\f>]*+|(?=>)"""
_TAG = re.compile(
    rf"<(/?)([a-zA-Z][^ \t\n\r\f/>]*)((?:[ \t\n\r\f/]++|{_NAME}(?:{_EQUALS}(?:{_VALUE})|(?!{_EQUALS})))*+)>"
)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_EQUALS}({_VALUE}|\Z))?+")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = tag
        self.attributes = attributes
        self.children: list[Node | str] = []

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for found in _ATTRIBUTE.finditer(self.attributes):
            if found[1].lower() == name:
                value = found[2] or ""
                return unescape(value[1:-1] if value[:1] in "\"'" else value)
        return None


def build(html: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    open_nodes = [root]
    open_tags: Counter[str] = Counter()
    at, end = 0, len(html)

    def cut(place: int) -> None:
        open_tags.subtract(node.tag for node in open_nodes[place:])
        del open_nodes[place:]

    def add_text(text: str) -> None:
        if text:
            if open_nodes[-1].tag == "head" and text.strip():
                cut(len(open_nodes) - 1)
            open_nodes[-1].children.append(unescape(text) if "&" in text else text)

    def close(tags: frozenset[str], beyond: frozenset[str]) -> None:
        """End the outermost open element with one of the tags that is not beyond another."""
        if not any(open_tags[tag] for tag in tags):
            return
        place = None
        for i in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[i].tag in beyond:
                break
            if open_nodes[i].tag in tags:
                place = i
        if place is not None:
            cut(place)

    def push(tag: str, attributes: str) -> None:
        node = Node(tag, attributes)
        open_nodes[-1].children.append(node)
        if tag not in VOID:
            open_nodes.append(node)
            open_tags[tag] += 1

    while at < end:
        less = html.find("<", at)
        if less < 0:
            add_text(html[at:])
            break
        add_text(html[at:less])
        follows = html[less + 1 : less + 3]
        if html.startswith("<!--", less):
            at = _COMMENT.match(html, less).end()
            continue
        if follows[:1] in ("!", "?") or (follows[:1] == "/" and not follows[1:].isalpha()):
            stop = html.find(">", less)
            at = end if stop < 0 else stop + 1
            continue
        if not (follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/"):
            add_text("<")
            at = less + 1
            continue
        found = _TAG.match(html, less)
        if found is None:
            break
        at = found.end()
        ending, tag, attributes = found[1], found[2].lower(), found[3]
        if ending:
            if tag == "br":
                push("br", "")
            elif tag == "p" and not open_tags["p"]:
                open_nodes[-1].children.append(Node("p"))
            elif open_tags[tag]:
                inside = frozenset() if tag in ("table", "body", "html") else frozenset(("table",))
                if tag not in ("td", "th", "tr", "table", "body", "html") and tag not in SECTIONS:
                    inside = inside | {"td", "th"}
                for i in range(len(open_nodes) - 1, 0, -1):
                    if open_nodes[i].tag == tag:
                        cut(i)
                        break
                    if open_nodes[i].tag in inside:
                        break
            continue
        if open_nodes[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(open_nodes) - 1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK and tag not in ("option", "optgroup"):
            close(frozenset(("p",)), frozenset(("table", "td", "th", "button", "object")))
        if tag in ("td", "th") and open_nodes[-1].tag != "tr":
            push("tr", "")
        push(tag, attributes)
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            last = stop.start() if stop else end
            raw = html[at:last]
            if tag == "textarea":
                raw = re.sub(r"\A\r?\n", "", raw)
            open_nodes[-1].children.append(raw if tag in HIDDEN else unescape(raw))
            cut(len(open_nodes) - 1)
            after = html.find(">", last)
            at = end if after < 0 else after + 1
    return root


class Box:
    """Lines of text under way."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # white space waits to be put out
        self.margin = False  # an empty line waits to be put out
        self.indents: list[list] = []  # [first, later, whether first was used]

    def put(self, text: str) -> None:
        words = _BLANK.sub(" ", text)
        if words == " ":
            self.blank = True
            return
        if not words:
            return
        if (self.blank or words[0] == " ") and self.line:
            self.line.append(" ")
        self.blank = words[-1] == " "
        self.line.append(words.strip(" "))

    def emit(self, line: str) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        prefix = []
        for indent in self.indents:
            prefix.append(indent[1] if indent[2] else indent[0])
            indent[2] = True
        self.lines.append(("".join(prefix) + line).rstrip())

    def end_line(self) -> None:
        if self.line:
            line, self.line = "".join(self.line), []
            self.emit(line)
        self.blank = False

    def end_block(self, spaced: bool) -> None:
        self.end_line()
        self.margin = self.margin or spaced


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int]]] = []

    def lines(self) -> Iterator[str]:
        widths: list[int] = []
        for row in self.rows:
            column = 0
            for lines, span in row:
                widths.extend([0] * (column + 1 - len(widths)))
                if span == 1:
                    longest = max((len(line) for line in lines), default=0)
                    widths[column] = max(widths[column], min(longest, WIDEST))
                column += span
        for row in self.rows:
            for k in range(max((len(lines) for lines, _ in row), default=0)):
                cells, column = [], 0
                for lines, span in row:
                    wide = sum(widths[column : column + span]) + 3 * (len(widths[column : column + span]) - 1)
                    cells.append((lines[k] if k < len(lines) else "").ljust(wide))
                    column += span
                yield " | ".join(cells).rstrip()


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether an element is laid out at all, and whether its own text is visible."""
    if node.tag in HIDDEN and not (node.tag == "dialog" and node.attribute("open") is not None):
        return False, False
    if node.attributes:
        if node.attribute("hidden") is not None:
            return False, False
        style = node.attribute("style")
        if style:
            style = style.lower().replace(" ", "")
            if "display:none" in style:
                return False, False
            if "visibility:hidden" in style or "visibility:collapse" in style:
                return True, False
            if "visibility:visible" in style:
                return True, True
    return True, visible


def _number(value: str | None, default: int, most: int) -> int:
    return max(1, min(int(value), most)) if value and value.strip().isdecimal() else default


def render(html: str | None) -> str:
    """The visible text of a page."""
    box, boxes, tables, counters = Box(), [], [], []
    work: list[tuple[Node | str, bool, int, bool]] = [(build(html or ""), True, 0, False)]
    while work:
        node, visible, pre, leaving = work.pop()
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                first, *others = node.replace("\r\n", "\n").split("\n")
                if box.blank and box.line:
                    box.line.append(" ")
                box.blank = False
                box.line.append(first)
                for line in others:
                    box.emit("".join(box.line))
                    box.line = [line] if line else []
            else:
                box.put(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and boxes:
                box.end_line()
                cell = box.lines
                box = boxes.pop()
                tables[-1].rows[-1].append((cell, _number(node.attribute("colspan"), 1, 1000)))
            elif tag == "table":
                table = tables.pop()
                box.end_block(True)
                for line in table.lines():
                    box.emit(line)
                box.end_block(True)
            elif tag in LISTS:
                counters.pop()
                box.end_block(not counters)
            elif tag == "li" or tag in ("blockquote", "dd"):
                box.end_block(tag == "blockquote")
                box.indents.pop()
            elif tag in ("caption", "summary"):
                box.end_line()
            elif tag in BLOCK:
                box.end_block(tag in SPACED)
            continue
        laid_out, visible = _shown(node, visible)
        if not laid_out:
            continue
        if tag == "br":
            if box.line:
                box.end_line()
            elif box.lines:
                box.emit("")
            continue
        if tag == "hr":
            box.end_block(True)
            continue
        if tag in VOID:
            continue
        if tag == "table":
            box.end_block(True)
            tables.append(Table())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th"):
            if tables and tables[-1].rows:
                boxes.append(box)
                box = Box()
            else:  # a cell outside any table is a block
                children, node = node.children, Node("div")
                node.children = children
                box.end_line()
        elif tag in LISTS:
            box.end_block(not counters)
            counters.append([tag, _number(node.attribute("start"), 1, 10**9) if tag == "ol" else 0])
        elif tag == "li":
            box.end_line()
            marker = "- "
            if counters and counters[-1][0] == "ol":
                marker = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            box.indents.append([marker, " " * len(marker), False])
        elif tag in ("blockquote", "dd"):
            box.end_block(tag == "blockquote")
            box.indents.append(["  ", "  ", False])
        elif tag in BLOCK:
            box.end_block(tag in SPACED)
        work.append((node, visible, pre, True))
        inner = pre + (tag in ("pre", "textarea"))
        work.extend((child, visible, inner, False) for child in reversed(node.children))
    box.end_line()
    return "\n".join(box.lines).strip("\n")


def _rendered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])


def extract(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: id and text."""
    rows = pages.select(F.col(id).alias("id"), F.col(html).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_rendered, f"id {kind}, text string").withColumnRenamed("id", id)
