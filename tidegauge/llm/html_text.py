"""Visible text of web pages, laid out: blocks, lists and aligned table cells.

A page is cut into tags and text, and built into a tree whose missing tags are implied:
a new list item, paragraph, row or cell ends the one before, an end tag ends what stands
open inside it, and one that matches nothing is ignored. Elements that a browser does
not show (by tag, attribute, inline style or a simple style sheet rule) are left out with
all they hold. Rules count that hold on any screen: those in @-blocks for print, widths
and other conditions do not; a rule that hides is not weighed against one that shows. Of
drawings the text elements are shown, of formulas their text. The rest is written as lines: block elements break the line, paragraphs
and the like keep a blank line around them, list items get their marker and indent, and
the cells of a table stand in columns as wide as their widest line (up to ``WIDEST``
characters; a longer line runs over). A row is as high as its tallest cell. A cell of
several lines that holds blocks or a table, has a line over ``WIDEST`` or would stand
beyond column ``FARTHEST`` is written by itself, between blank lines.

Every step works with lists and stacks of its own, so depth is no limit, and reads the
page once. A null page or one without visible text gives an empty text. What is not
closed (a comment, a quoted value, a script) goes on to the end of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.rows import map_rows

VOID = set("area base br col embed hr img input link meta source track wbr param".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = set("head script style title template noscript iframe noembed noframes datalist object video audio canvas rp annotation annotation-xml".split())
#: Parts of a drawing that are only drawn where they are referred to.
UNDRAWN = set("defs symbol clippath mask pattern marker".split())
#: Tags that end an open drawing or formula, and what in these may hold them.
ENDS_FOREIGN = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Blocks with a blank line around them, and blocks that only break the line.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure hr menu fieldset".split())
BLOCKS = SPACED | set(
    "div section article header footer main nav aside address li dt dd tr caption form figcaption details summary option optgroup body html legend center dialog hgroup search".split()
)
#: What ends an open <p>.
ENDS_P = BLOCKS - {"li", "dt", "dd", "tr", "caption", "option", "optgroup", "body", "html", "legend"}
#: New tag -> (open tags that it ends, tags beyond which it does not look).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"body"}),
}
#: Content that ends an open head.
IN_HEAD = set("title meta link style script base noscript template".split())
#: An end tag does not close what is outside the table cell it stands in.
WALLS = {"td": {"table"}, "th": {"table"}, "li": {"ul", "ol", "menu"}}
WIDEST, FARTHEST = 40, 120
SPACE = re.compile(r"[ \t\n\r\f]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)[ \t\n\r\f]*(=)?[ \t\n\r\f]*")
BARE = re.compile(r"[^\s>]*")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|[{};]|[^{};"'/]+|/""", re.S)
#: Blocks of rules that hold on every screen.
ANY_SCREEN = re.compile(r"@layer\b.*|@media\s+(?:.*,)?\s*(?:(?:only\s+)?(?:all|screen)|not\s+print)\s*(?:,.*)?", re.I | re.S)
SIMPLE = re.compile(r"^([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?$")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes); kinds are text, raw, open, empty (<a/>) and close."""
    at, n, foreign = 0, len(page), 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        if lt > at:
            yield "text", page[at:lt], {}
        follow = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif follow in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif follow == "/":
            name = NAME.match(page, lt + 2)
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            if name:
                foreign = max(0, foreign - (name[0].lower() in ("svg", "math")))
                yield "close", name[0].lower(), {}
        elif name := NAME.match(page, lt + 1):
            tag, at, attributes, empty = name[0].lower(), name.end(), {}, False
            while True:
                found = ATTRIBUTE.match(page, at)
                if not found:
                    end = page.find(">", at)
                    empty, at = end > at and page[end - 1] == "/", end + 1 or n
                    break
                at, key, value = found.end(), found[1].lower(), ""
                if found[2]:
                    quote = page[at : at + 1]
                    if quote in ('"', "'") and quote:
                        end = page.find(quote, at + 1)
                        value, at = (page[at + 1 :], n) if end < 0 else (page[at + 1 : end], end + 1)
                    else:
                        bare = BARE.match(page, at)
                        value, at = bare[0], bare.end()
                attributes.setdefault(key, html.unescape(value))
            yield "empty" if empty else "open", tag, attributes
            foreign += tag in ("svg", "math") and not empty
            if tag in RAW and not (empty and foreign):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else n
                yield "raw", page[at:stop], {}
                at = stop
        else:
            yield "text", "<", {}
            at = lt + 1


def tree(page: str) -> tuple[Node, str]:
    """The root of the page's tree, and the text of its style sheets."""
    root = Node("#root", {})
    stack, count, sheets = [root], Counter(), []

    def close() -> None:
        count[stack.pop().tag] -= 1

    def end_open(ended: set[str], walls: set[str]) -> None:
        """End the outermost open element of ``ended`` that is not beyond a wall."""
        if not any(count[t] for t in ended):
            return
        last = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in walls:
                break
            if stack[i].tag in ended:
                last = i
        while last is not None and len(stack) > last:
            close()

    for kind, name, attributes in tokens(page):
        if kind == "text":
            stack[-1].children.append(html.unescape(name) if "&" in name else name)
            if name.strip() and count["head"] and stack[-1].tag == "head":
                text = stack[-1].children.pop()
                close()
                stack[-1].children.append(text)
        elif kind == "raw":
            if stack[-1].tag == "style":
                media = stack[-1].attributes.get("media", "").strip()
                if not (count["noscript"] or count["template"]) and (not media or ANY_SCREEN.fullmatch(f"@media {media}")):
                    sheets.append(name)
            elif stack[-1].tag == "textarea":
                stack[-1].children.append(html.unescape(name))
            elif stack[-1].tag == "xmp":
                stack[-1].children.append(name)
        elif kind in ("open", "empty"):
            if count["head"] and name not in IN_HEAD and name != "head":
                end_open({"head"}, set())
            if name in ENDS_FOREIGN:
                end_open({"svg", "math"}, HOLDS_HTML)
            if name in IMPLIED:
                end_open(*IMPLIED[name])
            if name in ENDS_P and count["p"]:
                end_open({"p"}, {"td", "th", "table", "button"})
            if name in ("html", "body", "head") and count[name]:
                continue
            node = Node(name, attributes)
            stack[-1].children.append(node)
            foreign = name in ("svg", "math") or (count["svg"] or count["math"]) and not count["foreignobject"] or name == "foreignobject"
            if name not in VOID and not (kind == "empty" and foreign):
                stack.append(node)
                count[name] += 1
        elif name == "br":
            stack[-1].children.append(Node("br", {}))
        elif count[name]:
            walls = WALLS.get(name, {"td", "th"} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in walls:
                    break
        elif name == "p":
            stack[-1].children.append(Node("p", {}))
    return root, "\n".join(sheets)


def rules(sheets: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on any screen, nested ones left out."""
    # Open blocks: (what stands before the brace, whether its rules hold, own declarations).
    blocks: list[tuple[str, bool, list[str]]] = [("", True, [])]
    held: list[str] = []
    for found in CSS.finditer(sheets):
        part = found[0]
        if part.startswith("/*"):
            continue
        if part == "{":
            before = "".join(held).strip()
            holds = blocks[-1][1] and bool(ANY_SCREEN.fullmatch(before)) if before.startswith("@") else False
            # Of a rule within a rule neither selectors nor declarations are of use.
            own = before if blocks[-1][1] and not before.startswith("@") else ""
            blocks.append((own, holds, []))
            held.clear()
        elif part == "}":
            if len(blocks) > 1:
                selectors, _, declarations = blocks.pop()
                if selectors:
                    yield selectors, ";".join([*declarations, "".join(held)])
            held.clear()
        elif part == ";":
            blocks[-1][2].append("".join(held))
            held.clear()
        else:
            held.append(part)
    for selectors, _, declarations in blocks[1:]:
        if selectors:
            yield selectors, ";".join([*declarations, "".join(held)])


def hidden_by_sheet(sheets: str) -> set[tuple[str, str]]:
    """(tag or '', '.class' or '#id' or '') of simple selectors that hide."""
    out = set()
    for selectors, body in rules(sheets):
        if HIDING.search(body):
            for s in selectors.split(","):
                m = SIMPLE.match(s.strip())
                if m and s.strip():
                    out.add(((m[1] or "").lower(), (m[2] or "") + (m[3] or "")))
    return out


def is_hidden(node: Node, sheet: set[tuple[str, str]]) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or HIDING.search(a.get("style", "")):
        return True
    if node.tag == "dialog" and "open" not in a:
        return True
    if sheet:
        marks = ["", *("." + c for c in a.get("class", "").split()), "#" + a.get("id", "")]
        return any((t, m) in sheet for t in ("", node.tag) for m in marks if t or m)
    return False


def is_undrawn(node: Node) -> bool:
    a = node.attributes
    return node.tag in UNDRAWN or a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse")


class Frame:
    """Lines of one column of text: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.held: list[str] = []
        self.gap, self.marker, self.indents = 0, "", []
        # Whether it holds blocks, and preformatted text.
        self.blocks = self.kept = False

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.expandtabs(8).split("\n")
            self.held.append(first)
            for line in rest:
                self.flush(True)
                self.held.append(line)
            return
        text = SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.held or self.held[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.held.append(text)

    def flush(self, keep: bool = False) -> None:
        """End the line; an empty one counts only where blanks are kept."""
        line = "".join(self.held)
        self.held.clear()
        line = line.rstrip() if keep else line.strip(" ")
        if not line and not (keep and self.lines):
            return
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = "".join(self.indents)
        if self.marker:
            indent = indent[: len(indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((indent + line).rstrip())

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def span_of(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


class Cell:
    """Lines of a table cell, the columns and rows that it spans, and whether it stands by itself."""

    __slots__ = ("alone", "column", "deep", "lines", "wide")

    def __init__(self, lines: list[str], blocks: bool, wide: int, deep: int):
        self.lines, self.wide, self.deep, self.column = lines, wide, deep, 0
        self.alone = len(lines) > 1 and (blocks or max(map(len, lines)) > WIDEST)


class Table:
    """Cells of a table, row by row."""

    def __init__(self):
        self.rows: list[list[Cell]] = []
        self.caption: list[str] = []
        self.kept = False

    def lines(self) -> list[str]:
        # Place the cells: what spans down from a row above takes its columns first.
        down: dict[int, int] = {}
        for row in self.rows:
            column, spanning = 0, {}
            for cell in row:
                while down.get(column, 0) > 0:
                    column += 1
                cell.column = column
                if cell.deep > 1:
                    spanning.update({c: cell.deep for c in range(column, column + cell.wide)})
                column += cell.wide
            down = {c: d - 1 for c, d in down.items() if d > 1}
            for c, d in spanning.items():
                down[c] = d - 1
        widths: dict[int, int] = {}
        for row in self.rows:
            for cell in row:
                if cell.wide == 1 and not cell.alone:
                    for line in cell.lines or [""]:
                        if len(line) <= WIDEST:
                            widths[cell.column] = max(widths.get(cell.column, 0), len(line))
        starts, at = {}, 0
        last = max((cell.column for row in self.rows for cell in row), default=-1)
        for column in range(last + 1):
            starts[column] = at
            if column in widths:
                at += widths[column] + 2
        out, gap = list(self.caption), False
        for row in self.rows:
            # Cells side by side, and between them those that stand by themselves.
            beside: list[Cell] = []
            for cell in [*row, None]:
                alone = cell is not None and (cell.alone or len(cell.lines) > 1 and starts[cell.column] > FARTHEST)
                if cell is not None and not alone:
                    beside.append(cell)
                    continue
                for lines, apart in ((side_by_side(beside, starts), False), (cell.lines if alone else [], True)):
                    if lines:
                        if out and (gap or apart):
                            out.append("")
                        out.extend(lines)
                        gap = apart
                beside = []
        return out


def side_by_side(cells: list[Cell], starts: dict[int, int]) -> list[str]:
    out, k = [], 0
    cells = [cell for cell in cells if cell.lines]
    while cells:
        line = ""
        for cell in cells:
            text, start = cell.lines[k], starts[cell.column]
            if text:
                line = line.ljust(start) if len(line) + 2 <= start or not line else f"{line}  "
                line += text
        out.append(line)
        k += 1
        cells = [cell for cell in cells if len(cell.lines) > k]
    return out


def render(root: Node, sheet: set[tuple[str, str]]) -> str:
    """The tree as lines of text."""
    frames, tables, lists = [Frame()], [], []
    keep = 0
    #: Whether text is shown here: in a drawing only within its text elements.
    drawn = [True]
    todo: list[tuple[Node, Iterator, object]] = []

    def enter(node: Node) -> None:
        nonlocal keep
        tag, frame, undo = node.tag, frames[-1], None
        if tag in BLOCKS:
            frame.blocks = True
        if tag == "table":
            frame.block(1)
            tables.append(Table())
            # Cells are the only columns of text in a table; the rest of it goes into one that has none.
            frames.append(Frame())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and tables:
            frames.append(Frame())
            frames[-1].kept = keep > 0
        elif tag in BLOCKS:
            frame.block(1 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu")) else 0)
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1").strip()
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if kind[0] == "ol":
                    value = node.attributes.get("value", "").strip()
                    kind[1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else kind[1]
                    undo = f"{kind[1]}. "
                    kind[1] += 1
                else:
                    undo = "- "
                frame.marker = undo
                frame.indents.append(" " * len(undo))
            elif tag in ("blockquote", "dd"):
                frame.indents.append("    " if tag == "dd" else "  ")
            elif tag in ("pre", "xmp"):
                keep += 1
                frame.kept = True
        elif tag == "br":
            if "".join(frame.held).strip():
                frame.flush(keep > 0)
            elif frame.lines:
                frame.gap = max(frame.gap, 1)
        elif tag == "q":
            frame.text('"', True)
        elif tag == "svg" or len(drawn) > 1 and tag in ("text", "foreignobject"):
            drawn.append(tag != "svg")
            frame.block(0) if tag != "svg" else None
        elif tag == "mtr":
            frame.block(0)
        elif tag == "mtd":
            frame.text(" ", False)
        children = iter(node.children)
        if tag == "details" and "open" not in node.attributes:
            # A closed one shows its summary only.
            children = iter([c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1])
        todo.append((node, children, undo))

    def leave(node: Node, undo: object) -> None:
        nonlocal keep
        tag = node.tag
        if tag == "table":
            loose, table = frames.pop(), tables.pop()
            loose.flush()
            frame = frames[-1]
            frame.kept |= table.kept or loose.kept
            # Text between cells is shown before the table, as browsers do.
            for line in [*loose.lines, *table.lines()]:
                frame.held.append(line)
                frame.flush(True)
            frame.block(1)
        elif tag in ("td", "th", "caption") and tables and len(frames) > 1:
            cell = frames.pop()
            cell.flush(keep > 0)
            lines = cell.lines
            while lines and not lines[-1]:
                lines.pop()
            tables[-1].kept |= cell.kept
            if len(lines) == 1 and not cell.kept:
                lines = [" ".join(lines[0].split())]
            if tag == "caption":
                tables[-1].caption.extend(lines)
            else:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append(Cell(lines, cell.blocks, span_of(node, "colspan", 1000), span_of(node, "rowspan", 65534)))
        elif tag in BLOCKS:
            frame = frames[-1]
            if tag in ("pre", "xmp"):
                frame.flush(True) if frame.held and "".join(frame.held).strip() else frame.held.clear()
                while frame.lines and not frame.lines[-1]:
                    frame.lines.pop()
                keep -= 1
            frame.block(1 if tag in SPACED and not (len(lists) > 1 and tag in ("ul", "ol", "menu")) else 0)
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "li":
                frame.marker = ""
            if tag in ("li", "blockquote", "dd") and frame.indents:
                frame.indents.pop()
        elif tag == "q":
            frames[-1].text('"', True)
        elif tag == "svg" or len(drawn) > 1 and tag in ("text", "foreignobject"):
            drawn.pop()
            frames[-1].block(0) if tag != "svg" else None

    enter(root)
    while todo:
        node, children, undo = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
            leave(node, undo)
        elif isinstance(child, str):
            if drawn[-1]:
                frames[-1].text(child, keep > 0)
        elif not is_hidden(child, sheet) and not (len(drawn) > 1 and is_undrawn(child)):
            enter(child)
    frames[0].flush()
    return "\n".join(frames[0].lines)


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    root, sheets = tree(page)
    return render(root, hidden_by_sheet(sheets) if sheets else set())


def extract(pages: DataFrame, html_column: str, out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with the visible text of each page."""
    def make(texts: list[str | None]) -> list:
        return [[visible_text(t) for t in texts]]

    return map_rows(pages, html_column, T.StructType([T.StructField(out, T.StringType())]), make, keep)
