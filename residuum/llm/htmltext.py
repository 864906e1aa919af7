"""HTML extraction: a tree builder with implied tags, then a layout walk that emits all visible text.

The tree keeps what a browser would show: void elements, end tags that close what was left open,
start tags that end a paragraph, list item, cell or row, text that is raw in scripts and styles. The walk
skips invisible elements, collapses blanks, puts one line break around blocks and an empty line around
paragraphs and headings, marks list items, keeps preformatted text and pads table cells to columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element classes of the language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("script style head title template noscript iframe object audio video canvas datalist noembed noframes param".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure hr".split())
ENDS_P = BLOCK - set("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend".split())
#: A start tag ends an open element of the second set, unless an element of the third lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set()),
}
#: Elements that an end tag of something inside or outside does not close.
WALLS = {"table", "td", "th", "caption", "html", "template", "button", "object"}
PARTS = {"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
DELIMITER = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NO_BOX = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)
NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
#: Open elements at most, as in browsers: what is nested deeper stands beside its parent.
DEEPEST = 512
#: Cells are padded to the widest cell of their column, but no further than this; and columns that one cell may span.
WIDEST, MOST_SPANNED = 120, 1000
#: Blanks that a line begins with at most.
MOST_INDENTED = 64
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "shown", "lines")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.shown: bool = True
        self.lines: list[str] | None = None


class Tags:
    """Where a tag ends. A start that cannot end is remembered by the quotes it met, so no part of a page is read twice in vain."""

    def __init__(self, source: str):
        self.source, self.doomed = source, set()
        self.unclosed: dict[str, int] = {}
        self.last = source.rfind(">")

    def end(self, at: int) -> int:
        """The next ``>`` outside quotes, or -1."""
        met: list[int] = []
        while at <= self.last:
            found = DELIMITER.search(self.source, at)
            mark, place = found[0], found.start()
            if mark == ">":
                return place
            if place in self.doomed or place >= self.unclosed.get(mark, len(self.source)):
                break
            met.append(place)
            closing = self.source.find(mark, place + 1)
            if closing < 0:
                self.unclosed[mark] = place
                break
            at = closing + 1
        self.doomed.update(met)
        return -1


def parse(source: str) -> Node:
    """The tree of a page; texts are strings among the children, entities resolved. Every character is looked at a bounded number of times."""
    root = Node("html", {})
    stack, at, size, tags_of = [root], 0, len(source), Tags(source)
    opened: Counter[str] = Counter()

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    def drop(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    def close(tags: set[str], walls: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                drop(depth)
                return
            if stack[depth].tag in walls:
                return

    while at < size:
        found = TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at:found.start()])
        ending, name = found[1], found[2]
        if not name:
            # A comment or declaration; one that is not ended takes the rest.
            mark = "-->" if found[0] == "<!--" else ">"
            end = source.find(mark, found.end())
            at = size if end < 0 else end + len(mark)
            continue
        end = tags_of.end(found.end())
        if end < 0:
            text(found[0])
            at = found.end()
            continue
        at = end + 1
        name = name.lower()
        if ending:
            if name == "p" and not opened["p"]:
                stack[-1].children.append(Node("p", {}))
            elif name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name not in ("html", "body"):
                close({name}, ({"table"} if name in PARTS else WALLS) - {name})
            continue
        written = source[found.end():end]
        attributes = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(written)} if written.strip(" /") else {}
        if name == "html":
            continue
        if name in IMPLIED:
            # A new row or group also ends the cells in it: outermost first.
            tags, walls = IMPLIED[name]
            while True:
                before = len(stack)
                close(tags, walls)
                if len(stack) == before:
                    break
        elif name in ENDS_P:
            close({"p"}, WALLS)
        if stack[-1].tag == "head" and name not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            drop(len(stack) - 1)
        if len(stack) >= DEEPEST:
            drop(len(stack) - 1)
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            raw_end = RAW_END[name].search(source, at)
            raw = source[at:raw_end.start() if raw_end else size]
            node.children.append(html.unescape(raw) if name in ("textarea", "title") else raw)
            at = size if not raw_end else (source.find(">", raw_end.start()) + 1 or size)
            continue
        stack.append(node)
        opened[name] += 1
    return root


RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}


def hidden(node: Node) -> bool:
    """Elements without a box; ``visibility`` is another matter, as what is inside can be visible again."""
    if node.tag in HIDDEN or "hidden" in node.attributes:
        return True
    if node.tag == "input" or (node.tag == "dialog" and "open" not in node.attributes):
        return True
    style = node.attributes.get("style")
    return bool(style and NO_BOX.search(style))


def visible_children(node: Node) -> list:
    """Children that are laid out: of a select the chosen option, of a drawing its texts."""
    if node.tag == "select":
        options, todo = [], [node]
        while todo:
            n = todo.pop()
            if n.tag == "option":
                options.append(n)
            else:
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        chosen = [o for o in options if "selected" in o.attributes] or options[:1]
        return [c for o in chosen for c in o.children]
    if node.tag == "svg":
        texts, todo = [], [c for c in reversed(node.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            if n.tag in ("text", "foreignobject"):
                texts += [" ", n, " "]
            elif n.tag not in ("title", "desc", "defs", "symbol", "metadata") and not hidden(n):
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        return texts
    return node.children


class Writer:
    """Lines of text with pending breaks; ``prefix`` goes before every line, ``mark`` before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.space = False
        self.indent, self.mark = "", None

    def write(self, piece: str, keep: bool = False) -> None:
        if keep:
            for i, part in enumerate(piece.split("\n")):
                if i:
                    self.end(True)
                if part:
                    self.line.append(part)
            return
        piece = BLANKS.sub(" ", piece)
        body = piece.strip(" ")
        if not body:
            self.space = self.space or bool(piece and self.line)
            return
        if self.line and (self.space or piece[0] == " "):
            self.line.append(" ")
        self.line.append(body)
        self.space = piece[-1] == " "

    def end(self, always: bool = False) -> None:
        if self.line or always:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            mark = self.indent if self.mark is None else self.mark
            self.mark = None
            self.lines.append((mark + "".join(self.line)).rstrip(" "))
            self.line = []
        self.space = False

    def apart(self) -> None:
        self.end()
        self.blank = True

    def text(self) -> str:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows of cells of a table, nested tables left alone."""
    captions, rows, todo = [], [], [table]
    while todo:
        node = todo.pop()
        if node is not table and (hidden(node) or node.tag == "table"):
            continue
        if node.tag == "caption":
            captions.append(node)
        elif node.tag == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)])
        else:
            loose = [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if loose:
                rows.append([c for c in loose if not hidden(c)])
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in ("td", "th")]
    return captions, [r for r in rows if r]


def _table(table: Node, writer: Writer) -> None:
    captions, rows = _rows(table)
    cells = set(map(id, (c for r in rows for c in r))) | set(map(id, captions))
    writer.apart()
    # What stands in a table but in no cell is shown before it.
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if table.shown:
                writer.write(node)
        elif id(node) not in cells and not hidden(node):
            if node.tag in ("tr", "tbody", "thead", "tfoot"):
                todo += reversed(node.children)
            elif node.tag not in ("col", "colgroup"):
                _walk(node, writer)
    for caption in captions:
        writer.end()
        _walk(caption, writer)
    writer.end()
    texts = []
    for r in rows:
        line = []
        for c in r:
            found = NUMBER.match(c.attributes.get("colspan", ""))
            spanned = min(MOST_SPANNED, max(1, int(found[1]))) if found else 1
            line.append((" ".join(render(c).split("\n")), spanned))
            line += [("", 0)] * (spanned - 1)
        texts.append(line)
    widths: list[int] = []
    for r in texts:
        widths += [0] * (len(r) - len(widths))
        for i, (t, spanned) in enumerate(r):
            if spanned == 1 and len(t) <= WIDEST:
                widths[i] = max(widths[i], len(t))
    for r in texts:
        last = max((i for i, (t, _) in enumerate(r) if t), default=-1)
        # Columns that no cell fills are not shown.
        writer.write("  ".join(t.ljust(w) for (t, _), w in zip(r[:last + 1], widths) if t or w).rstrip(" "), keep=True)
        writer.end()
    writer.apart()


def lay_tables(root: Node) -> None:
    """Set what is visible, then lay out every table, inner ones first, so that tables never nest in calls."""
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        found = VISIBILITY.search(node.attributes.get("style", ""))
        if found:
            node.shown = found[1].lower() not in ("hidden", "collapse")
        if node.tag == "table":
            tables.append(node)
        for c in node.children:
            if isinstance(c, Node):
                c.shown = node.shown
                if not hidden(c):
                    todo.append(c)
    for table in reversed(tables):
        writer = Writer()
        _table(table, writer)
        table.lines = writer.text().split("\n")


def _walk(top: Node, writer: Writer) -> None:
    """Depth first with a stack of its own; tables inside are laid out already."""
    todo: list[tuple] = [("open", top, False, None)]
    while todo:
        step, node, keep, saved = todo.pop()
        if step == "text":
            writer.write(node, keep)
            continue
        if step == "close":
            writer.apart() if node.tag in SPACED and saved[1] else writer.end()
            if node.tag == "li" and writer.mark is not None:
                writer.mark = None  # an empty item shows nothing
            writer.indent = saved[0]
            continue
        if node is not top and hidden(node):
            continue
        tag = node.tag
        if tag == "br":
            writer.end(True)
            continue
        if tag == "table":
            writer.apart()
            for line in node.lines or ():
                if line:
                    writer.write(line, keep=True)
                    writer.end()
                else:
                    writer.blank = True
            writer.apart()
            continue
        if tag == "hr":
            writer.apart()
            continue
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and writer.indent != ""
            apart = tag in SPACED and not nested
            writer.apart() if apart else writer.end()
            saved = (writer.indent, apart)
            if tag == "li":
                number = node.attributes.get("_number")
                mark = f"{number}. " if number else "- "
                writer.mark = writer.indent + mark
                writer.indent = (writer.indent + " " * len(mark))[:MOST_INDENTED]
            elif tag in ("blockquote", "dd"):
                writer.indent = (writer.indent + "  ")[:MOST_INDENTED]
            todo.append(("close", node, keep, saved))
        if tag == "ol":
            begin = NUMBER.match(node.attributes.get("start", ""))
            at = int(begin[1]) if begin else 1
            for child in node.children:
                if isinstance(child, Node) and child.tag == "li":
                    child.attributes = child.attributes | {"_number": str(at)}
                    at += 1
        keep = keep or tag in ("pre", "textarea", "xmp")
        for c in reversed(visible_children(node)):
            if isinstance(c, Node):
                todo.append(("open", c, keep, None))
            elif node.shown:
                todo.append(("text", c, keep, None))


def render(node: Node) -> str:
    writer = Writer()
    _walk(node, writer)
    return writer.text()


def visible_text(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    lay_tables(root)
    return render(root)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, text (all visible text), n_chars and n_lines.

    Null or empty html, and pages that show nothing, give an empty text; broken html gives what the tree
    builder makes of it; very long pages take time in proportion, and nesting beyond ``DEEPEST`` is flattened as browsers do; repeated rows are rendered each; an empty table gives no rows; further columns are
    ignored. Pages do not meet, so nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [visible_text(s.as_py()) for s in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                                                  pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_lines long")
