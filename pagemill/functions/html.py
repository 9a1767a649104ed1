"""One-pass HTML reading with the standard library: element and text rows, and the visible text of one page.

Spark deals out the pages; these helpers see one page at a time.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SILENT = frozenset(("script", "style", "noscript", "template", "head", "title"))


class Node:
    __slots__ = ("tag", "attrs", "up", "kids", "id")

    def __init__(self, tag, attrs, up, id_):
        self.tag, self.attrs, self.up, self.kids, self.id = tag, attrs, up, [], id_


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None, 0)
        self.now, self.n = self.root, 0
        self.open = Counter()  # open elements by tag, so that an end without a start costs nothing

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_within("p", ("div", "td", "th", "table", "button", "article", "section"))
        if tag == "li":
            self._close_within("li", ("ul", "ol", "menu"))
        self.n += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now, self.n)
        self.now.kids.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def _leave(self, node):
        """Closes node and all that is open within it."""
        x = self.now
        while x is not node:
            self.open[x.tag] -= 1
            x = x.up
        self.open[node.tag] -= 1
        self.now = node.up

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_within(self, tag, stop):
        if not self.open[tag]:
            return
        x = self.now
        while x is not self.root and x.tag != tag and x.tag not in stop:
            x = x.up
        if x.tag == tag:
            self._leave(x)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        x = self.now
        while x.tag != tag:
            x = x.up
        self._leave(x)

    def handle_data(self, data):
        self.now.kids.append(data)


def read(page: str | None) -> Node:
    r = _Reader()
    r.feed(page or "")
    r.close()
    return r.root


def walk(root: Node):
    """Elements in page order."""
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag != "#root":
            yield n
        todo += [k for k in reversed(n.kids) if isinstance(k, Node)]


def text_of(node: Node) -> str:
    """All text below a node, scripts and the like left out."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in SILENT or n is node:
            todo += reversed(n.kids)
    return "".join(out)


def visible_text(page: str | None) -> str:
    """text_of a whole page."""
    root = read(page)
    text = text_of(root)
    _let_go(root)
    return text


def _lengths(elements: list[Node]) -> dict[int, int]:
    """The length of each element's stripped text by id, children first, so that no text is read twice."""
    parts = {}  # characters, and how many of them are white space at the start and at the end
    for n in reversed(elements):
        size = lead = trail = 0
        for k in n.kids:
            if isinstance(k, str):
                c, left, right = len(k), len(k) - len(k.lstrip()), len(k) - len(k.rstrip())
            elif k.tag in SILENT:
                continue
            else:
                c, left, right = parts[k.id]
            lead += left if lead == size else 0
            trail = trail + c if right == c else right
            size += c
        parts[n.id] = (size, lead, trail)
    return {i: 0 if lead == size else size - lead - trail for i, (size, lead, trail) in parts.items()}


def element_rows(page: str | None) -> list[tuple]:
    """(node_id, parent_id, tag, attrs, text_len, text, last_id) of each element; the elements it holds have the ids after
    its own up to last_id."""
    root = read(page)
    rows = element_rows_of(root)
    _let_go(root)
    return rows


def _let_go(root: Node) -> None:
    """Cuts the ways up of a tree that is read, so that it goes at once and not when the collector comes round."""
    for n in walk(root):
        n.up = None


def element_rows_of(root: Node) -> list[tuple]:
    elements = list(walk(root))
    length = _lengths(elements)
    last = {}
    for n in reversed(elements):
        last.setdefault(n.id, n.id)
        last[n.up.id] = max(last.get(n.up.id, 0), last[n.id])
    return [(n.id, n.up.id, n.tag, n.attrs, length[n.id], n.kids[0] if len(n.kids) == 1 and isinstance(n.kids[0], str) else None, last[n.id]) for n in elements]


def page_rows(page: str | None) -> list[tuple]:
    """element_rows with (seq, last_seq, parent_tag, item_id) after each row, and rows of the texts between elements, which have the
    tag #text and no node_id. seq numbers elements and texts in page order; item_id is the nearest li around a row."""
    root = read(page)
    own = {r[0]: r for r in element_rows_of(root)}
    out, last, todo = [], {}, [(k, root, None) for k in reversed(root.kids)]
    while todo:
        n, up, item = todo.pop()
        seq = len(out) + 1
        if isinstance(n, str):
            out.append((None, up.id, "#text", None, None, n, None, seq, seq, up.tag, item))
        else:
            out.append((*own[n.id], seq, seq, up.tag, item))
            inner = n.id if n.tag == "li" else item
            todo += [(k, n, inner) for k in reversed(n.kids)]
    _let_go(root)
    for r in reversed(out):  # children come after their parents
        here = last[r[0]] if r[0] in last else r[7]
        last[r[1]] = max(last.get(r[1], 0), here)
    return [(*r[:8], last.get(r[0], r[7]) if r[0] is not None else r[7], *r[9:]) for r in out]
