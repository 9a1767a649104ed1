"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors (the parent all of them, each next one half
as many); a container's sum is discounted by its share of link text. The best container and
those of its siblings that look like content are kept; what they hold of menus, forms, scripts, notices and
the like is not. A form stays if it holds an article, a first heading or most of the page's text. An element whose
class or id speaks of a menu, notice or the like stays if it holds the page's main element or article.
One row in, one row out: pages need no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
GONE = frozenset("script style noscript template head nav footer aside menu button select option textarea input label fieldset iframe object embed svg canvas audio video map dialog noembed noframes title".split())
ENDS_P = BLOCK - {"body", "head", "html", "tbody", "thead", "tfoot", "tr", "td", "th", "title", "legend", "frameset"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main figcaption body".split())
HINTS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice popup modal overlay menu nav navbar navigation sidebar footer header masthead newsletter subscribe signup login toolbar pagination pager widget skip hidden alert breadcrumb breadcrumbs".split())
TALK = frozenset("comment comments disqus replies respond share sharing social related recommended".split())
AROUND = frozenset("area bar block box button buttons container content form group icons inner item items left link links list panel popup region right row section slot top bottom unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
KEPT_TAGS = frozenset(("html", "body", "article", "main"))

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*\Z|</?[a-zA-Z][^<>]*(?=<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class _Node:
    __slots__ = ("tag", "up", "gone", "doubt", "inside", "open_p", "holds", "score", "chars", "links", "parts", "commas", "kids")

    def __init__(self, tag, up, gone, doubt=""):
        self.tag, self.up, self.gone, self.doubt = tag, up, gone, doubt
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        self.open_p = self if tag == "p" else None if up is None or tag in ("td", "th", "table", "button", "object") else up.open_p
        self.score, self.chars, self.links, self.commas, self.kids, self.parts, self.holds = 0.0, 0, 0, 0, [], [], set()


def _stem(word: str) -> str:
    """A word without the word for a container that it ends with."""
    return next((word[:k] for k in range(len(word) - 1, 1, -1) if word[k:] in AROUND and word[:k] in HINTS | TALK), word)


def _hint(names: str, inside: bool) -> str:
    """What the words of a class or id say: "talk", "frame", or nothing. A word counts alone, as the last part of a name
    (cookie-banner), or before a word for a container (menu-wrap, commentlist), numbers aside (nav2); has-sidebar and the like
    say nothing of the element."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split():
        parts = [x for x in (y.rstrip("0123456789") for y in re.split(r"[-_]+", name)) if x]
        if not parts or parts[0] in ("has", "with", "no"):
            continue
        for word in map(_stem, {parts[-1], parts[0] if len(parts) == 1 or parts[1] in AROUND else parts[-1]}):
            if word in TALK:
                return "talk"
            if word in HINTS and not (inside and word in ("header", "masthead")):
                return "frame"
    return ""


def _unwanted(tag: str, attrs: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element goes, and else the reason to doubt it."""
    if tag in GONE or tag == "header" and not inside_article:
        return True, ""
    doubt = "form" if tag == "form" else ""
    if not attrs or attrs.isspace() or tag in KEPT_TAGS:
        return False, doubt
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "role" and value.lower() in ROLES and tag != "form" or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if name in ("class", "id") and tag != "form":
            doubt = _hint(value, inside_article) or doubt
    return False, doubt


def _settle(nodes: list[_Node]) -> None:
    """Decides on doubtful elements by what they hold; nodes in page order."""
    chars = {}
    for n in reversed(nodes):
        if n.gone:
            continue
        n.holds |= {n.tag} & {"article", "main", "h1"}
        chars[id(n)] = chars.get(id(n), 0) + sum(len(x.strip()) for x in n.parts if isinstance(x, str))
        if n.up is not None:
            n.up.holds |= n.holds
            chars[id(n.up)] = chars.get(id(n.up), 0) + chars[id(n)]
    whole = chars[id(nodes[0])]
    for n in nodes:
        if n.doubt == "form":
            n.gone = n.gone or not n.holds and 2 * chars[id(n)] <= whole
        elif n.doubt:
            n.gone = n.gone or not n.holds & ({"main"} if n.doubt == "talk" else {"main", "article"})
        n.gone = n.gone or n.up is not None and n.up.gone


def _tree(page: str) -> _Node:
    """Nodes in page order. ``parts`` of a node: text, child nodes, and None where a block begins or ends."""
    root = _Node("#root", None, False)
    now, at, size, opened = root, 0, len(page), Counter()

    def say(text):
        if text and not now.gone:
            now.parts.append(html.unescape(text) if "&" in text else text)

    def close(node):
        opened[node.tag] -= 1
        if node.tag in BLOCK:
            node.up.parts.append(None)
        return node.up

    for_close = root
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                now.parts.append(None)
            for_close = now if opened[tag] > 0 else root
            while for_close is not root and for_close.tag != tag:
                if for_close.tag in ("article", "main", "table", "td") and tag not in BLOCK:
                    for_close = root
                    break
                for_close = for_close.up
            if for_close is not root:
                while now is not for_close:
                    now = close(now)
                now = close(now)
            continue
        if tag in ENDS_P:
            p = now.open_p
            if p is not None:
                while now is not p:
                    now = close(now)
                now = close(now)
        if tag in SAME:
            same, stop = SAME[tag]
            p = now if any(opened[x] > 0 for x in same) else root
            while p is not root and p.tag not in same and p.tag not in stop:
                p = p.up
            if p.tag in same:
                if tag == "tr" and p.tag != "tr" and p.up.tag == "tr":
                    p = p.up
                while now is not p:
                    now = close(now)
                now = close(now)
        if tag in VOID:
            if tag in ("br", "hr"):
                now.parts.append(None)
            continue
        gone, doubt = (True, "") if now.gone else _unwanted(tag, m[3], now.inside or now.tag in ("article", "main"))
        node = _Node(tag, now, gone, doubt)
        if tag in BLOCK:
            now.parts.append(None)
        now.parts.append(node)
        now.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if not node.gone:
                node.parts.append(html.unescape(page[at : end.start() if end else size]))
            at = end.end() if end else size
            if tag in BLOCK:
                now.parts.append(None)
        elif not m[3].endswith("/") or tag not in ("path", "use", "rect", "circle"):
            now = node
            opened[tag] += 1
    return root


def _nodes(root: _Node) -> list[_Node]:
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        found.append(n)
        todo += reversed(n.kids)
    return found


def _text(node: _Node) -> list[str]:
    out, todo = [], [iter(node.parts)]
    while todo:
        for x in todo[-1]:
            if x is None:
                out.append(" ")
            elif isinstance(x, str):
                out.append(x)
            elif not x.gone:
                todo.append(iter(x.parts))
                break
        else:
            todo.pop()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; '' for null, empty and contentless pages."""
    if not page:
        return ""
    root = _tree(page)
    nodes = _nodes(root)
    _settle(nodes)
    nodes = [n for n in nodes if not n.gone]
    for n in reversed(nodes):  # children before parents
        own = [x for x in n.parts if isinstance(x, str)]
        own_chars = sum(len(x.strip()) for x in own)
        n.chars += own_chars
        n.commas += sum(x.count(",") for x in own)
        if n.tag == "a":
            n.links = n.chars
        if n.up is not None:
            n.up.chars += n.chars
            n.up.links += n.links
            n.up.commas += n.commas
    for n in nodes:
        own_chars = n.chars - sum(k.chars for k in n.kids if not k.gone and k.tag in BLOCK)
        if n.tag in PARAGRAPH and own_chars >= 25 and n.up is not None:
            points = 1 + (n.commas if n.tag == "p" or not n.kids else 0) + min(n.chars // 100, 3)
            (n.up if n.tag not in ("div", "section", "article", "main", "body") else n).score += points
    for n in reversed(nodes):
        if n.up is not None:
            n.up.score += n.score / 2
    scored = [(n.score * (1 - n.links / n.chars), -k, n) for k, n in enumerate(nodes) if n.score and n.chars and n.tag not in ("#root", "html")]
    if not scored:
        named = [n for n in nodes if n.tag in ("article", "main")] or [n for n in nodes if n.tag == "body"] or [root]
        best = max(named, key=lambda n: n.chars)
        kept = [best]
    else:
        top, _, best = max(scored, key=lambda x: x[:2])
        whole = best.up
        while whole is not None and whole.tag not in ("article", "main"):
            whole = whole.up
        best = whole or best
        kept = [best]
        if best.up is not None and best.tag != "body":
            kept = []
            for s in best.up.kids:
                density = s.links / s.chars if s.chars else 1
                value = s.score * (1 - density)
                if s is best or not s.gone and (value >= max(10, 0.2 * top) or s.tag in ("h1", "h2") and density < 0.25 or s.tag == "p" and (s.chars > 80 and density < 0.25 or density == 0 and s.chars and best.tag == "p")):
                    kept.append(s)
    return " ".join("".join(t for n in kept for t in [" ", *_text(n)]).split())


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each page, repeated rows and null ids included. Null and empty html and
    pages without content give ''; pages of any length are read whole; an empty table gives no rows; columns other than
    page_id, url and html play no part."""

    @F.pandas_udf(T.StringType())
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    out = pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
