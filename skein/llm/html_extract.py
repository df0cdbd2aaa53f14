"""HTML extraction by tree scoring.

The page is parsed to a tree without what is never text (scripts, styles, forms, ...) or, by tag,
role, class or id, not the article (menus, sidebars, adverts, notices, comments, ...). Paragraphs
give points for length and commas to their ancestors, less with distance; a container's points are
discounted by its share of link text. The best container, or the article element around it, and
the siblings that score well enough are kept, and their blocks are joined.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)(?:>|\Z)|<[!?/](?=[^A-Za-z]|[A-Za-z]*)[^>]*(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Never text. The first are blocks; the others stand within a line, which goes on after them.
DROP_BLOCKS = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "title"}
DROP = RAW | DROP_BLOCKS | {"noscript", "template", "svg", "math", "canvas", "button", "select", "object", "audio", "video", "map", "datalist", "option"}
BLOCKS = {
    "html", "body", "address", "article", "blockquote", "center", "dd", "details", "div", "dl", "dt", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "ol", "p", "pre", "search",
    "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *DROP_BLOCKS,
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag ends an open element of these, unless one of the others is open above it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "body"}
#: Words of a class, id or role that mark what isn't the article, those that do so only for a part of little text
#: or much of it in links, and those that mark the article.
AWAY = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "social share sharing breadcrumb breadcrumbs pagination pager menu menus nav navbar navigation sidebar sidebars aside "
    "widget widgets related recommended recommendations footer masthead comment comments disqus respond replies reply "
    "toolbar login search skip complementary contentinfo navigation dialog alertdialog outbrain taboola "
    "byline toc topbar topnav subnav mainnav sitenav sitemap".split()
)
DOUBTFUL = set("header hidden feedback rating tags teaser teasers reactions discussion trending popular disclaimer legal copyright".split())
NOT = {"with", "has", "no", "without", "is", "show", "below", "above"}
HERE = {"article", "articlebody", "content", "main", "story", "post", "entry", "text", "body"}
STEMS = re.compile("sidebar|comment|advert|sponsor|cookie|newsletter|breadcrumb|navbar|footer|masthead|disqus|popup|subscri|pagina")
#: A doubtful part stays if it has so many characters and no more than this share of them in links.
DOUBT_CHARS, DOUBT_LINKS = 80, 0.3
PROSE = {"p", "pre", "blockquote", "li", "td", "dd", "table", "figure", "span", "em", "strong", "b", "i", "a", *HEADINGS}
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("name", "up", "kids", "away", "doubt", "here", "points")

    def __init__(self, name: str, up: Node | None, away: bool = False, doubt: bool = False, here: bool = False):
        self.name, self.up, self.kids, self.away, self.doubt, self.here, self.points = name, up, [], away, doubt, here, 0.0


def marks(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """(not the article, perhaps not, the article), by the element's class, id, role and visibility."""
    away = doubt = here = False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            away = True
        elif key in ("class", "id", "role", "itemprop"):
            for one in value.split():
                words = [w.lower() for w in PIECE.findall(one)]
                if not words:
                    continue
                here |= words[-1] in HERE or "".join(words) in HERE
                if not NOT & set(words):
                    ends = {words[0], words[-1]}
                    away |= bool(ends & AWAY) or any(map(STEMS.match, ends))
                    doubt |= bool(ends & DOUBTFUL)
    top = name in ("html", "body")
    return away and not top, doubt and not top and name not in PROSE, here


def parse(page: str) -> Node:
    """A tree of Nodes and strings; forgiving: what isn't closed ends with its parent.

    The elements that are open are counted by name, so that looking for one that isn't takes no walk
    through all of them, however deep they are.
    """
    root = Node("html", None)
    now, at, n = root, 0, len(page)
    count: dict[str, int] = {}

    def text(s: str) -> None:
        if s:
            now.kids.append(html.unescape(s))

    def rise(to: Node) -> None:
        nonlocal now
        while now is not to:
            count[now.name] -= 1
            now = now.up

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, lt)
        if not m:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                now.kids.append(Node("br", now))
                continue
            if not count.get(name):
                continue
            inline, x = name not in BLOCKS, now
            while x is not root and x.name != name and not (inline and x.name in BLOCKS):
                x = x.up
            if x.name == name and x is not root:
                rise(x.up)
            continue
        if name in ("html", "body") and (name == "html" or count.get("body")):
            continue
        if name in BLOCKS and count.get("p"):
            x = now
            while x is not root and x.name != "p" and x.name not in SCOPE:
                x = x.up
            if x.name == "p":
                rise(x.up)
        if name in HEADINGS and now.name in HEADINGS:
            rise(now.up)
        if name in ENDS and any(map(count.get, ENDS[name][0])):
            close, stop = ENDS[name]
            x, last = now, None
            while x is not root and x.name not in stop:
                if x.name in close:
                    last = x
                x = x.up
            if last is not None:
                rise(last.up)
        if name == "a" and count.get("a"):
            x = now
            while x is not root and x.name != "a" and x.name not in BLOCKS:
                x = x.up
            if x.name == "a":
                rise(x.up)
        node = Node(name, now, *marks(name, m["attrs"]))
        now.kids.append(node)
        if name in RAW:
            e = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = e.end() if e else n
        elif name not in VOID and not (name in ("svg", "math") and m["attrs"].endswith("/")):  # others aren't closed by a slash
            now = node
            count[name] = count.get(name, 0) + 1
    return root


def _path(x: Node | None):
    while x is not None:
        yield x
        x = x.up


def prune(top: Node, by_mark: bool) -> None:
    """Takes out what isn't the article. Headers stay without their other parts if they are an article's and hold its heading."""
    size = measure(top) if by_mark else {}
    todo = [(top, False)]
    while todo:
        x, inside = todo.pop()
        inside |= x.name in ("article", "main")
        kept = []
        for k in x.kids:
            if isinstance(k, Node):
                if k.name in DROP or (by_mark and k.away and not (k.name in ("article", "main") and k.here)):
                    continue
                if by_mark and k.doubt:
                    chars, linked, _ = size[id(k)]
                    if chars < DOUBT_CHARS or linked > DOUBT_LINKS * chars:
                        continue
                if k.name == "header" and by_mark:
                    own = [y for y in _below(k) if y.name in HEADINGS] if inside else []
                    kept += own
                    for y in own:
                        y.up = x
                    todo += [(y, inside) for y in own]
                    continue
                todo.append((k, inside))
            kept.append(k)
        x.kids = kept


def _below(x: Node):
    todo = [k for k in reversed(x.kids) if isinstance(k, Node)]
    while todo:
        y = todo.pop()
        yield y
        todo += [k for k in reversed(y.kids) if isinstance(k, Node)]


def measure(top: Node) -> dict[int, tuple[int, int, int]]:
    """For each node (characters without white space at the ends, of them in links, commas) below it."""
    out: dict[int, tuple[int, int, int]] = {}
    todo = [(top, False, False)]
    while todo:
        x, linked, done = todo.pop()
        linked |= x.name == "a"
        if not done:
            todo.append((x, linked, True))
            todo += [(k, linked, False) for k in x.kids if isinstance(k, Node)]
            continue
        size = links = commas = 0
        for k in x.kids:
            if isinstance(k, Node):
                a, b, c = out[id(k)]
                size, links, commas = size + a, links + b, commas + c
            else:
                s = len(k.strip())
                size, links, commas = size + s, links + s * linked, commas + k.count(",")
        out[id(x)] = size, links, commas
    return out


def best(top: Node) -> list[Node]:
    """The nodes to keep: the best container (or the article around it) and siblings, in page order."""
    size = measure(top)
    nodes = [top, *_below(top)]
    scored: dict[int, Node] = {}
    for x in nodes:
        own = sum(len(k.strip()) for k in x.kids if not isinstance(k, Node))
        if x.name not in ("p", "pre", "td", "blockquote", "li", "dd") and not (own and x.name in BLOCKS and x.name not in HEADINGS):
            continue
        chars, _, commas = size[id(x)] if x.name in ("p", "pre", "td", "blockquote") else (own, 0, 0)
        if not chars:
            continue
        points = 1 + commas + min(chars / 100, 3.0)
        to = x if x.name not in ("p", "pre", "li", "dd") else x.up
        for level, y in enumerate(_path(to)):
            if level > 4:
                break
            y.points += points if level == 0 else points / (2 if level == 1 else level * 3)
            scored[id(y)] = y

    def score(y: Node) -> float:
        chars, linked, _ = size[id(y)]
        bonus = 30 if y.name in ("article", "main") else 5 if y.name in ("div", "section") else 0
        if y.name in ("ul", "ol", "dl", "th", "address", *HEADINGS):
            bonus = -3
        return (y.points + bonus + 25 * y.here) * (1 - linked / max(chars, 1))

    if not scored:
        return [top]
    win = max(scored.values(), key=score)
    for y in _path(win):
        if y.name in ("article", "main"):
            win = y
            break
    if win.up is None or win.name in ("article", "main"):
        return [win]
    least, out = 0.2 * score(win), []
    for k in win.up.kids:
        if not isinstance(k, Node):
            continue
        chars, linked, _ = size[id(k)]
        if k is win:
            out.append(k)
        elif not chars:
            continue
        elif k.name in HEADINGS:
            if linked / chars < 0.5:
                out.append(k)
        elif k.name == "p" and linked / chars < 0.25:
            out.append(k)
        elif id(k) in scored and score(k) >= least:
            out.append(k)
    return out


def blocks(kept: list[Node]) -> list[str]:
    """The blocks' texts, with one space for white space, without empty ones."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if part:
            s = " ".join("".join(part).split())
            part.clear()
            if s:
                out.append(s)

    todo: list = [*reversed(kept)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif not isinstance(x, Node):
            part.append(x)
        elif x.name in ("br", "hr", "wbr"):
            part.append("" if x.name == "wbr" else " ")
        else:
            if x.name in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's text: its blocks joined by one space; empty for null, empty or textless pages."""
    if not page:
        return ""
    for by_mark in (True, False):
        top = parse(page)
        prune(top, by_mark)
        if text := " ".join(blocks(best(top))):
            return text
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages(page_id, url, html).

    The whole html is read; null, empty or textless pages have an empty text. Where marks by class or
    role leave nothing, the page is read again without them. Repeated rows stay; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    got = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return got.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text, by extract() over the whole table."""
    return extract(table(spark, sf_dir, "pages"))
