"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that are never part of an article
(scripts, styles, forms, navigation, asides, footers, and those whose class, id
or role names them so) are left out. Every other element gets its composite
text density: characters per tag (formatting tags aside), reduced by the share of link characters and
link tags as against the body's. The element whose children's densities sum to
the most is the core of the article; the least density on its path to the body
is the threshold. The main text grows from the core towards the body: beside it, and
beside what holds it, headings and what they head and whatever reaches the threshold
are the article's too, with what stands between them, but for what is mostly links; so
is prose within an article or main element, whatever its density.

A class, id or role names what is left out by a word of ``NOISE``, alone or joined
to others of them or of ``PLAIN``; it says nothing of a heading, nor an id of prose in an
article, whose ids are made of their words. An element stays, whatever it is, if it holds main,
or all of the page's articles, or over half of the page's text (unless this
stands beside an article or main with text of its own).

Defined cases: a null html is empty and gives an empty text; a page without
text gives an empty text; unclosed and stray tags are repaired as browsers do
for paragraphs, list items, table cells and options, in left-out elements too; a
quote without its end doesn't quote; a script, style, title, text area or frame
without its end tag takes the rest of the page; repeated rows are
extracted each; null page_id and url stay null; other columns have no effect. The
time grows with the page's length, whatever is unclosed in it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflume.llm._common import table

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: Elements whose content isn't markup, up to their end tag; the others named here are ordinary ones where that is missing.
_RAW = frozenset("script style textarea title iframe".split())
_CLOSED = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in (*_RAW, "noscript", "template", "svg", "select", "canvas", "object")}
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button dialog menu audio video input script style noscript template textarea iframe svg title select canvas object".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words in a class, id or role that mark what isn't the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget toolbar pagination pager search tags contentinfo complementary".split()
)
#: Words that, joined to a word of NOISE in one class or id, don't change what it says.
PLAIN = frozenset("area article bar block bottom box button buttons container entry form global icons inner item items left link links list main page post primary right secondary section site top wrap wrapper".split())
#: Elements that only format: their text counts as their parent's.
INLINE = frozenset("abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of prose, which belong to the article that they stand in.
PROSE = HEADS | frozenset("p blockquote pre figure figcaption ul ol dl table".split())
_CLOSES = {t: frozenset(("p",)) for t in BLOCKS} | {"li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
#: What may stand in a head without ending it.
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_WALL = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())


class Node:
    __slots__ = ("tag", "up", "kids", "deep", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "out")

    def __init__(self, tag: str, up: Node | None, out: bool = False):
        self.tag, self.up, self.kids, self.out, self.deep = tag, up, [], out, up.deep + 1 if up else 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self


def _noisy(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED or tag in ("header", "label") and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attrs):
        return True
    if tag in HEADS:  # ids of headings are made of their words
        return False
    for m in _NAMED.finditer(attrs):
        if in_article and tag in PROSE and m[1].lower() == "id":
            continue
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_SPLIT.split(token)) - {""}
            noise = words & NOISE if in_article else words & (NOISE | {"header"})
            if noise and words - noise <= PLAIN:
                return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text before a tag, the tag's name, whether it is an end tag, and its attributes; at last a text with an empty name."""
    at = start = 0
    quoting, unclosed = True, set()
    last = {c: page.rfind(c) for c in ">\"'"}
    while (j := page.find("<", at)) >= 0:
        if page.startswith("<!--", j):
            yield page[start:j], "", False, ""
            at = page.find("-->", j + 2) + 3
            if at == 2:
                return
            start = at
            continue
        if j > last[">"]:
            break
        m = _NAME.match(page, j + 1)
        if m is None:
            at = j + 1
            if page[at : at + 1] in ("!", "?", "/"):
                yield page[start:j], "", False, ""
                at = start = page.find(">", j) + 1
            continue
        end, look = -1, m.end()
        while quoting and (s := _STOP.search(page, look)):
            if s[0] == ">":
                end = s.start()
                break
            look = page.find(s[0], s.end()) + 1 if s.start() < last[s[0]] else s.end()
        if end < 0:  # quotes hide every end of the tag: from here on they don't count
            quoting, end = False, page.find(">", m.end())
        name, attrs = m[2].lower(), page[m.end() : end]
        closed = None
        if not m[1] and name in _CLOSED and name not in unclosed and not (name == "svg" and attrs.endswith("/")):
            closed = _CLOSED[name].search(page, end + 1)
            if closed is None:
                if name in _RAW:
                    yield page[start:j], "", False, ""
                    return
                unclosed.add(name)
        if closed is None:
            yield page[start:j], name, bool(m[1]), attrs
            at = start = end + 1
        else:
            yield page[start:j], "", False, ""
            after = page.find(">", closed.end())
            at = start = after + 1 if after >= 0 else len(page)
    yield page[start:], "", False, ""


def tree(page: str) -> Node:
    """The page's elements and texts, without the left-out ones."""
    root = Node("html", None)
    at, articles, outs = root, 0, 0
    #: Elements that end tags and implied ends don't reach beyond, each with the open ones in it by name.
    walls: list[tuple[Node, dict[str, list[Node]]]] = [(root, {})]
    open_walls: Counter[str] = Counter()

    def enter(node: Node) -> None:
        nonlocal at, articles, outs
        at.kids.append(node)
        articles += node.tag in ("article", "main")
        outs += node.out
        if node.tag in _WALL:
            walls.append((node, {}))
            open_walls[node.tag] += 1
        else:
            walls[-1][1].setdefault(node.tag, []).append(node)
        at = node

    def close(node: Node) -> None:
        nonlocal at, articles, outs
        end = node.up
        while at is not end:
            articles -= at.tag in ("article", "main")
            outs -= at.out
            if at.tag in _WALL:
                walls.pop()
                open_walls[at.tag] -= 1
            else:
                walls[-1][1][at.tag].pop()
            at = at.up

    for text, tag, ends, attrs in tokens(page):
        if text:
            at.kids.append(html.unescape(text))
        if not tag:
            continue
        if ends:
            node = None
            if tag not in _WALL:
                found = walls[-1][1].get(tag)
                node = found[-1] if found else None
            elif open_walls[tag]:
                node = next(w for w, _ in reversed(walls) if w.tag == tag)
            if node is not None:
                close(node)
            elif tag in BLOCKS:
                at.kids.append(Node("hr", at))
            continue
        if at.tag == "head" and tag not in _IN_HEAD:
            close(at)
        if closes := _CLOSES.get(tag):
            last_closed = None
            for wall, inside in reversed(walls):
                found = [inside[t][0] for t in closes if inside.get(t)]
                last_closed = min(found, key=lambda n: n.deep) if found else last_closed
                if wall.tag not in closes or wall.up is None:
                    break
                last_closed = wall
            if last_closed is not None:
                close(last_closed)
        if tag == "br":
            at.kids.append(" ")
        elif tag == "hr":
            at.kids.append(Node(tag, at))
        elif tag in VOID:
            pass
        elif (out := _noisy(tag, attrs, articles > 0)) and attrs.endswith("/"):
            pass
        elif out or tag not in ("html", "body") and (tag not in INLINE or outs and not attrs.endswith("/")):
            # formatting tags in a left-out element are kept until _prune, so that its end is found
            enter(Node(tag, at, out))
    _prune(root)
    return root


def _prune(root: Node) -> None:
    """Takes the left-out elements away, but for those that hold the main text."""
    nodes = _order(root)
    if not any(n.out for n in nodes):
        return
    size, seen, holds = {}, {}, {}
    for n in reversed(nodes):
        kids = [k for k in n.kids if type(k) is Node]
        own = sum(len(" ".join(k.split())) for k in n.kids if type(k) is str)
        size[id(n)] = own + sum(size[id(k)] for k in kids)
        seen[id(n)] = 0 if n.out else own + sum(seen[id(k)] for k in kids)
        holds[id(n)] = {n.tag}.intersection(("article", "main")).union(*(holds[id(k)] for k in kids))
    shut, within, free = {}, {}, set()
    for n in nodes:
        shut[id(n)] = n.out or n.up is not None and shut[id(n.up)]
        within[id(n)] = n.up is not None and (n.up.tag in ("article", "main") or within[id(n.up)])
        if n.tag in ("article", "main") and not shut[id(n)] and seen[id(n)]:
            free.add(n.tag)
    for n in nodes:
        if n.out and n.tag != "head":
            most = 2 * size[id(n)] > size[id(root)] and (within[id(n)] or not free)
            if most or "main" in holds[id(n)] or "article" in holds[id(n)] and "article" not in free:
                n.out = False
                n.tag = "div" if n.tag == "header" else n.tag  # of a header only headings are taken
    for n in nodes:
        if n.tag in INLINE and not n.out:
            continue
        kids, todo = [], n.kids[::-1]
        while todo:
            k = todo.pop()
            if type(k) is Node and k.tag in INLINE and not k.out:
                todo += k.kids[::-1]
            elif type(k) is str or not k.out:
                kids.append(k)
                if type(k) is Node:
                    k.up = n
        n.kids = kids


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in node.kids if type(k) is Node]
    return out


def _weigh(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        for k in n.kids:
            if type(k) is str:
                n.chars += len(" ".join(k.split()))
            else:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    body = nodes[0]
    share = max(body.link_chars, 1) / max(body.chars, 1)
    for n in nodes:
        if n.chars:
            c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            base = math.log(c / max(c - n.link_chars, 1) * lc + share * c + math.e)
            n.density = c / t * math.log(max(c * t / (lc * lt), 1.0)) / math.log(base)
    for n in reversed(nodes):
        kids = [k for k in n.kids if type(k) is Node]
        n.total = sum(k.density for k in kids)
        n.best = max([n, *(k.best for k in kids)], key=lambda x: x.total)


def _links(n: Node) -> bool:
    return 2 * n.link_chars > n.chars


def content(root: Node) -> set[int]:
    """ids of the elements that belong to the main text."""
    nodes = _order(root)
    _weigh(nodes)
    core = n = root.best
    threshold = core.density
    while n.up is not None:
        n = n.up
        threshold = min(threshold, n.density)
    taken: set[int] = set()

    def take(node: Node) -> None:
        new = [node]
        while new:
            x = new.pop()
            taken.add(id(x))
            new += [k for k in x.kids if type(k) is Node]

    take(core)
    n = core
    inside = {id(x) for x in nodes if x.tag in ("article", "main")}
    for x in nodes:
        if x.up is not None and id(x.up) in inside:
            inside.add(id(x))
    while n.up is not None:  # what stands beside the core, and beside what holds it
        kids = [k for k in n.up.kids if type(k) is Node and k.chars]
        good = [k is n or not _links(k) and (k.tag in HEADS or k.tag in PROSE and id(n.up) in inside or k.density >= threshold or _headed(k)) for k in kids]
        if any(type(k) is str and k.strip() for k in n.up.kids):
            taken.add(id(n.up))
        if True in good:
            first, last = good.index(True), len(good) - good[::-1].index(True)
            for i, k in enumerate(kids):
                if k is not n and (good[i] or first < i < last and not _links(k)):
                    take(k)
        n = n.up
    return taken


def _headed(n: Node) -> bool:
    return any(type(k) is Node and k.tag in HEADS for k in n.kids)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    taken = content(root)
    blocks: list[list[str]] = [[]]

    todo: list[tuple] = [(root, False, False)]
    while todo:  # in page order
        node, inside, heads = todo.pop()
        if type(node) is str:
            if inside:
                blocks[-1].append(node)
            continue
        if node is None:
            blocks.append([])
            continue
        inside = id(node) in taken
        if heads and node.tag in HEADS:
            heads = False
        if node.tag == "header":
            heads = True
        block = node.tag in BLOCKS
        if block:
            blocks.append([])
            todo.append((None, False, False))
        for k in reversed(node.kids):
            todo.append((k, inside and not heads, heads))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE: dict[str, str] = {}
