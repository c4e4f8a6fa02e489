"""Main text of web pages by tree scoring.

A page becomes a tree of elements whose text is gathered in blocks (paragraphs, headings,
list items, cells). Every block passes points for its length and its commas, discounted
by the share of its text that stands in links, to its container, half of them to
the next ancestor and less to those above. The container with the most points, with the
siblings that score well or read like prose, is the article; what is marked as a menu, an
advert, a notice, a form or reader comments is left out of scores and text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from siftwell import runtime
from siftwell.llm import arrays as ar

#: Pages of a batch in Python, at most.
BATCH_ROWS = 500

# Fixed values of the markup language: elements without content, with unparsed content, inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose block counts for the element around them.
PARAGRAPHS = frozenset("p pre blockquote li dt dd td th caption figcaption summary address".split()) | HEADINGS
#: Elements that only arrange others: points go through them.
FRAMES = frozenset("ul ol dl table thead tbody tfoot tr figure details".split())
#: What an opening tag ends: (elements that it closes, elements at which the search for them stops).
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that are never part of an article.
LEFT_OUT = frozenset("head nav aside footer menu dialog button input select template svg canvas object audio video map fieldset legend datalist".split())
#: Words of class, id and role that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adunit banner banners sponsor sponsors sponsored "
    "promo promos promotion promotions promoted sidebar sidebars rail menu menus nav navbar navi navigation breadcrumb breadcrumbs masthead "
    "topbar footer cookie cookies consent gdpr notice notices alert popup popover modal overlay newsletter subscribe subscription signup "
    "login share sharing sharebar social related recommended recommendations widget widgets toolbar pager pagination search skip "
    "copyright disclaimer outbrain taboola contentinfo complementary alertdialog dialog menubar".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion guestbook".split())
HEADERS = frozenset(["header"])
#: Words of class and id that speak for a container.
GOOD = frozenset("article body content entry main post story text".split())
STRONG = 25.0
SHORT = 25
#: Elements above a block that its points reach.
REACH = 12
COMMA = re.compile("[,،、，]")
SENTENCE = re.compile(r"[.!?。…][\"'’”)\]]*$")

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
MARKS = re.compile(r"class|id\b|role|hidden|style", re.I)
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
WORD = re.compile(r"[a-z]+")


class Node:
    """An element. ``drop``: nothing in it counts; ``heads``: only headings in it count; ``flag``: marked as noise of a kind.

    ``in_*``: inside such an element, itself included; ``has_*``: such an element is inside.
    """

    __slots__ = ("tag", "up", "block", "drop", "heads", "flag", "good", "main", "in_main", "in_link", "in_heading", "has_title", "has_main", "has_article", "has_heading", "noise", "kept", "score", "chars", "linked", "links")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up, self.block = tag, up, tag not in INLINE
        self.drop = up.drop if up else False
        self.heads = up.heads if up else False
        self.flag, self.good, self.noise, self.kept = "", False, False, False
        self.main = tag in ("article", "main")
        self.in_main = self.main or up is not None and up.in_main
        self.in_link = tag == "a" or up is not None and up.in_link
        self.in_heading = tag in HEADINGS or up is not None and up.in_heading
        self.has_title = self.has_main = self.has_article = self.has_heading = False
        self.score, self.chars, self.linked, self.links = 0.0, 0, 0, 0


def _mark(node: Node, attributes: str) -> None:
    """What class, id, role and style say about an element."""
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            words.update(WORD.findall(CAMEL.sub(r"\1 \2", html.unescape(value)).lower()))
            if name == "role" and value.strip().lower() in ("main", "article"):
                node.main = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NOT_SHOWN.search(value):
            node.drop = True
    if node.tag in ("html", "body", "main"):
        return
    if words & COMMENTS:
        node.flag = "comments"
    elif node.main:
        return
    elif words & NOISE:
        node.flag = "noise"
    elif words & HEADERS:
        node.flag = "header"
    node.good = bool(words & GOOD)


class _Tree:
    """Elements and blocks of one page, in page order."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.nodes, self.open = [self.root], [self.root]
        self._n_open: Counter[str] = Counter()
        self.blocks: list[tuple[Node, str, int]] = []
        self._text: list[str] = []
        self._linked = 0

    def flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        if text:
            owner = next(n for n in reversed(self.open) if n.block)
            self.blocks.append((owner, text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def text(self, raw: str) -> None:
        now = self.open[-1]
        if now.drop or now.heads and not now.in_heading:
            return
        piece = html.unescape(raw) if "&" in raw else raw
        self._text.append(piece)
        if now.in_link:
            self._linked += len(" ".join(piece.split()))

    def pop_to(self, depth: int) -> None:
        if any(n.block for n in self.open[depth:]):
            self.flush()
        self._n_open.subtract(n.tag for n in self.open[depth:])
        del self.open[depth:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if not self.open[-1].drop:
                self._text.append(" ")
            return
        if tag in ("html", "body"):
            if MARKS.search(attributes):
                _mark(self.root, attributes)
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        block = tag not in INLINE
        if block:
            if tag in ENDS:
                closes, stops = ENDS[tag]
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i].tag in closes:
                        self.pop_to(i)
                        break
                    if self.open[i].tag in stops:
                        break
            # A paragraph or heading that was not closed ends here, with the inline elements open in it.
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "p" or tag in HEADINGS and self.open[i].tag in HEADINGS:
                    self.pop_to(i)
                    break
                if self.open[i].block:
                    break
        if block:
            self.flush()
        node = Node(tag, self.open[-1])
        if tag in LEFT_OUT:
            node.drop = True
        elif tag == "form":
            node.flag = "noise"
        elif tag == "header":
            if node.in_main:
                node.heads = True
            else:
                node.flag = "header"
        if attributes and MARKS.search(attributes):
            _mark(node, attributes)
        if not node.drop:
            node.links = int(tag == "a")
            node.has_title, node.has_heading = tag == "h1", tag in HEADINGS
            node.has_main, node.has_article = node.tag == "main", node.main and not node.flag
            node.in_main = node.in_main or node.main
        self.nodes.append(node)
        self.open.append(node)
        self._n_open[tag] += 1

    def end(self, tag: str) -> None:
        inline = tag in INLINE
        for i in range(len(self.open) - 1, 0, -1) if self._n_open[tag] else ():
            n = self.open[i]
            if n.tag == tag:
                self.pop_to(i)
                return
            if n.block and (inline or tag == "p"):  # it belongs to an element outside, or to none
                break
        if tag in ("p", "br") and not self.open[-1].drop:
            self._text.append(" ")


def parse(page: str) -> _Tree:
    tree, at, n = _Tree(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            tree.text(page[at:])
            break
        if lt > at:
            tree.text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (after.isascii() and after.isalpha() or after == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            tree.text("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        if m is None:  # the page ends inside a tag
            break
        at, tag = m.end(), m[1].lower()
        if after == "/":
            tree.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = -1 if close is None else page.find(">", close.end())
            at = n if end < 0 else end + 1
        else:
            tree.start(tag, m[2])
    tree.flush()
    return tree


def _points(text: str, linked: int) -> float:
    size = len(text)
    whole = size / 100 if size < SHORT else 1 + len(COMMA.findall(text)) + min(size / 100, 3)
    return whole * (1 - linked / size)


def _gather(nodes: list[Node], *names: str) -> None:
    """Add what the elements inside have, from the innermost out."""
    for node in reversed(nodes):
        if node.up is not None:
            for name in names:
                setattr(node.up, name, getattr(node.up, name) + getattr(node, name))


def _is_noise(node: Node) -> bool:
    """Marked, and without what shows that the mark means something else: a title, the article."""
    if node.flag == "comments":
        return not (node.has_title or node.has_main)
    if node.flag == "header":
        return not node.has_heading
    return node.flag != "" and not (node.has_title or node.has_main or node.has_article)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, one a line. Null, empty and article-free pages give an empty text."""
    tree = parse(page or "")
    _gather(tree.nodes, "has_title", "has_main", "has_article", "has_heading", "links")
    for node in tree.nodes:
        node.noise = node.up is not None and node.up.noise or _is_noise(node)
    blocks = [b for b in tree.blocks if not b[0].noise]
    if not blocks:
        return ""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        if owner.tag in HEADINGS:
            continue
        node, level, points = owner, 0, _points(text, linked)
        if owner.tag in PARAGRAPHS and owner.up is not None:
            node = owner.up
        for _ in range(REACH):
            if node.tag not in FRAMES and node.block or node.up is None:
                node.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            if node.up is None:
                break
            node = node.up
    _gather(tree.nodes, "chars", "linked")
    first: dict[int, str] = {}
    for owner, text, _ in blocks:
        first.setdefault(id(owner), text)

    def total(node: Node) -> float:
        base = STRONG * node.main + STRONG * (node.good and not node.main) + 5 * (node.tag == "div" and node.score >= 1)
        return (node.score + base) * (1 - node.linked / node.chars) if node.chars else 0.0

    able = [n for n in tree.nodes if n.block and n.chars and not n.noise and n.tag not in PARAGRAPHS and n.tag not in FRAMES]
    best = max(able, key=total)  # the first of equals: the outer one
    around = best
    while around is not None and not (around.main and around.tag != "main"):
        around = around.up
    if around is not None:  # an element that says that it is the article is taken whole
        best = around
    best.kept, least = True, max(10.0, 0.2 * total(best))
    before = True
    for node in tree.nodes if best.up is not None else ():
        if node is best:
            before = False
        elif node.up is best.up and node.chars and not node.noise:
            density = node.linked / node.chars
            if node.tag in HEADINGS:
                keep = density == 0 and (before and node.tag == "h1" or not before and best.tag != "article")
            elif node.tag in PARAGRAPHS:
                ends = density == 0 and bool(SENTENCE.search(first.get(id(node), "")))
                keep = not best.main and (ends or node.chars > 80 and density < 0.25)
            elif best.main:
                keep = node.main and total(node) >= least
            else:
                keep = node.tag not in FRAMES and total(node) >= least
            node.kept = keep
    # Lists and boxes that are nothing but links are menus.
    for node in tree.nodes:
        boxed = node.tag in FRAMES or node.tag in ("div", "section")
        node.noise = node.noise or boxed and not node.kept and node.links >= 3 and node.linked >= 0.8 * node.chars > 0
        if node.up is not None:
            node.noise, node.kept = node.noise or node.up.noise, node.kept or node.up.kept
    return "\n".join(text for owner, text, _ in blocks if owner.kept and not owner.noise)


def _texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(page) for page in pages.to_pylist()], pa.string())


def extract_pages(pages: DataFrame, into: str = "text") -> DataFrame:
    """All columns of ``pages``, with the main text of ``html`` in the column named by ``into``.

    Every row is a page of its own, also where page_id or url repeat or are null. A column that
    has the name ``into`` already is replaced. The memory of a task is that of a batch of
    pages; a very long page is read in time that grows with its length.
    """
    spark = pages.sparkSession
    runtime.ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows))
    spark.conf.set(rows, str(now if 0 < now < BATCH_ROWS else BATCH_ROWS))
    extract = arrow_udf(ar.tidy(_texts), "string").asNondeterministic()
    return pages.select(*[pages[c] for c in pages.columns if c != into], extract(F.coalesce(pages["html"], F.lit(""))).alias(into))
