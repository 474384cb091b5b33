"""Main text of web pages by composite text density.

A page becomes a tree; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments leave it
by their element or role, or where a class name or id says so: as a whole, or by a word that stands for comments, notices or
adverts alone. Names and the elements form, aside and header are evidence only: html, body, main and article never leave by name,
nor does a node that holds most of the page's text or a main element; comments may be most of it, and leave if enough text stands
outside of them; a form, or an aside within the article, leaves where it is dense in controls or links. Every node then gets its composite text density: characters per tag, weighted down by the
share of link characters and link tags. The node with the largest sum of its children's densities is content; the smallest
density on its path to the body is the threshold at which further subtrees are content as well. The text is that of the
smallest subtree holding all content, or of the ``article`` or ``main`` element around it.

Defined results: null or empty html, or a page without content, gives the empty text; null ``page_id`` or ``url`` stays null;
repeated rows give equal rows; markup that never ends is read as text, and so is the rest of its page; of nodes with equal density
sums the first in page order is content. Pages are handled one by one, in full, in time that grows with their length, whatever
their markup; a very long page is one row of one task.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What may follow the name in a tag; a quote opens a value only after "=", and only if it is closed.
REST = re.compile(r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?|=)*+""")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
WORD = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An open element of the first kind ends where one of the second kind begins.
ENDED_BY = {
    "p": BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"},
}
#: Implied ends do not reach beyond these.
WALLS = frozenset("article aside blockquote body div footer header html main nav ol section table td th ul form".split())
NOT_CONTENT = frozenset(
    "script style noscript template iframe object embed svg canvas head title nav menu footer select option textarea input dialog".split()
)
MARKED = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "header masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay comment comments commentlist disqus "
    "replies reply share sharing social related widget login signup search contentinfo complementary".split()
)
#: Words that may stand beside marked ones in a name of furniture.
BESIDE = frozenset("site main top bottom left right primary secondary global box bar area section list links posts buttons icons form wrapper container inner".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply responses".split())
#: Words that mark furniture whatever stands beside them, unless a word before them denies it or names a topic.
TELLING = COMMENTS - {"reply"} | frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts sponsor sponsored cookie cookies gdpr consent newsletter breadcrumb breadcrumbs navbar".split()
)
DENIED = frozenset("no not has is with without tag category topic hide".split())
ENOUGH = 80  # characters outside of comments, and outside links, that make a page more than its comments
KEPT = frozenset("html body main article".split())
CONTROLS = frozenset("input select textarea button".split())
CHARS_PER_CONTROL = 100  # text outside links that a form or an inner aside must hold for each control and link


CLOSES: dict[str, list[str]] = {}  # open elements that end where this one begins
for _open, _enders in ENDED_BY.items():
    for _ender in _enders:
        CLOSES.setdefault(_ender, []).append(_open)


def furniture(name: str) -> frozenset[str]:
    """The marked words of a class name, id or role, if it holds no other words than those of furniture or a telling one."""
    words = WORD.findall(name.lower())
    found = frozenset(words)
    if found <= MARKED | BESIDE | COMMENTS:
        return found & (MARKED | COMMENTS)
    return frozenset() if words[0] in DENIED else found & TELLING


class Tree:
    """Nodes in page order: parent, element, whether left out, and the text pieces that stand directly in them."""

    def __init__(self, page: str):
        self.tag, self.parent, self.out, self.link, self.inner = ["html"], [-1], [False], [False], [False]
        self.doubt: dict[int, str] = {}  # nodes that may be furniture: "name", "comments" or "dense"
        self.controls: list[int] = []
        self.pieces: list[tuple[int, str]] = []  # node (or -1 - node: a break by a block border), text
        self.stack, self.places, self.walls = [0], {}, [0]  # open nodes, and where those of an element and the walls stand among them
        self._read(page)
        if self.doubt:
            self._settle()

    def _read(self, page: str) -> None:
        begin = scan = 0

        def text(upto: int) -> None:
            if upto > begin and not self.out[self.stack[-1]]:
                self.pieces.append((self.stack[-1], page[begin:upto]))

        while (lt := page.find("<", scan)) >= 0:
            if page.startswith("<!--", lt):
                text(lt)
                end = page.find("-->", lt + 4)
                begin = scan = len(page) if end < 0 else end + 3
                continue
            name = TAG.match(page, lt)
            if not name and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
                scan = lt + 1
                continue
            rest = REST.match(page, name.end()) if name else None
            end = rest.end() if rest else page.find(">", lt)
            if end < 0 or end >= len(page) or page[end] != ">":
                break  # never ends
            text(lt)
            begin = scan = end + 1
            if name:
                begin = scan = self._tag(page, name[2].lower(), bool(name[1]), page[name.end() : end], end + 1)
        text(len(page))

    def _tag(self, page: str, tag: str, closes: bool, attributes: str, at: int) -> int:
        """Takes a tag that ends at ``at``; returns where to go on."""
        if closes:
            self._close(tag)
            return at
        if tag in ("html", "body") and tag in (self.tag[n] for n in self.stack[1:2]):
            return at
        self._imply(tag)
        found, last = {}, 0
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            last = m.end()
        node = self._open(self.stack[-1], tag, found)
        if tag in BLOCKS or tag == "br":
            self.pieces.append((-1 - node, " " if tag == "br" else "\n"))
        if tag in RAW:
            end = RAW[tag].search(page, at)
            upto = end.start() if end else len(page)
            if tag == "xmp" and not self.out[node]:
                self.pieces += [(-1 - node, "\n"), (node, html.escape(page[at:upto]))]
            at = upto
        if tag not in VOID and "/" not in attributes[last:]:
            if tag in WALLS:
                self.walls.append(len(self.stack))
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)
        return at

    def _open(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        out = self.out[parent] or tag in NOT_CONTENT
        node, doubt = len(self.tag), ""
        if tag in CONTROLS and attributes.get("type", "").strip().lower() != "hidden":
            self.controls.append(node)
        if not out and tag == "button":
            out = self.tag[parent] not in ("h1", "h2", "h3", "h4", "h5", "h6", "summary")
        if not out and tag == "form":
            doubt = "dense"
        if not out and tag in ("header", "aside"):
            doubt = "name" if not self.inner[parent] else "dense" if tag == "aside" else ""
        if not out and attributes and tag not in KEPT:
            for name in " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split():
                found = furniture(name) if WORD.search(name.lower()) else ()
                if found and doubt != "comments":
                    doubt = "comments" if found & COMMENTS else "name"
        if doubt:
            self.doubt[node] = doubt
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(out)
        self.link.append(self.link[parent] or tag == "a")
        self.inner.append(self.inner[parent] or tag in ("article", "main"))
        return node

    def _pop(self, place: int) -> None:
        """Ends the open nodes from ``place`` on."""
        for node in self.stack[place:]:
            self.places[self.tag[node]].pop()
        del self.stack[place:]
        while self.walls[-1] >= place:
            self.walls.pop()

    def _imply(self, tag: str) -> None:
        place = max((self.places[t][-1] for t in CLOSES.get(tag, ()) if self.places.get(t)), default=-1)
        if place >= self.walls[-1] and place > 0:
            self._pop(place)

    def _close(self, tag: str) -> None:
        if self.places.get(tag):
            node = self.stack[self.places[tag][-1]]
            self._pop(self.places[tag][-1])
            if tag in BLOCKS:
                self.pieces.append((-1 - self.parent[node], "\n"))

    def _settle(self) -> None:
        """Doubtful nodes leave with their subtrees unless the text of the page stands in them."""
        n = len(self.tag)
        chars, held, load, mains = [0] * n, [0] * n, [0] * n, [0] * n  # text outside links, that of articles, controls and links, main elements
        article, commented, rest = [False] * n, [False] * n, 0
        for i in range(n):
            article[i] = self.tag[i] in ("article", "main") or i > 0 and article[self.parent[i]]
            commented[i] = self.doubt.get(i) == "comments" or i > 0 and commented[self.parent[i]]
            load[i] = int(self.tag[i] == "a" and not self.out[i])
            mains[i] = int(self.tag[i] == "main" and not self.out[i])
        for i in self.controls:
            load[i] = 1
        for node, text in self.pieces:
            if node >= 0 and not self.link[node]:
                k = len(" ".join(text.split()))
                chars[node] += k
                held[node] += k if article[node] else 0
                rest += k if not commented[node] else 0
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p], held[p], load[p], mains[p] = chars[p] + chars[i], held[p] + held[i], load[p] + load[i], mains[p] + mains[i]
        for i in range(1, n):
            kind = self.doubt.get(i)
            if kind and not self.out[i]:
                elsewhere = held[0] > 0 and not held[i]  # an article or main element with text stands outside
                stays = mains[i] > 0 or 2 * chars[i] > chars[0] and not elsewhere
                if kind == "dense":
                    stays = stays or chars[i] >= CHARS_PER_CONTROL * (load[i] + 1)
                if kind == "comments":
                    stays = stays and held[0] == held[i] and rest < ENOUGH
                self.out[i] = not stays
            self.out[i] = self.out[i] or self.out[self.parent[i]]
        self.pieces = [(node, text) for node, text in self.pieces if node < 0 or not self.out[node]]


def content_node(tree: Tree) -> int:
    """The smallest subtree that holds all content; -1 without text."""
    n = len(tree.tag)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.pieces:
        if node >= 0:
            k = len(" ".join(text.split()))
            chars[node] += k
            if tree.link[node]:
                link_chars[node] += k
    for i in range(n - 1, 0, -1):
        if tree.out[i]:
            continue
        p = tree.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    body = next((i for i in range(n) if tree.tag[i] == "body" and not tree.out[i]), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return -1
    share = link_chars[body] / chars[body]

    def density(i: int) -> float:
        c, lc = chars[i], link_chars[i]
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(tags[i], 1) * math.log(max(c / max(lc, 1) * max(tags[i], 1) / max(link_tags[i], 1), 1.0)) / math.log(max(base, 1 + 1e-9))

    dense, total = [0.0] * n, [0.0] * n
    inside = [False] * n
    inside[body] = True
    for i in range(body, n):
        if i > body:
            inside[i] = not tree.out[i] and tree.parent[i] >= 0 and inside[tree.parent[i]]
        if inside[i]:
            dense[i] = density(i)
            if i > body:
                total[tree.parent[i]] += dense[i]
    top = max((i for i in range(n) if inside[i]), key=lambda i: (total[i], -i))
    path, i = [], top
    while i != body:
        path.append(i)
        i = tree.parent[i]
    threshold = min([dense[body], *(dense[i] for i in path)])
    # further content: subtrees that reach the threshold; each enters by its own node of maximum sum
    best = list(range(n))
    for i in range(n - 1, body, -1):
        p = tree.parent[i]
        if inside[i] and total[best[i]] > total[best[p]]:
            best[p] = best[i]
    marked, reach = {top}, [False] * n
    reach[body] = dense[body] >= threshold
    covered = [False] * n
    for i in range(body, n):
        if not inside[i]:
            continue
        if i > body:
            covered[i] = covered[tree.parent[i]] or tree.parent[i] in marked
            reach[i] = reach[tree.parent[i]] and dense[i] >= threshold
        if reach[i] and not covered[i] and chars[i]:
            marked.add(best[i])
    # the smallest subtree that holds all marked nodes
    count = [0] * n
    for i in marked:
        count[i] += 1
    for i in range(n - 1, body, -1):
        if inside[i]:
            count[tree.parent[i]] += count[i]
    node = max(i for i in range(n) if inside[i] and count[i] == len(marked))
    whole, i = node, node
    while i >= 0:
        if tree.tag[i] in ("article", "main"):
            whole = i
        i = tree.parent[i]
    return whole


def main_text(page: str | None) -> str:
    """The article of one page: a line per block."""
    if not page:
        return ""
    tree = Tree(page)
    root = content_node(tree)
    if root < 0:
        return ""
    n = len(tree.tag)
    kept = [False] * n
    kept[root] = True
    for i in range(root + 1, n):
        kept[i] = not tree.out[i] and kept[tree.parent[i]]
    blocks, open_block = [], []
    for node, text in tree.pieces:
        if node < 0:
            if text == "\n":
                blocks.append(open_block)
                open_block = []
            elif kept[-1 - node]:
                open_block.append(text)
        elif kept[node]:
            open_block.append(text)
    blocks.append(open_block)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
