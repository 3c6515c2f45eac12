"""Main text of HTML pages by composite text density.

Each DOM node has its characters C, tags T, link characters LC and link tags LT; its density is

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LCb / Cb * C + e),

with 1 for a zero denominator and b the body. A node's sum adds its children's densities. The node of the largest sum
is the main subtree and is taken whole. The least density on its path to the body (the body not counted) is the threshold: beside
the path, a container joins if its density reaches the threshold, and a paragraph, heading, list or table if links don't
make up most of it. Within an ``article`` on the path all of it joins.

What is no text of an article is left out first: scripts, styles and the like, and ``nav``, ``footer``, ``aside``, ``header`` (outside
an article) and form controls by element. Forms, roles, hidden elements and names are evidence only: a class or id counts if
the whole token, or every part of it between hyphens, is a name of furniture (``with-sidebar`` is none), and even
then the node stays if little other text is left on the page: less than ``STRONG`` times its own, or ``WEAK`` times for
names that articles use too, such as ``alert``. So no name takes away the larger part of a page.

A null or empty page gives an empty text. Unclosed and misnested tags are mended as browsers do in the common cases.
Pages are parsed whole, with explicit stacks, so depth has no limit. Repeated rows give equal rows; extra columns
don't matter.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math textarea select option title noframes noembed xmp canvas audio video head".split())
_CLOSE = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp")}
_BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
_ENDS_P = _BLOCK - frozenset("br html body td th tr tbody thead tfoot dd dt li legend summary".split()) | {"li", "dd", "dt"}
_SIBLING = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",))}
_SIBLING = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _SIBLING.items()}
_DROP = frozenset("nav aside footer button dialog menu label input datalist".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole names of furniture, of which articles use the second kind too; and what else compound names are made of.
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot adbox adbanner sponsor sponsored cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar comment comments commentlist disqus respond reply replies share sharing social newsletter subscribe subscription signup login popup modal overlay paywall pagination pager".split())
_SOFT = frozenset("notice notices notification notifications alert alerts banner banners promo promoted promotion header toolbar related recommended recommendations widget widgets hidden skip".split())
_PARTS = _NAMES | _SOFT | frozenset("site page main global primary secondary left right top bottom inner outer upper lower list area section wrapper wrap box container bar block item items slot thread form user reader box posts links buttons link button icons menu policy header warning message side".split())
_TOKEN_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_KEEP = frozenset("html body main article".split())
#: A furniture node stays if the other text is less than so many times its own.
STRONG, WEAK = 0.1, 2.0
NONE, ALWAYS, NAMED, SOFT = range(4)
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
_CONTAINER = _BLOCK - _TEXT


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """Why a node may be no part of an article."""
    if name in _DROP or name == "header" and not in_article:
        return ALWAYS
    if name in ("form", "fieldset"):
        return NAMED
    if name in _KEEP or not attrs:
        return NONE
    found = NONE
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.strip() in _ROLES or key == "style" and _HIDDEN.search(value):
            return NAMED
        if key in ("class", "id"):
            for token in value.split():
                parts = _TOKEN_PARTS.findall(token)
                if parts and _PARTS.issuperset(parts):
                    if not _NAMES.isdisjoint(parts):
                        return NAMED
                    if not _SOFT.isdisjoint(parts):
                        found = SOFT
    return found


class Page:
    """A page's nodes in page order: ``parent``, ``name``, ``links`` (in a link), ``why`` (furniture) and its text pieces as (node, text); (-1, " ") parts blocks."""

    def __init__(self, source: str):
        self.parent, self.name, self.why, self.links = [-1], ["#"], [NONE], [False]
        self.open: dict[str, int] = {}
        self.pieces: list[tuple[int, str]] = []
        stack, article = [0], [False]
        at, n = 0, len(source)
        unescape, pieces, names = _html.unescape, self.pieces, self.name
        while at < n:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else n
            if stop > at:
                text = source[at:stop]
                pieces.append((stack[-1], unescape(text) if "&" in text else text))
            if not m:
                break
            at = m.end()
            if (start := m["start"]) is not None:
                tag = start.lower()
                if tag in _ENDS_P:
                    self._end("p", stack, article, frozenset(("table", "td", "th", "button", "body", "#")))
                if tag in _SIBLING:
                    closed, fence = _SIBLING[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if names[stack[k]] in fence:
                            break
                        if names[stack[k]] in closed:
                            self._cut(stack, article, k)
                            if tag not in ("tr", "tbody", "thead", "tfoot"):
                                break
                if tag in _BLOCK:
                    pieces.append((-1, " "))
                if tag == "br":
                    self._add(stack[-1], tag, NONE, self.links[stack[-1]])
                    continue
                top = stack[-1]
                node = self._add(top, tag, _furniture(tag, m["attrs"], article[-1]), self.links[top] or tag == "a")
                if tag in _CLOSE:
                    end = _CLOSE[tag].search(source, at)
                    at = end.end() if end else n
                elif tag not in _VOID and not m["attrs"].endswith("/") or tag in _BLOCK and tag not in _VOID:
                    stack.append(node)
                    self.open[tag] = self.open.get(tag, 0) + 1
                    article.append(article[-1] or tag in ("article", "main"))
            elif (end := m["end"]) is not None:
                tag = end.lower()
                if tag in _BLOCK:
                    pieces.append((-1, " "))
                    if tag not in ("body", "html"):  # what follows them still belongs to the body
                        self._end(tag, stack, article, frozenset(("table",)) if tag != "table" else frozenset())
                else:
                    self._end(tag, stack, article, _BLOCK)
            elif m["cdata"]:
                pieces.append((stack[-1], m["cdata"]))

    def _add(self, parent: int, name: str, why: int, link: bool) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.why.append(why)
        self.links.append(link)
        return len(self.parent) - 1

    def _cut(self, stack: list[int], article: list[bool], k: int) -> None:
        for node in stack[k:]:
            self.open[self.name[node]] -= 1
        del stack[k:], article[k:]

    def _end(self, tag: str, stack: list[int], article: list[bool], fence: frozenset[str]) -> None:
        if not self.open.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            name = self.name[stack[k]]
            if name == tag:
                self._cut(stack, article, k)
                return
            if name in fence:
                return

    def text(self, kept: list[bool]) -> str:
        """Text of the kept nodes, in page order."""
        return " ".join("".join(text for node, text in self.pieces if node < 0 or kept[node]).split())

    def shown(self) -> list[bool]:
        """Nodes in no script, style or the like."""
        out = [True] * len(self.parent)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] and self.name[i] not in _RAW
        return out

    def furnished(self) -> list[bool]:
        """Nodes that are no furniture."""
        n = len(self.parent)
        why, parent, shown = self.why, self.parent, self.shown()
        own = [0] * n
        for node, text in self.pieces:
            if node >= 0 and shown[node] and not self.links[node]:
                own[node] += len(text.strip())
        over = [0] * n  # the nearest furniture at or above
        for i in range(1, n):
            over[i] = i if why[i] else over[parent[i]]
            if over[i] != i:
                own[over[i]] += own[i]
        # the largest first: what stays counts for what holds it, or for the page
        heap = [(-own[i], i) for i in range(1, n) if why[i] > ALWAYS and own[i]]
        heapify(heap)
        stays = set()
        while heap:
            size, i = heappop(heap)
            if -size != own[i] or i in stays:
                continue
            if own[0] < (STRONG if why[i] == NAMED else WEAK) * own[i]:
                stays.add(i)
                up = over[parent[i]]
                while up in stays:
                    up = over[parent[up]]
                own[up] += own[i]
                if up and why[up] > ALWAYS:
                    heappush(heap, (-own[up], up))
        out = [True] * n
        for i in range(1, n):
            out[i] = out[parent[i]] and shown[i] and (not why[i] or i in stays)
        return out

    def densities(self, kept: list[bool]) -> tuple[int, list[float], list[float], list[int], list[int]]:
        """Body, density and sum of each kept node, its characters and those in links."""
        n = len(self.parent)
        chars, linked, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.pieces:
            if node >= 0 and kept[node]:
                size = len(" ".join(text.split()))
                chars[node] += size
                if self.links[node]:
                    linked[node] += size
        for i in range(n - 1, 0, -1):
            if kept[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                linked[p] += linked[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.name[i] == "a")
        body = next((i for i in range(n) if self.name[i] == "body"), 0)
        share = linked[body] / (chars[body] or 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc, t, lt = chars[i], linked[i], tags[i] or 1, link_tags[i] or 1
            if c and kept[i]:
                x = c / (lc or 1) * (t / lt)
                base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
                density[i] = c / t * (math.log(x) / math.log(base) if x > 1 and base > 1.0000001 else 0.0 if x <= 1 else math.log(x))
            if i:
                total[self.parent[i]] += density[i]
        return body, density, total, chars, linked

    def main(self) -> str:
        n, parent, name = len(self.parent), self.parent, self.name
        kept = self.furnished()
        body, density, total, chars, linked = self.densities(kept)
        if not chars[0]:
            return ""
        inside = [False] * n
        inside[body] = True
        for i in range(body + 1, n):
            inside[i] = inside[parent[i]] and kept[i]
        best = max((i for i in range(n) if inside[i]), key=lambda i: (total[i], -i), default=body)
        path, threshold, up = {best}, density[best] if best != body else math.inf, best
        while up not in (body, 0):
            threshold = min(threshold, density[up])
            up = parent[up]
            path.add(up)
        article = [False] * n  # in an article of the path
        taken = [False] * n
        taken[best], taken[up] = True, True
        for i in range(up + 1, n):
            p = parent[i]
            if not inside[i] or not taken[p]:
                continue
            article[i] = article[p] or name[i] == "article" and i in path
            if i in path or p == best or p not in path or article[p]:
                taken[i] = True
            elif name[i] in _CONTAINER and name[i] != "br":
                taken[i] = chars[i] > 0 and density[i] >= threshold
            else:
                taken[i] = 2 * linked[i] <= chars[i]
        return self.text(taken)


def visible_text(page: str | None) -> str:
    """All text of a page but scripts, styles and the like."""
    if not page:
        return ""
    p = Page(page)
    return p.text(p.shown())


def main_text(page: str | None) -> str:
    return Page(page).main() if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
