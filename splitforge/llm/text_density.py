"""Main text of web pages by composite text density.

A small tolerant reader builds the element tree of a page (unclosed and stray tags
included).  Elements that seldom hold main text go first: forms, menus, headers,
footers, asides, hidden parts, and parts with a class, id or role that as a whole
names an advert, notice, sidebar or reader comments.  Such a part stays if it holds
an ``article`` or ``main``, or most of the body's characters outside links, unless
the page has an ``article`` or ``main`` with text apart from it.  Scripts, styles,
controls and the head always go.  Every remaining element then
gets its composite text density: characters per tag, adjusted by its share of link
characters and link tags against the body's; densities of the children are
summed.  Phrase elements (``b``, ``span``, ``br``) are text of their parent and no tags.
The element with the greatest sum is the core, the least density on the
path from it to the body is the threshold, and from the body down each element at
or over the threshold gives the element of greatest sum below it; the walk then goes
on into its children.  As in the method, a part whose density is below the
threshold goes: on a page without any link that may be a short part beside a long one.
Headlines are short by nature: a heading before the core whose parent holds the core stays,
unless links make up half of it or more.  So does, within an ``article`` or ``main``, a
part named for related or recommended reading: only as a list of links is it clutter.

The logarithm's base in the density is shifted by e - 1, so that pages without
links have a defined density.

Nulls: a null html is an empty page and gives an empty text.  Pages without any
markup are one block.  Of elements with equal sums the first and outermost is the core.
Time grows with a page's length, also for very long or deeply nested pages and tags
that are never closed.  Repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import html as H
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>?""", re.S)
_REST = re.compile(r"<[!?].*", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

# Fixed sets of HTML: void elements, block elements, and what an opening tag closes.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "body", "main", "blockquote"}

# Fixed word lists: elements that always go, elements and words of class, id and role that mark what is seldom main text,
# words that may stand beside those in a class, and all that a head can hold.
_NEVER = set("script style noscript template head button select textarea input iframe object svg canvas title".split())
_DROP = set("nav footer aside form menu dialog".split())
_DROP_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs toolbar comment comments commentlist disqus respond replies related recommended share sharing social pagination pager skip complementary search".split()
)
_IF_LINKS = set("related recommended".split())
_DROP_OUTSIDE = set("header footer masthead contentinfo copyright".split())
_BESIDE = set("area bar block bottom box container left list primary right secondary section site top widget".split())
#: Phrase elements: their text counts as their parent's, and they are no tags to the density.
_PHRASE = set("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
_IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
_MAIN = ("article", "main")


class _Tree:
    """Elements in page order: parent, tag, clutter (1 by its marks, 2 always, 3 if it is mostly links), dropped; pieces of text by element, None where a block starts or ends."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.clutter, self.last = [-1], [""], [0], [0]
        self.pieces: list[tuple[int, str] | None] = []
        self.inside, self.open = [False], Counter()
        stack, pos, last = [0], 0, page.rfind(">")
        while pos < len(page):
            m = _TAG.search(page, pos) if pos <= last else _REST.search(page, pos)  # without a > to come only a comment can begin
            if text := page[pos : m.start() if m else len(page)]:
                if self.tag[stack[-1]] == "head" and text.strip():
                    self._close(stack, "head")
                self.pieces.append((stack[-1], H.unescape(text)))
            if not m:
                break
            pos = m.end()
            name = m.re is _TAG and (m[2] or m[5])
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(stack, name)
            else:
                self._open(stack, name, m[3] or m[6] or "")
                if name in _RAW and not (m[3] or "").endswith("/"):
                    end = _RAW[name].search(page, pos)
                    pos = end.end() if end else len(page)
                    self._close(stack, name)
        for i in range(len(self.parent) - 1, 0, -1):
            self.last[i] = max(self.last[i], i)
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])
        if 3 in self.clutter:
            self._settle()
        self.dropped = self._dropped()

    def _cut(self, stack: list[int], k: int) -> None:
        self.open.subtract(self.tag[n] for n in stack[k:])
        del stack[k:]

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1) if self.open[name] else ():
            if self.tag[stack[k]] == name:
                self._cut(stack, k)
                if name in _BLOCK:
                    self.pieces.append(None)
                return

    def _open(self, stack: list[int], name: str, attrs: str) -> None:
        if name == "body" or self.tag[stack[-1]] == "head" and name not in _IN_HEAD:
            self._close(stack, "head")
        closes = _CLOSES.get(name, ())
        if name in _BLOCK:
            closes = {"p", *closes}
        for k in range(len(stack) - 1, 0, -1) if any(self.open[x] for x in closes) else ():
            tag = self.tag[stack[k]]
            if tag in closes:
                self._cut(stack, k)
                break
            if tag in _SCOPE:
                break
        if name in _BLOCK:
            self.pieces.append(None)
        node = len(self.parent)
        up = stack[-1]
        self.parent.append(up)
        self.tag.append(name)
        self.inside.append(self.inside[up] or name in _MAIN)
        self.clutter.append(2 if name in _NEVER else self._mark(self.inside[up], name, attrs))
        self.last.append(node)
        if name == "br":
            self.pieces.append((up, " "))
        if name not in _VOID:
            stack.append(node)
            self.open[name] += 1

    @staticmethod
    def _mark(inside: bool, name: str, attrs: str) -> int:
        if name in _DROP or name == "header" and not inside:
            return 1
        if name in ("html", "body", "article", "main") or not attrs.strip():
            return 0
        mark, words = 0, _DROP_WORDS if inside else _DROP_WORDS | _DROP_OUTSIDE
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                for token in value.split():
                    parts = set(re.findall(r"[a-z]+", token))
                    if parts & words and parts <= (words | _BESIDE if key == "class" else words):
                        if not inside or parts & words - _IF_LINKS:
                            return 1
                        mark = 3
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 1
        return mark

    def _settle(self) -> None:
        """Parts with mark 3 are clutter if links make up half of their characters or more."""
        n = len(self.parent)
        gone, link, excess = [False] * n, [False] * n, [0] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]] or self.clutter[i] in (1, 2)
            link[i] = link[self.parent[i]] or self.tag[i] == "a"
        for piece in self.pieces:
            if piece and not gone[piece[0]]:
                excess[piece[0]] += len("".join(piece[1].split())) * (-1 if link[piece[0]] else 1)
        for i in range(n - 1, 0, -1):
            excess[self.parent[i]] += excess[i]
            if self.clutter[i] == 3:
                self.clutter[i] = int(excess[i] <= 0)

    def _dropped(self) -> list[bool]:
        """Whether an element goes: clutter and all below it, but for clutter that stands for the main text."""
        n = len(self.parent)
        if 1 not in self.clutter:
            dropped = [False] * n
            for i in range(1, n):
                dropped[i] = dropped[self.parent[i]] or self.clutter[i] > 0
            return dropped
        gone, link, chars, holds = [False] * n, [False] * n, [0] * n, [0] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]] or self.clutter[i] == 2
            link[i] = link[self.parent[i]] or self.tag[i] == "a"
        for piece in self.pieces:
            if piece and not gone[piece[0]] and not link[piece[0]]:
                chars[piece[0]] += len("".join(piece[1].split()))
        own = chars[:]
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            holds[self.parent[i]] += holds[i] + (self.tag[i] in _MAIN and chars[i] > 0)
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        whole = chars[body] or chars[0]

        def elsewhere(stays: list[bool]) -> list[bool]:
            """Whether an article or main that is not around an element has text outside clutter."""
            under, left, around = [False] * n, own[:], [0] * n
            for i in range(1, n):
                under[i] = under[self.parent[i]] or self.clutter[i] > 0 and not stays[i]
                left[i] *= not under[i]
            for i in range(n - 1, 0, -1):
                left[self.parent[i]] += left[i]
            free = [self.tag[i] in _MAIN and left[i] > 0 for i in range(n)]
            total = sum(free)
            for i in range(1, n):
                around[i] = around[self.parent[i]] + free[i]
            return [k < total for k in around]

        other = elsewhere([False] * n)
        stays = [self.clutter[i] == 1 and holds[i] > 0 and not other[i] for i in range(n)]
        other = elsewhere(stays)
        dropped = [False] * n
        for i in range(1, n):
            keep = stays[i] or self.clutter[i] == 1 and 2 * chars[i] > whole and not other[i]
            dropped[i] = dropped[self.parent[i]] or self.clutter[i] > 0 and not keep
        return dropped


def main_text(page: str) -> str:
    """Blocks of the main text, one a line."""
    tree = _Tree(page)
    n = len(tree.parent)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for piece in tree.pieces:
        if piece and not tree.dropped[piece[0]]:
            size = len("".join(piece[1].split()))
            chars[piece[0]] += size
            links[piece[0]] += size * in_link[piece[0]]
    for i in range(n - 1, 0, -1):
        if tree.dropped[i]:
            continue
        up = tree.parent[i]
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i] + (tree.tag[i] not in _PHRASE)
        link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    share = links[body] / chars[body]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if tree.dropped[i] or not chars[i]:
            continue
        if i and tree.tag[i] in _PHRASE:
            total[tree.parent[i]] += total[i]
            continue
        c, t, lc, lt = chars[i], max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
        base = math.log(c / max(c - links[i], 1) * links[i] + share * c + math.e) + math.e - 1
        density[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base)
        if i:
            total[tree.parent[i]] += density[i]
        total[i] = total[i] or density[i]

    # The element of greatest sum in each subtree (the first of equals).
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not tree.dropped[i] and (best[up] != up and total[best[i]] >= total[best[up]] or total[best[i]] > total[best[up]]):
            best[up] = best[i]

    core = best[body]
    threshold, k = density[core], core
    while k != body and k > 0:
        k = tree.parent[k]
        if tree.tag[k] not in _PHRASE:
            threshold = min(threshold, density[k])
    marked, todo = [False] * n, [body]
    while todo:
        node = todo.pop()
        if marked[node] or tree.dropped[node] or not chars[node]:
            continue
        if density[node] < threshold and tree.tag[node] not in _PHRASE:
            continue
        top = best[node]
        if not marked[top]:
            marked[top : tree.last[top] + 1] = [True] * (tree.last[top] + 1 - top)
        k = node + 1
        while k <= tree.last[node]:
            todo.append(k)
            k = tree.last[k] + 1
    around = set()
    k = tree.parent[core]
    while k >= 0:
        around.add(k)
        k = tree.parent[k]
    for i in range(1, core):
        if tree.tag[i] in _HEADINGS and tree.parent[i] in around and not tree.dropped[i] and 2 * links[i] < chars[i]:
            marked[i : tree.last[i] + 1] = [True] * (tree.last[i] + 1 - i)
    blocks, current = [], []
    for piece in [*tree.pieces, None]:
        if piece is None:
            if line := " ".join("".join(current).split()):
                blocks.append(line)
            current = []
        elif marked[piece[0]] and not tree.dropped[piece[0]]:
            current.append(piece[1])
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = pa.array([main_text(h.as_py() or "") for h in part.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, pages.select("page_id", "url", F.col("html").alias("text")).schema)


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
