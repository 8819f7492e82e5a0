"""Main text of HTML pages by composite text density.

Each element of the page's tree has characters, tags, and of these those in links. Its composite density is characters per tag
times a logarithm whose argument falls and whose base grows with the share of links; its density sum is that of its children's
densities. The element with the largest sum holds the article; the smallest density on the path from body to it is
the threshold that sets further parts apart from boilerplate: each element from body down that reaches it adds the
maximum-sum element within. Elements that say by tag, role or class what they are (menus, forms, adverts,
comments and so on) are left out beforehand; the result is widened to the article around it.

Text: character references decoded, white space inside a block to one space, ends trimmed, blocks in page order.

Cases: null or empty html and pages without text give an empty text; unclosed, unopened and deeply nested tags are
taken as they come (no recursion); cut pages give what is there; no length limit. One row per input row.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their role in HTML, and words of class, id and role that tell boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object embed svg canvas math head title textarea select option button audio video map".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
BOILER = set("nav footer aside form menu dialog search fieldset".split())
#: Elements that may hold a page's whole body, and what is left out of them then.
HOLDERS, LABELS = {"form", "fieldset"}, {"label", "legend"}
WORDS = set("ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion breadcrumb breadcrumbs comment comments commentlist disqus discussion replies respond cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login nav navbar navigation menu menubar sidebar aside complementary contentinfo footer masthead topbar toolbar pager pagination share sharing social related recommended recommendations outbrain taboola widget widgets".split())
ENDS_P = BLOCK - set("body html caption tbody td tfoot th thead tr li dd dt legend summary".split())
#: An element of these ends an open one of the same list, up to the element named.
SIBLINGS = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}


class _Tree(HTMLParser):
    """Parallel lists of the elements: parent, tag, whether left out; and the text pieces with their elements."""

    def __init__(self, hints: bool, boiler: set[str] = BOILER):
        super().__init__(convert_charrefs=True)
        self.hints, self.boiler = hints, boiler
        self.parent, self.tag, self.out = [-1], ["#root"], [False]
        self.pieces: list[tuple[int, str]] = []
        self.stack = [0]
        self.open: dict[str, int] = {}

    def _pop(self) -> None:
        self.open[self.tag[self.stack.pop()]] -= 1

    def _close(self, names, stop=frozenset()) -> None:
        """Closes the nearest open element of these names, unless one of ``stop`` is nearer."""
        if not any(self.open.get(n) for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t in names:
                while len(self.stack) > k:
                    self._pop()
                return
            if t in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close(("p",), {"td", "th", "table", "button", "li", "div", "section", "article"})
        if tag in SIBLINGS:
            names, stop = SIBLINGS[tag]
            self._close(tuple(names.split()), stop)
        if tag == "br":
            self.pieces.append((self.stack[-1], " "))
            return
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag == "a":
            self._close(("a",), BLOCK)
        up = self.stack[-1]
        out = self.out[up] or tag in RAW or tag in self.boiler or tag in LABELS and bool(self.open.get("form") or self.open.get("fieldset"))
        if not out and tag == "header":
            out = not (self.open.get("article") or self.open.get("main"))
        if self.hints and not out and attrs and tag not in ("html", "body", "article", "main", "h1"):
            for name, value in attrs:
                if value and name in ("class", "id", "role") and not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value.lower())):
                    out = True
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                    out = True
        self.parent.append(up)
        self.tag.append(tag)
        self.out.append(out)
        if tag not in VOID:
            self.stack.append(len(self.tag) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag == "p" and not self.open.get("p"):
            return
        self._close((tag,))

    def handle_data(self, data):
        if not self.out[self.stack[-1]]:
            self.pieces.append((self.stack[-1], data))


def _parsed(html: str, hints: bool, boiler: set[str] = BOILER) -> _Tree:
    tree = _Tree(hints, boiler)
    tree.feed(html)
    tree.close()
    return tree


def _letters(tree: _Tree) -> int:
    return sum(len(text) - text.count(" ") - text.count("\n") for _, text in tree.pieces)


def extract(html: str | None, hints: bool = True) -> str:
    """The main text of a page: blocks joined by newlines. If what classes say would leave no text, they aren't heeded.

    A form or fieldset is left out, unless such elements hold more than half of the text; then only their controls and labels are.
    """
    if not html:
        return ""
    tree = _parsed(html, hints)
    if not HOLDERS.isdisjoint(tree.tag):
        whole = _parsed(html, hints, BOILER - HOLDERS)
        if _letters(whole) > 2 * _letters(tree):
            tree = whole
    parent, tag, out = tree.parent, tree.tag, tree.out
    n = len(tag)
    chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        linked[i] = tag[i] == "a" or linked[parent[i]]
    for at, text in tree.pieces:
        size = len(text) - text.count(" ") - text.count("\n")
        chars[at] += size
        if linked[at]:
            link_chars[at] += size
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if out[i]:
            continue
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + linked[i]
    if not chars[0]:
        return extract(html, False) if hints else ""
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    share = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if c and not out[i]:
            t, lc, lt = max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
            density[i] = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / max(1e-6, math.log(base)))
            if i:
                total[parent[i]] += density[i]
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parent[i]] and not out[i]
    # The largest sum of each subtree; leaves stand for themselves where they have no children with text.
    own = [total[i] or density[i] * 1e-9 for i in range(n)]
    best = list(range(n))
    for i in range(n - 1, body, -1):
        p = parent[i]
        if inside[i] and own[best[i]] > own[best[p]]:
            best[p] = best[i]
    top = best[body]
    threshold, i = density[top], top
    while i != body:
        i = parent[i]
        threshold = min(threshold, density[i])
    marked = [False] * n
    for i in range(body, n):
        if inside[i] and density[i] >= threshold and density[i] > 0 and (i == body or tag[i] in BLOCK):
            marked[best[i]] = True
    # Widened to the article around, or to the element around that adds little but headings and further sections.
    i, around = top, top
    while i != body:
        if tag[i] in ("article", "main"):
            around = i
        i = parent[i]
    if around == top and tag[top] not in ("article", "main"):
        i = top
        while i != body and parent[i] != body and chars[top] >= 0.5 * chars[parent[i]] and link_chars[parent[i]] <= 0.2 * chars[parent[i]]:
            i = around = parent[i]
    inner = any(t in ("article", "main") for t in tag)
    if inner and tag[around] in ("article", "main"):
        marked = [False] * n
    marked[around] = True
    # Lists of links within an article or main, such as references, stay; those marked as navigation are out already.
    article, kept = [t in ("article", "main") for t in tag], [False] * n
    for i in range(1, n):
        article[i] = article[i] or article[parent[i]]
    for i in range(body, n):
        kept[i] = marked[i] or (i > 0 and kept[parent[i]] and not out[i])
        if kept[i] and i != around and not marked[i] and not article[i] and tag[i] in ("ul", "ol", "div", "section", "table") and link_tags[i] >= 2 and link_chars[i] > 0.6 * chars[i]:
            kept[i] = False
    block = [0] * n
    for i in range(1, n):
        block[i] = i if tag[i] in BLOCK else block[parent[i]]
    blocks, held, at = [], [], None
    for i, text in tree.pieces:
        if not kept[i] or out[i]:
            continue
        if block[i] != at:
            blocks.append(" ".join("".join(held).split()))
            held, at = [], block[i]
        held.append(text)
    blocks.append(" ".join("".join(held).split()))
    return "\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of each page."""
    fields = [pages.schema[c] for c in keep]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "text string, n_chars long"

    def work(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(work, ddl)
