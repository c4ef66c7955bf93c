"""Operator 7, main text of web pages by composite text density.

A page becomes a tree of its tags.  Every node has the characters and tags below it
and how many of them belong to links; its composite density is characters per tag,
lowered the more of them are links, relative to the share of links in the body.  A
node's density sum adds the densities of its children (its own text counts as one).
The least density on the path from the body to the node with the greatest sum is the
threshold.  From the body down, every node that reaches it gives the subtree of the
greatest sum within it; these subtrees together, in page order, are the main text,
without boxes beside them whose sum is under a tenth of the greatest, and without
boxes inside them that miss the threshold and are links for the greater part.
Where the greatest of all stands in an ``article`` or ``main``, the page itself says
where its text is: only subtrees in such nodes count, each grown to the outermost one
that reaches the threshold.

Nodes that are no article by their tag, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) leave the tree
first, as prose in an advert or a comment has the density of an article's.  A class
says so only if all its parts are such names or words of layout (``cookie-notice``,
``comment-list``; not ``comment-on-law``), and an article's own header stays.  Where that would take every article or first heading, as when an end tag is
missing, articles inside them stay.  Paragraphs, list items and table parts end where the next one begins.

Text: character references are decoded, white space inside a block becomes one space,
blocks are joined by one space in page order.  Null html counts as empty and gives
empty text; of equal density sums the first node in page order counts; repeated rows get equal results; an empty table gives no rows; columns
other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.common import map_texts
from hindcast.sources.tables import read_table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>
    |<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
              "small span strike strong sub sup time tt u var wbr".split())
#: Tags that the start of another ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
         "option": {"option"}}
_SCOPE = set("ul ol dl table div article section main body nav aside footer header form".split())
_AFTER_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
               "hgroup hr main menu nav ol p pre section table ul".split())
_NOT_TEXT = set("head script style noscript template nav footer aside form button select textarea option iframe svg "
                "math object canvas dialog menu menuitem audio video map".split())
_NOT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOT_NAMES = set("ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion "
                 "cookie cookies consent notice notices gdpr popup modal overlay comment comments disqus respond replies "
                 "sidebar aside widget widgets related recommended recommendations share sharing social newsletter subscribe "
                 "signup login menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar "
                 "footer copyright toolbar form".split())
#: Words of layout, which beside such a name leave its meaning.
_LAYOUT = set("area block body bottom box container content fixed group holder inner item items left level links list main "
              "outer page panel post primary reader right row secondary section site slot sticky thread top unit user wrap wrapper".split())
#: Names of a header, which belongs to the text inside an article.
_HEADER_NAMES = {"header", "masthead"}
_ARTICLE = {"article", "main"}
#: Tags that hold text of their own; the other blocks are boxes.
_TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption caption td th tr tbody thead tfoot".split())
LEAST_SHARE = 0.1


def _no_article(value: str, in_article: bool) -> bool:
    """Whether a class or id names a part that is no article."""
    for name in value.split():
        parts = {x for x in re.split(r"[^a-z]+", name) if x}
        named = parts & _NOT_NAMES - (_HEADER_NAMES if in_article else set())
        if named and parts <= _NOT_NAMES | _LAYOUT:
            return True
    return False


class Page:
    """The tree as lists by node; node 0 is the body."""

    def __init__(self, html: str):
        self.tag, self.parent, self.dropped, self.in_article = ["body"], [-1], [False], [False]
        self.parts: list[tuple[int, str]] = []  # (node, text) in page order; blanks part blocks
        stack, at = [0], 0
        while True:
            found = _TAG.search(html, at)
            text = html[at:found.start()] if found else html[at:]
            if text:
                self.parts.append((stack[-1], unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            name = found.group(2)
            if name is None:
                continue
            name = name.lower()
            if name not in _INLINE:
                self.parts.append((stack[-1], " "))
            if found.group(1):
                self._end(stack, name)
            elif name in ("html", "body"):
                self._mark(0, name, found.group(3))
            else:
                at = self._start(stack, name, found.group(3), html, at)
        self._drop()

    def _start(self, stack: list[int], name: str, attributes: str, html: str, at: int) -> int:
        if name in _AFTER_P:
            self._close(stack, {"p"}, _SCOPE)
        elif name in _ENDS:
            self._close(stack, _ENDS[name], _SCOPE)
        if name in _VOID:
            return at
        if name in _RAW:
            end = _RAW[name].search(html, at)
            return end.end() if end else len(html)
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.dropped.append(False)
        self.in_article.append(self.in_article[stack[-1]] or name in _ARTICLE)
        self._mark(len(self.tag) - 1, name, attributes)
        if not attributes.rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append(len(self.tag) - 1)
        return at

    def _close(self, stack: list[int], names: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in names:
                del stack[k:]
                return
            if self.tag[stack[k]] in scope:
                return

    def _end(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                del stack[k:]
                return
            if name in _INLINE and self.tag[stack[k]] not in _INLINE:
                return

    def _mark(self, node: int, name: str, attributes: str) -> None:
        if node and (name in _NOT_TEXT or name == "header" and not self.in_article[node]):
            self.dropped[node] = True
        if not node or not attributes or name in _ARTICLE and "=" not in attributes:
            return
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if (key in ("class", "id") and _no_article(value, self.in_article[node]) or key == "role" and value in _NOT_ROLES or key == "hidden"
                    or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value)):
                self.dropped[node] = True

    def _drop(self) -> None:
        """Marks hold for all below.  Where every article stands inside a marked node
        (an end tag is missing, or a form spans the page), articles begin unmarked."""
        own = list(self.dropped)
        for n in range(1, len(self.tag)):
            self.dropped[n] = own[n] or self.dropped[self.parent[n]]
        found = [n for n, t in enumerate(self.tag) if t in _ARTICLE or t == "h1"]
        if any(not self.dropped[n] for n in found):
            return
        for n in range(1, len(self.tag)):
            free = self.tag[n] in _ARTICLE or self.tag[n] == "form" and any(m > n and self._inside(m, n) for m in found)
            self.dropped[n] = own[n] and not (free and self.tag[n] == "form") or self.dropped[self.parent[n]] and not free

    def _inside(self, node: int, top: int) -> bool:
        while node > top:
            node = self.parent[node]
        return node == top

    def chosen(self) -> set[int]:
        """The nodes of the main text."""
        size = len(self.tag)
        chars, link_chars, tags, link_tags, own = ([0] * size for _ in range(5))
        in_link = [False] * size
        for n in range(1, size):
            in_link[n] = in_link[self.parent[n]] or self.tag[n] == "a"
        for n, text in self.parts:
            if not self.dropped[n]:
                k = len("".join(text.split()))
                own[n] += k
                chars[n] += k
                if in_link[n]:
                    link_chars[n] += k
        for n in range(size - 1, 0, -1):
            if not self.dropped[n]:
                up = self.parent[n]
                chars[up] += chars[n]
                link_chars[up] += link_chars[n]
                tags[up] += tags[n] + 1
                link_tags[up] += link_tags[n] + (self.tag[n] == "a")
        share = link_chars[0] / max(chars[0], 1)

        def density(c: int, lc: int, t: int, lt: int) -> float:
            if not c:
                return 0.0
            base = log(c / max(c - lc, 1) * lc + share * c + e)
            return c / max(t, 1) * log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(log(base), 0.1)

        each = [density(chars[n], link_chars[n], tags[n], link_tags[n]) for n in range(size)]
        total = [density(own[n], own[n] if in_link[n] else 0, 1, 0) for n in range(size)]
        for n in range(size - 1, 0, -1):
            if not self.dropped[n]:
                total[self.parent[n]] += each[n]
        top = list(range(size))  # of each subtree, the node of the greatest sum, the first of equal ones
        rank = [(-1.0 if self.dropped[n] else total[n], -n) for n in range(size)]
        for n in range(size - 1, 0, -1):
            top[self.parent[n]] = max(top[self.parent[n]], top[n], key=rank.__getitem__)
        path = [top[0]]
        while path[-1]:
            path.append(self.parent[path[-1]])
        threshold = min(each[n] for n in path)
        wide = [n for n in path if self.tag[n] in _ARTICLE]
        least = LEAST_SHARE * total[path[0]]
        outer = [-1] * size  # the outermost article or main that reaches the threshold
        found = set(wide[-1:])
        inside = [False] * size
        for n in range(size):
            up = self.parent[n]
            outer[n] = outer[up] if n and outer[up] >= 0 else n if self.tag[n] in _ARTICLE and each[n] >= threshold and not self.dropped[n] else -1
            inside[n] = n in found or n > 0 and inside[up]
            if inside[n] or self.dropped[n] or n and not each[n] or each[n] < threshold:
                continue
            if not wide:
                if self.tag[n] in _TEXT_TAGS or total[top[n]] >= least:
                    found.add(top[n])
                    inside[n] = top[n] == n
            elif outer[n] == n:
                found.add(n)
                inside[n] = True
        linked = [False] * size  # in a box that misses the threshold and is mostly links
        for n in range(1, size):
            box = self.tag[n] not in _INLINE and self.tag[n] not in _TEXT_TAGS and n not in path
            linked[n] = linked[self.parent[n]] or box and each[n] < threshold and 2 * link_chars[n] > chars[n]
            self.dropped[n] = self.dropped[n] or linked[n]
        return found

    def text(self, nodes: set[int]) -> str:
        inside = [n in nodes for n in range(len(self.tag))]
        for n in range(1, len(self.tag)):
            inside[n] = inside[n] or inside[self.parent[n]]
        return " ".join("".join(t for n, t in self.parts if inside[n] and not self.dropped[n]).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    return page.text(page.chosen())


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages``."""

    def make():
        def work(batch):
            return {"page_id": batch.column("page_id"), "url": batch.column("url"),
                    "text": [main_text(x) for x in batch.column("html").to_pylist()]}
        return work

    return map_texts(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    made = extracted(read_table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
