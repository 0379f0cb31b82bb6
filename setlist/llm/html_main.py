"""Main text of web pages by tree scoring.

Every paragraph gives points, for being one, for its length and its commas, to its ancestors: all
to the parent, half to the next, less above. A container's points are discounted by its link
density. The best container is kept (widened to the article around it), and with it those siblings
that read like text. Parts that are boilerplate by tag or role give nothing and are left out
wherever they stand. So are, whatever their size, parts whose class or id can only name reader
comments, sidebars or adverts, also in articles; an article in them is not the page's. Other names of
boilerplate, words of a class or id, drop a part unless it wraps the page: it then holds an article or
main part, or a heading of the first level. In an article they count as whole class names only; the
ids of sections and headings, made from titles, never do.

Each page is parsed on its own in a task; pages are not shuffled.

Defined cases: null or empty html, or a page without any text outside boilerplate, gives an empty
text. Markup may be broken: unclosed elements end with their parent, stray end tags are ignored.
Nothing is shortened. Repeated pages each get a row, null ids and urls are passed through. Empty
tables give no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HIDDEN = {"head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar"}
FURNITURE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments commentlist disqus respond replies notice notices alert cookie cookies consent gdpr popup "
    "modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget login search "
    "toolbar pagination pager skip".split())
# Class names and ids that can only mean boilerplate: these words alone, or the first ones before one of the second.
SURE_NAMES = set("comment comments commentlist disqus respond replies sidebar ad ads advert adverts advertisement sponsored".split())
SURE_STARTS = set("comment comments disqus sidebar ad ads advert adverts advertisement".split())
SURE_ENDS = set(
    "area block body box column container content form inner left list primary respond right secondary section slot thread top unit widget wrap wrapper".split())
HEAD_NAMES = {"header", "masthead", "topbar", "branding"}
MAIN = {"article", "main"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Class names that begin with these words state what a part has or is filed under, not what it is.
ABOUT = {"no", "not", "has", "with", "without", "is", "category", "tag", "tagged", "type", "format", "status", "topic"}
ROOTS = {"html", "body", "article", "main"}
# An element of the key's group ends an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
KEEPS_PARAGRAPH = INLINE | {"br"}
SPACES = re.compile(r"[\x20\x09-\x0D]+")
NAME_PARTS = re.compile(r"[^a-z0-9]+")


class _Page(HTMLParser):
    """A page as lists of nodes and text blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.dead, self.inside = ["#root"], [-1], [False], [False]
        # Boilerplate by name, for sure or unless it wraps the page; parts of the page's own articles; in an article.
        self.sure, self.named, self.main, self.article = [False], [False], [False], [False]
        self.stack, self.open = [0], Counter()
        self.parts: list[str] = []
        self.links, self.link_parts = 0, 0
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag not in HIDDEN and self.open["p"]:
                self.end({"p"}, {"table", "td", "th", "button"})
            if tag in CLOSES and tag != "p":
                self.end(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        if tag == "a":
            self.links += 1
        parent = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        within = self.inside[parent] or tag in MAIN
        self.inside.append(within)
        self.dead.append(self.dead[parent] or self.is_furniture(tag, attrs, self.inside[parent]))
        sure = self.sure[parent] or self.has_sure_name(tag, attrs)
        named = self.has_name(tag, attrs, self.inside[parent], self.article[parent])
        self.sure.append(sure)
        self.named.append(named and tag not in ROOTS)
        # A comment may be an article; it does not count as one of the page's.
        self.main.append(not (named or sure) if tag in MAIN else self.main[parent])
        self.article.append(self.article[parent] or tag == "article")
        self.stack.append(len(self.tags) - 1)
        self.open[tag] += 1

    def is_furniture(self, tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> bool:
        if tag in HIDDEN or tag in FURNITURE or tag == "header" and not in_main:
            return True
        if tag in ROOTS:
            return False
        given = dict(attrs)
        return "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or (given.get("role") or "").lower() in ROLES

    def has_sure_name(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body") or tag in HEADING or tag in INLINE and (self.open["pre"] or self.open["code"]):
            return False
        given = dict(attrs)
        for token in (given.get("class") or "").lower().split() + (given.get("id") or "").lower().split():
            words = [word for word in NAME_PARTS.split(token) if word]
            if words[:1] == [token] and token in SURE_NAMES or len(words) > 1 and words[0] in SURE_STARTS and words[-1] in SURE_ENDS:
                return True
        return False

    def has_name(self, tag: str, attrs: list[tuple[str, str | None]], in_main: bool, in_article: bool) -> bool:
        given = dict(attrs)
        tokens = (given.get("class") or "").lower().split()
        if in_article and tag not in MAIN:
            return any(token in FURNITURE_NAMES for token in tokens)
        if tag != "section" and tag not in HEADING and "section" not in tokens:
            tokens += (given.get("id") or "").lower().split()
        names = set()
        for token in tokens:
            words = [word for word in NAME_PARTS.split(token) if word]
            if words and words[0] not in ABOUT:
                names.update(words)
        return bool(names & FURNITURE_NAMES) or not in_main and bool(names & HEAD_NAMES)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.open[tag]:
            return
        if tag not in INLINE:
            self.flush()
        elif any(self.tags[n] not in INLINE for n in self.stack[-1:]):
            return  # an inline end tag does not end the block it stands in
        self.end({tag}, set())

    def end(self, tags: set[str], barrier: set[str]) -> None:
        """End the innermost open element among `tags`, unless a barrier is met first."""
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[at]]
            if tag in tags:
                for node in self.stack[at:]:
                    self.open[self.tags[node]] -= 1
                    self.links -= self.tags[node] == "a"
                del self.stack[at:]
                return
            if tag in barrier:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.link_parts += len(data.strip())

    def flush(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", "".join(self.parts)).strip(" ")
            node = self.stack[-1]
            while self.tags[node] in INLINE and not (self.dead[node] or self.sure[node] or self.named[node]):
                node = self.parents[node]
            if text and not (self.dead[node] or self.sure[node]):
                self.blocks.append((node, text, self.link_parts))
            self.parts, self.link_parts = [], 0

    def finish(self) -> None:
        self.close()
        self.flush()
        if any(self.named):
            self.drop_named()

    def drop_named(self) -> None:
        """Leave out the blocks of parts that are boilerplate by name and do not wrap the page."""
        wraps = [False] * len(self.tags)
        for node in range(len(self.tags) - 1, 0, -1):  # parents come before their children
            own = self.tags[node] in MAIN and self.main[node] or self.tags[node] == "h1"
            if (own or wraps[node]) and not (self.sure[node] or self.dead[node]):
                wraps[self.parents[node]] = True
        gone = [False] * len(self.tags)
        for node in range(1, len(self.tags)):
            gone[node] = gone[self.parents[node]] or self.named[node] and not wraps[node]
        kept = []
        for node, text, link_chars in self.blocks:
            if not gone[node]:
                while self.tags[node] in INLINE:
                    node = self.parents[node]
                kept.append((node, text, link_chars))
        self.blocks = kept


def _value(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _ancestors(page: _Page, node: int, most: int) -> Iterator[int]:
    for _ in range(most):
        node = page.parents[node]
        if node <= 0:
            return
        yield node


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by an empty line."""
    page = _Page()
    page.feed(html or "")
    page.finish()
    if not page.blocks:
        return ""
    points: Counter = Counter()
    size, linked = Counter(), Counter()
    for node, text, link_chars in page.blocks:
        value = _value(text)
        leaf = page.tags[node] in ("p", "pre", "td", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6")
        chain = list(_ancestors(page, node, 5)) if leaf else [node, *_ancestors(page, node, 4)]
        for depth, above in enumerate(chain):
            points[above] += value * (1 - min(1, link_chars / len(text))) / (1 if depth == 0 else 2 * depth)
            size[above] += len(text)
            linked[above] += link_chars
    def worth(n: int) -> float:
        return points[n] * (1 - min(1, linked[n] / max(1, size[n])))
    if not points:
        return "\n\n".join(text for _, text, _ in page.blocks)
    best = max(points, key=lambda n: (worth(n), -n))
    top = best
    for above in (best, *_ancestors(page, best, len(page.tags))):
        if page.tags[above] in MAIN:
            top = above
            break
    kept = {top}
    if page.tags[top] not in ROOTS:  # siblings that read like text
        parent, floor = page.parents[top], max(1.0, 0.2 * worth(best))
        for node in points:
            if page.parents[node] == parent and worth(node) >= floor:
                kept.add(node)
        for node, text, link_chars in page.blocks:
            heading = re.fullmatch("h[1-6]", page.tags[node])
            if page.parents[node] == parent and (heading or page.tags[node] == "p" and link_chars < 0.25 * len(text)):
                kept.add(node)
    inside: dict[int, bool] = {-1: False}

    def is_kept(node: int) -> bool:
        way = []
        while node not in inside and node not in kept:
            way.append(node)
            node = page.parents[node]
        found = node in kept or inside[node]
        for n in way:
            inside[n] = found
        return found

    return "\n\n".join(text for node, text, _ in page.blocks if is_kept(node))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    id_type, url_type = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    return rows.mapInArrow(extract, f"page_id {id_type}, url {url_type}, text string, n_chars long")
