"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams the events of a page. Blocks become
lines; each line has its characters over its tags, and more weight inside an
article or main element. A Gaussian smooths these ratios along the page, and
lines that reach the threshold form the content clusters. The clusters choose
the content region: the article or main element around the deepest container
with more than half of the clustered text. On pages where the clusters lie in
no such element, the lines that reach the threshold by themselves and what lies
between them are the content, with the short lines beside them in their containers and the headings
before them. The region's lines are the text, short ones included, without the
parts that are no article by their element or by their class, id or role
(menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts,
styles). A compound name as "no-sidebar" or "comments-open" says nothing of the
part unless all its words do. A form is such a part unless it holds more than
half of the clustered text, as where one is wrapped around the whole page; a
menu or the like that is never closed ends where an article begins. Of several
articles beside each other, those with at least a third of the largest one's
clustered text are taken. Time and memory are linear in the page.

Defined results: null or empty html, and pages without content, give an empty
text. Character references are decoded as browsers do. Broken nesting is
repaired by closing what an end tag encloses; what a page that breaks off has
left open counts to its end. Rows are independent, so repeated rows and null
ids pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm.common import shipped, slices

SCHEMA = "page_id long, url string, text string, n_chars long, n_lines long, n_content_lines long"

# Elements by their part in a page.
CONTAINERS = frozenset("html head body article main section div nav aside header footer form ul ol dl table tbody thead tr td th figure figcaption blockquote details dialog fieldset noscript template iframe svg math object video audio canvas select textarea button menu search address title".split())
BREAKS = CONTAINERS | frozenset("p br hr h1 h2 h3 h4 h5 h6 li dt dd pre caption legend summary option label center".split())
NEVER = frozenset("head script style noscript template iframe svg object video audio canvas select textarea button nav aside footer menu search dialog fieldset title".split())
ARTICLES = ("article", "main")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_ARTICLE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright complementary contentinfo search skip paywall".split()
)
READERS = frozenset("comment comments disqus respond reply replies responses discussion".split())
HEADERS = frozenset("header masthead".split())
#: Words that leave the meaning of a compound name to its other words ("site-footer").
PLAIN = frozenset("site page main global entry post article blog top bottom left right primary secondary box bar block area section wrap wrapper container inner outer list item items link links button buttons slot unit form title heading text body label content".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: Blocks whose end closes a link that was opened in them.
PARAGRAPHS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6".split())
#: Share of the largest article's clustered text from which one beside it is taken too.
BESIDE = 1 / 3

#: What a line's ratio counts inside an article or main element.
IN_ARTICLE = 2.0

_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Line:
    """A block's text, its tags, and the number of the innermost container (-1: none)."""

    __slots__ = ("parts", "tags", "links", "inside", "live", "heading")

    def __init__(self, inside: int, live: bool, heading: bool = False):
        self.parts: list[str] = []
        self.tags, self.links, self.inside, self.live, self.heading = 0, 0, inside, live, heading


def part_words(names: str) -> set[str]:
    """Words of class, id or role names that tell a part of the page."""
    out: set[str] = set()
    for name in names.split():
        words = {w.lower() for w in _TOKENS.findall(name) if len(w) > 1}
        if (known := words - PLAIN) <= NO_ARTICLE | READERS | HEADERS:
            out |= known
    return out


class Page(HTMLParser):
    """Collects the lines of a page and the containers that each lies in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: Open containers: (tag, number).
        self.open: list[tuple[str, int]] = []
        #: How many containers of each tag are open.
        self.depth: Counter[str] = Counter()
        #: Of each container: its kind, and the number of the one around it.
        self.kinds: list[str] = []
        self.parents: list[int] = []
        #: Also its own state ("" live, "never", "hint", "readers", "header", "form") and whether an end tag closed it.
        self.own: list[str] = []
        self.ended: list[bool] = []
        self.line = Line(-1, True)
        self.heading = self.link = self.link_depth = 0
        self.raw = ""
        #: An inline element of an advert, and how many of its tag are open.
        self.muted, self.muted_depth = "", 0

    def new_line(self, live: bool = True) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(self.open[-1][1] if self.open else -1, live, self.heading > 0)
        self.muted = ""

    def states(self) -> list[str]:
        """What each container is, with those around it."""
        out: list[str] = []
        #: The container that a state comes from.
        source: list[int] = []
        for k, (up, own) in enumerate(zip(self.parents, self.own)):  # a container comes after those around it
            outer = out[up] if up >= 0 else ""
            if not outer or outer == "form" and own:
                state = own
            elif self.kinds[k] in ARTICLES and (outer in ("hint", "form") or not self.ended[source[up]]):
                # A wrapper's class says little about the article inside it, and what was never closed ends there.
                state = own
            elif outer == "header" and own in ("never", "readers", "hint"):
                state = own
            else:
                state = outer
            if outer == "form" and not own and self.kinds[k] in ARTICLES:
                state = ""
            out.append(state)
            source.append(k if state != outer else source[up] if up >= 0 else k)
        return out

    def own_state(self, tag: str, attrs: dict[str, str | None]) -> str:
        words = part_words(" ".join(attrs.get(k) or "" for k in ("class", "id", "role")))
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if words & READERS:
            return "readers"
        if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style:
            return "never"
        if tag in ("html", "body", "article", "main"):
            return ""
        if words & NO_ARTICLE:
            return "hint"
        if tag == "form":
            return "form"
        if tag == "header" or words & HEADERS:
            return "header" if any(self.depth[t] for t in ARTICLES) else "hint"
        return ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.raw = tag
        if tag in CONTAINERS:
            if tag in ("head", "body"):  # no body without an end of the head
                self.close_to("head" if tag == "body" else "", soft=True)
            self.own.append(self.own_state(tag, dict(attrs)))
            self.ended.append(False)
            self.kinds.append("main" if dict(attrs).get("role") == "main" else tag)
            self.parents.append(self.open[-1][1] if self.open else -1)
            self.open.append((tag, len(self.kinds) - 1))
            self.depth[tag] += 1
        if tag in HEADINGS:
            self.heading = 1
        names = "" if tag in CONTAINERS else " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        words = part_words(names) if names else set()
        if tag in BREAKS:
            self.new_line(live=not words & (NO_ARTICLE | READERS))
        elif self.muted:
            self.muted_depth += tag == self.muted
        elif words & ADVERTS and tag not in VOID:
            self.muted, self.muted_depth = tag, 1
        if tag == "a":  # ends the one before; a mere anchor is no link
            self.link, self.link_depth = int("href" in dict(attrs)), len(self.open)
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "a" or tag in CONTAINERS and tag not in ("div", "section", "article", "main", "body", "html"):
            self.handle_endtag(tag)

    def close_to(self, tag: str, soft: bool = False) -> None:
        """Close the innermost container of a tag and what it encloses, if one is open."""
        if not self.depth[tag] or soft and self.open[-1][0] not in ("head", "title"):
            return
        while True:
            closed, k = self.open.pop()
            self.depth[closed] -= 1
            if closed == tag:
                self.ended[k] = not soft
                break
        if len(self.open) < self.link_depth:
            self.link = 0

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.raw = ""
        if tag in CONTAINERS:
            self.close_to(tag)
        if tag in HEADINGS:
            self.heading = 0
        self.line.tags += 1
        if tag in BREAKS:
            self.new_line()
        elif tag == self.muted:
            self.muted_depth -= 1
            if not self.muted_depth:
                self.muted = ""
        if tag == "a" or tag in PARAGRAPHS:
            self.link = 0

    def handle_data(self, data: str) -> None:
        if self.raw or self.muted:
            return
        self.line.parts.append(data)
        if self.link:
            self.line.links += len(data.strip())


def smoothed(values: list[float], sigma: float = 1.0, radius: int = 2) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    n, out = len(values), []
    for i in range(n):
        near = [(w, values[i + k]) for k, w in zip(range(-radius, radius + 1), weights) if 0 <= i + k < n]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def clustered(lines: list[Line], sizes: list[int], marked: list[bool]) -> tuple[list[bool], list[bool]]:
    """(clustered, core): lines whose smoothed text-to-tag ratio reaches the threshold: the ratios'
    standard deviation, or their mean where that is less (pages of long blocks
    only), and those that reach it without their neighbours. Inside an article
    or main element a ratio counts ``IN_ARTICLE`` times."""
    own = [(IN_ARTICLE if m else 1) * n / max(1, x.tags) if x.live else 0.0 for x, n, m in zip(lines, sizes, marked)]
    ratios = smoothed(own)
    if not ratios:
        return [], []
    mean = sum(ratios) / len(ratios)
    threshold = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))
    content = [x.live and n > 0 and r >= threshold for x, n, r in zip(lines, sizes, ratios)]
    return content, [c and r >= threshold for c, r in zip(content, own)]


def within(parents: list[int], kinds: list[str], wanted: tuple[str, ...]) -> list[bool]:
    """For each container, whether it or one around it is of the wanted kinds."""
    out: list[bool] = []
    for k, up in enumerate(parents):  # a container comes after those around it
        out.append(kinds[k] in wanted or up >= 0 and out[up])
    return out


def extract(html: str) -> tuple[str, int, int]:
    """(main text, lines of the page, lines of the text)."""
    page = Page()
    page.feed(html)
    page.close()
    page.new_line()
    texts, lines = [], []
    for line in page.lines:
        if text := " ".join("".join(line.parts).split()):
            texts.append(text)
            lines.append(line)
    sizes = [len(t) for t in texts]
    parents, kinds, states = page.parents, page.kinds, page.states()
    of = [states[x.inside] if x.inside >= 0 else "" for x in lines]
    mine = [x.live for x in lines]
    for x, m, state in zip(lines, mine, of):
        x.live = m and (not state or state == "header" and x.heading)
    in_article = within(parents, kinds, ARTICLES)
    marked = [x.inside >= 0 and in_article[x.inside] for x in lines]
    if "form" in of:
        whole = whole_forms(lines, sizes, marked, mine, of, parents, states)
        for x, m, state in zip(lines, mine, of):
            if state == "form" and m and form_of(x.inside, parents, states) in whole:
                x.live = True
    content, core = clustered(lines, sizes, marked)
    regions = content_regions(lines, sizes, content, parents, kinds)
    if regions:
        here = [False] * len(parents)
        for k, up in enumerate(parents):
            here[k] = k in regions or up >= 0 and here[up]
        keep = [x.live and x.inside >= 0 and here[x.inside] for x in lines]
    else:
        keep = _without_article(lines, sizes, core if any(core) else content, parents, kinds)
    chosen = [t for t, k in zip(texts, keep) if k]
    return " ".join(chosen), len(lines), len(chosen)


def form_of(k: int, parents: list[int], states: list[str]) -> int:
    """The outermost container of the form around a container."""
    while parents[k] >= 0 and states[parents[k]] == "form":
        k = parents[k]
    return k


def whole_forms(lines: list[Line], sizes: list[int], marked: list[bool], mine: list[bool], of: list[str], parents: list[int], states: list[str]) -> set[int]:
    """Forms with more than half of the text that is clustered if all of them count."""
    before = [x.live for x in lines]
    for x, m, state in zip(lines, mine, of):
        x.live = x.live or m and state == "form"
    content, _ = clustered(lines, sizes, marked)
    mass: Counter[int] = Counter()
    for x, n, c, state in zip(lines, sizes, content, of):
        mass[form_of(x.inside, parents, states) if state == "form" else -1] += n * c
    for x, live in zip(lines, before):
        x.live = live
    return {k for k, m in mass.items() if k >= 0 and 2 * m > mass.total()}


def content_regions(lines: list[Line], sizes: list[int], content: list[bool], parents: list[int], kinds: list[str]) -> set[int]:
    """The article or main element around the deepest container with more than
    half of the clustered text, and articles beside it with much of it; none if
    there is no such element."""
    mass = [0] * len(parents)
    total = 0
    for line, n, c in zip(lines, sizes, content):
        if c:
            total += n
            if line.inside >= 0:
                mass[line.inside] += n
    for k in range(len(parents) - 1, -1, -1):
        if parents[k] >= 0:
            mass[parents[k]] += mass[k]
    # Of containers with more than half, each is around the next one.
    at = max((k for k, m in enumerate(mass) if 2 * m > total), default=-1)
    while at >= 0 and kinds[at] not in ARTICLES:
        at = parents[at]
    if at < 0:
        return set()
    return {at, *(k for k, up in enumerate(parents) if up == parents[at] and kinds[k] == kinds[at] == "article" and mass[k] >= BESIDE * mass[at])}


def _without_article(lines: list[Line], sizes: list[int], content: list[bool], parents: list[int], kinds: list[str]) -> list[bool]:
    """No article or main element: from the first core line to the last, with
    the lines beside them in their containers and the heading run before."""
    usable = [x.live and x.links < 0.5 * n for x, n in zip(lines, sizes)]
    marks = [i for i, (a, c) in enumerate(zip(usable, content)) if a and c]
    if not marks:
        return [False] * len(lines)

    def around(mark: int) -> set[int]:
        out, k = set(), lines[mark].inside
        while k >= 0:
            out.add(k)
            k = parents[k]
        return out

    def run(mark: int, step: int) -> int:
        """The last line of the run of lines beside a clustered one: in its
        container or below, or in one around it that is no whole page."""
        outer, inner, at = around(mark), {lines[mark].inside}, mark
        while 0 <= at + step < len(lines) and usable[at + step]:
            k, path = lines[at + step].inside, []
            while k >= 0 and k not in inner:
                path.append(k)
                k = parents[k]
            own = lines[at + step].inside
            if k >= 0 or lines[mark].inside < 0:
                inner.update(path)
            elif not (own in outer and kinds[own] not in ("html", "body")):
                break
            at += step
        return at

    start, end = run(marks[0], -1), run(marks[-1], 1)
    # Headings, with what stands between them and the text (a byline).
    at = start
    while at and usable[at - 1]:
        at -= 1
        if lines[at].heading:
            start = at
    return [a and start <= i <= end for i, a in enumerate(usable)]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page. A map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "h"):
            text, lines, kept = zip(*(extract(h or "") for h in batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(lines, pa.int64()), pa.array(kept, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_lines", "n_content_lines"],
            )

    return shipped(pages).selectExpr(f"cast(`{id_col}` as long) i", f"cast(`{url_col}` as string) u", f"cast(`{html_col}` as string) h").mapInArrow(run, SCHEMA)
