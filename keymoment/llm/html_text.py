"""Main text of HTML pages by text-to-tag ratio.

Parser events stream into lines: a block of text with the number of tags that came with it, the share of it in links, the
element it stands in and, if any, the element around it that its class or id marks as boilerplate. The ratio of text to
tags per line is smoothed with a Gaussian, and lines are clustered by a threshold, the smoothed ratio's standard deviation.
The content cluster selects the region:

* an element that holds most of the cluster's text is content, whatever its class or id says;
* the region is the main or articles that hold most of the cluster, else the innermost element that holds all of it;
* in the region, runs of lines that are links for the most part, and most of them under the threshold, are menus and go. Other lines under it
  stay, as short paragraphs of an article are under it too.

What HTML itself calls navigation, footer, sidebar, hidden and so on never counts. A line holds numbers of elements, not
paths, so memory and time are in proportion to the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keymoment.llm.common import map_text

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist map".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words in a class or id that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe signup share sharing social related recommended comment comments commentlist respond disqus reply replies widget pagination pager toolbar skip search login adsbygoogle taboola outbrain paywall subscription cookiebar cookieconsent sitemap".split()
)
# Words that begin a class which tells a page's layout (no-sidebar), not what the element is; words that,
# beside "header", mark the header of a site rather than that of an article.
LAYOUT_WORDS = frozenset("no not has have with without layout is js".split())
SITE_WORDS = frozenset("site global top main".split())
#: Elements that are a part of a text, never its container.
PARTS = frozenset("p li td th tr pre h1 h2 h3 h4 h5 h6 dd dt blockquote ul ol dl".split())
# Words that stand beside those of ASIDE_WORDS in names of boilerplate (ad-slot, share-buttons, left-sidebar);
# with any other word (related-work) a name is that of a topic.
STRUCTURE_WORDS = frozenset(
    "area bar block body bottom box btn button buttons center col column container count desktop fixed form group header heading icon icons inner item items left link links list main mobile module outer overlay panel placeholder post posts articles stories right row section site slot sticky thread title toggle top unit wrap wrapper primary secondary global page entry article blog js wp google id policy".split()
)
# Words of what has articles of its own, or may be longer than the article.
OTHER_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo related recommended comment comments commentlist respond disqus reply replies adsbygoogle taboola outbrain".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Width of the Gaussian, in lines.
SIGMA = 1.0
#: So many lines of links in a row, most of them under the threshold, are a menu.
MENU_LINES = 3
FIELDS = [("content", "string"), ("n_chars", "bigint")]


def _hidden(attrs: dict[str, str | None]) -> bool:
    """Whether an element's attributes say for certain that it is boilerplate or hidden."""
    style = (attrs.get("style") or "").lower().replace(" ", "")
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    return (attrs.get("role") or "").lower() in ASIDE_ROLES


def _marked(attrs: dict[str, str | None], inside: bool) -> frozenset[str] | set[str]:
    """The words by which an element's class or id says that it is boilerplate; inside: within an article.

    All words of a name have to be those of boilerplate. Outside an article, a class that begins with such a word will do."""
    classes = (attrs.get("class") or "").split()
    for k, name in enumerate(classes + (attrs.get("id") or "").split()):
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if w]
        if not words or words[0] in LAYOUT_WORDS:
            continue
        found = ASIDE_WORDS.intersection(words)
        if found and (all(w in ASIDE_WORDS or w in STRUCTURE_WORDS or w.isdigit() for w in words) or (not inside and k < len(classes) and words[0] in ASIDE_WORDS)):
            return found
        if not inside and "header" in words and (len(words) == 1 or not SITE_WORDS.isdisjoint(words)):
            return {"header"}
    return frozenset()


@dataclass(slots=True)
class _Open:
    """An open element. block: the depth of the innermost block at or above it; mark: the outermost marked element around."""

    tag: str
    number: int
    boiler: bool
    silent: bool
    mark: int
    inside: bool
    aside: bool
    linked: bool
    block: int


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    links: float
    element: int
    mark: int


class _Lines(HTMLParser):
    """Collects the lines outside boilerplate, and of all elements the parent and the tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.kind = [0], [""]
        root = _Open("", 0, False, False, 0, False, False, False, 0)
        self.stack = [root]
        self.opened: dict[str, int] = {}
        self.lines: list[Line] = []
        self.other: set[int] = set()  # elements marked by OTHER_WORDS
        self.text: list[str] = []
        self.linked = self.tags = 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                top = self.stack[-1]
                if not top.boiler:
                    self.lines.append(Line(text, max(1, self.tags), min(1.0, self.linked / len(text)), self.stack[top.block].number, top.mark))
                self.tags = 0
            self.text, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        self.end_line()
        for e in self.stack[depth:]:
            self.opened[e.tag] -= 1
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br" or tag == "wbr":
            self.text.append(" " if tag == "br" else "")
            return
        block = tag in BLOCK
        if block:
            self.end_line()
        if block and tag not in ("html", "body"):
            at = self.stack[-1].block
            name = self.stack[at].tag
            if at and ((name == "p" and tag not in ("option", "optgroup")) or name in CLOSES.get(tag, ())):
                self._pop(at)
        if tag in VOID:
            return
        up = self.stack[-1]
        number = len(self.parent)
        self.parent.append(self.stack[up.block].number)
        self.kind.append(tag)
        words = frozenset()
        hidden = False
        if attrs and tag not in ("html", "body"):
            given = dict(attrs)
            if tag not in ("main", "h1", "h2", "h3", "h4", "h5", "h6"):
                words = _marked(given, up.inside)
            hidden = tag not in ("main", "article") and _hidden(given)
        if tag == "form":  # a form is boilerplate, unless it is put around the page
            words = words or {"form"}
        boiler = up.boiler or tag in ASIDE or (tag == "header" and not up.inside) or hidden
        if tag == "main" and not up.aside:
            boiler = False
        mark = up.mark
        if tag == "main" or (tag == "article" and not words and up.mark not in self.other):
            mark = 0  # whatever the classes of elements around it say
        elif words and tag != "article" and not mark:
            mark = number
            if not OTHER_WORDS.isdisjoint(words):
                self.other.add(number)
        # Within a block, what an inline element marks as boilerplate is left out of the block's line.
        out = not block and ((boiler and not up.boiler) or (bool(words) and not up.mark and "-" not in tag))
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.stack.append(_Open(tag, number, boiler, up.silent or out or tag in SILENT, mark, up.inside or tag in ("article", "main"), up.aside or tag in ASIDE, up.linked or tag == "a", len(self.stack) if block else up.block))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif self.opened.get(tag):
            depth, least = len(self.stack) - 1, 0 if tag in BLOCK else self.stack[-1].block
            while depth > least and self.stack[depth].tag != tag:
                depth -= 1
            if depth > least or (tag in BLOCK and depth):
                if self.stack[-1].block >= depth:
                    self._pop(depth)
                else:
                    self.opened[tag] -= 1
                    del self.stack[depth]  # the inline elements behind it stay open

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.silent:
            self.text.append(data)
            if top.linked:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian, normalised at the edges."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratio, kernel)[reach:-reach] / np.convolve(np.ones(len(ratio)), kernel)[reach:-reach]


def levels(lines: list[Line]) -> np.ndarray:
    """The smoothed text-to-tag ratio of each line."""
    return smoothed(np.array([len(x.text) / x.tags for x in lines]))


def cluster(level: np.ndarray) -> np.ndarray:
    """Whether lines are content: their level reaches its standard deviation; of one or two lines, all are."""
    return level >= level.std() if len(level) > 2 else np.ones(len(level), bool)


def _held(chosen: list[Line], parent: list[int]) -> list[int]:
    """The text of the chosen lines that each element holds; elements come after their parents."""
    held = [0] * len(parent)
    for x in chosen:
        held[x.element] += len(x.text)
    for e in range(len(parent) - 1, 0, -1):
        held[parent[e]] += held[e]
    return held


def _region(chosen: list[Line], page: _Lines) -> list[bool]:
    """For each element, whether its lines are of the region that the content cluster's lines select: a main, or articles,
    if they hold over half of the cluster's text; else the innermost element that holds all of it."""
    held, parent, kind = _held(chosen, page.parent), page.parent, page.kind
    total = held[0]
    main, article = [0] * len(parent), [0] * len(parent)  # the innermost main, and the outermost article in it, around each
    for e in range(1, len(parent)):
        main[e] = e if kind[e] == "main" else main[parent[e]]
        article[e] = 0 if kind[e] == "main" else article[parent[e]] or (e if kind[e] == "article" else 0)
    picked = {0}
    if 2 * sum(len(x.text) for x in chosen if main[x.element] or article[x.element]) > total:
        most = max((e for e in range(1, len(parent)) if kind[e] == "main" and 2 * held[e] > total), default=0)
        inside = [x for x in chosen if (main[x.element] == most if most else main[x.element] or article[x.element])]
        # Articles of a main are all of it, unless content lies in the main beside them.
        picked = {most} if most and any(not article[x.element] for x in inside) else {article[x.element] or main[x.element] for x in inside}
    else:
        picked = {max((e for e in range(1, len(parent)) if held[e] == total and kind[e] not in PARTS), default=0)}
    within = [0 in picked] + [False] * (len(parent) - 1)
    for e in range(1, len(parent)):
        within[e] = within[parent[e]] or e in picked
    return within


def select(page: _Lines) -> list[Line]:
    """The lines of the main text."""
    lines = page.lines
    if not lines:
        return []
    chosen = [x for x, c in zip(lines, cluster(levels(lines)), strict=True) if c]
    held = _held(chosen, page.parent)
    plain = sum(len(x.text) for x in chosen if not x.mark)
    # What holds most of the cluster isn't boilerplate by its class alone; comments and the like only if there is hardly
    # anything else, as they may be longer than the article.
    free = {0} | {x.mark for x in lines if x.mark and 2 * held[x.mark] > held[0] and (x.mark not in page.other or 10 * plain < held[0])}
    lines = [x for x in lines if x.mark in free]
    if not lines:
        return []
    content = cluster(levels(lines))
    within = _region([x for x, c in zip(lines, content, strict=True) if c] or lines, page)
    out: list[Line] = []
    region = [(x, c) for x, c in zip(lines, content.tolist(), strict=True) if within[x.element]]
    for links, group in groupby(region, lambda x: x[0].links > 0.5):
        run = list(group)
        # The threshold decides for a run as a whole, as its ends are raised by the lines beside it.
        if not (links and len(run) >= MENU_LINES and 2 * sum(c for _, c in run) < len(run)):
            out += [x for x, _ in run]
    return out


def extract(html: bytes) -> str:
    page = _Lines()
    page.feed(html.decode("utf-8", "replace"))
    page.close()
    return "\n".join(x.text for x in select(page))


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append content, the main text, and n_chars, its code points, to each row.

    Blocks are trimmed, with one blank for white space inside, and joined by line breaks in page order. A null or empty
    page, or one without text outside boilerplate, has empty content. Unclosed and wrongly closed tags are allowed for.
    Repeated rows each get their result; columns named content or n_chars are replaced; an empty table gives an empty one.
    """

    def make():
        def run(texts: list[bytes]) -> list[list]:
            out = [extract(t) for t in texts]
            return [out, [len(x) for x in out]]

        return run

    return map_text(pages, html_col, make, FIELDS, keep)


def main_texts(pages: DataFrame) -> DataFrame:
    return extract_text(pages, "html", ["page_id", "url"]).select("page_id", "url", F.col("content").alias("text"), "n_chars")
