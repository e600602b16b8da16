"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass looks at each
block alone: the density of stop words, its length and the density of links.  It
decides good or bad where that is clear and leaves short blocks and blocks of
middling density open.  The second pass gives those the label of their nearest
decided neighbour.  Containers are one more input: what they set aside is bad and
says nothing about its neighbours; in an article element shorter blocks and more
links will do, and neighbours are looked for in the same article.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from concord.llm.common import set_up, slices, text_or_empty
from concord.llm.words import STOP_WORDS

# Element names of HTML by their role, and words that class, id and role use for what is not the article.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul""".split()
)
DROPPED = frozenset("applet audio button canvas datalist embed head iframe math noembed noframes noscript object option script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template".split())
ASIDE = frozenset("aside dialog footer form header menu nav".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo
    cookie cookies complementary copyright disclaimer disqus footer gdpr header hidden login masthead menu modal nav navbar navigation
    newsletter notice notices pager pagination popup promo promoted promotion recommended related reply respond search share sharing
    sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar widget widgets alert banners""".split()
)

# Words that only say where or what part of something an element is, and words before a hint that make it a layout's name.
PARTS = frozenset(
    """area bar body bottom box button buttons container content form group heading icon icons inner item items left link links list main
    outer overlay panel primary right row secondary section slot sticky text title top unit wrap wrapper""".split()
)
LAYOUT = frozenset("and has no with without".split())

#: Shortest block that is judged alone, and from where a good block is sure, in characters.
SHORT, LONG = 70, 200
#: Stop words per word, from which a block is good or open; link words per word, from which it is bad.
STOPS_HIGH, STOPS_LOW, LINKS = 0.20, 0.10, 0.33
#: In an article only blocks that are nearly all links go.
LINKS_IN_ARTICLE = 0.8

# a quote opens a value after = only, so that a > inside the value doesn't end the tag; nothing is tried twice
_TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|[!?/][^>]*>)""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_CLOSE = {name: re.compile(rf"</{name}\s*>?", re.IGNORECASE) for name in RAW}
GOOD, BAD, OPEN = 1, -1, 0


def _says_aside(name: str) -> bool:
    """Whether a class, id or role is a hint, ends in one, or is one with words for its parts: site-footer, sidebar-left; not with-sidebar, share-holders."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1] in PARTS and words[-1] not in HINTS:
        words.pop()
    return bool(words) and words[-1] in HINTS and not LAYOUT & set(words[:-1])


def _set_aside(attributes: str) -> bool:
    """Whether class, id, role or style say that an element isn't part of the article."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif name in ("class", "id", "role") and any(map(_says_aside, value.split())):
            return True
    return False


class _Block:
    __slots__ = ("text", "links", "aside", "article")

    def __init__(self, text: str, links: int, aside: bool, article: int):
        self.text, self.links, self.aside, self.article = text, links, aside, article


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, with white space folded and references decoded."""
    out: list[_Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # of open containers: name, set aside, number of the article or 0
    dropped: list[tuple[str, int]] = []  # open elements without text of the page: name, containers around it
    in_link = articles = article = 0
    aside = False

    def end_block():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(_Block(text, len(html.unescape(" ".join(linked)).split()), aside, article))
            parts.clear()
            linked.clear()

    def add(text):
        if text and not dropped:
            parts.append(text)
            if in_link:
                linked.append(text)

    at, size, last = 0, len(page), max(page.rfind(">"), page.rfind("<!--"))
    while at < size:
        found = _TAG.search(page, at) if at <= last else None
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        comment, closing, name, attributes = found.groups()
        if comment:
            close = page.find("-->", at)
            if page.startswith((">", "->"), at):
                at = page.index(">", at) + 1
            else:
                at = size if close < 0 else close + 3
            continue
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            if any(x[0] == name for x in dropped):
                while dropped.pop()[0] != name:
                    pass
            elif name in BLOCKS:
                end_block()
                in_link = 0
                if any(x[0] == name for x in stack):
                    while stack.pop()[0] != name:
                        pass
                    aside, article = stack[-1][1:] if stack else (False, 0)
                    # the end of a container is the end of what is open in it
                    while dropped and dropped[-1][1] > len(stack):
                        dropped.pop()
            continue
        if name in RAW:
            close = _CLOSE[name].search(page, at)
            at = close.end() if close else size
            continue
        if name == "br":
            add(" ")
        elif name in DROPPED:
            if name == "option" and dropped and dropped[-1][0] == "option":
                dropped.pop()
            if not attributes.rstrip().endswith("/") and name not in VOID:
                dropped.append((name, len(stack)))
        elif name == "body":
            end_block()
            dropped.clear()
        elif name in BLOCKS:
            end_block()
            in_link = 0
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                aside, article = stack[-1][1:] if stack else (False, 0)
            if name not in VOID and name not in ("html",):
                # an article's own header has its title
                aside = aside or (name in ASIDE and not (name == "header" and article)) or _set_aside(attributes)
                if name in ARTICLE and not any(x[0] == "article" for x in stack):
                    articles += 1
                    article = articles
                stack.append((name, aside, article))
        elif name not in VOID:
            if (dropped and dropped[-1][0] == name) or (attributes and _set_aside(attributes)):
                add(" ")
                dropped.append((name, len(stack)))
            if name == "a":
                in_link = 1
    end_block()
    return out


def _alone(block: _Block) -> int:
    """First pass: what a block is by itself."""
    words = block.text.split()
    links = block.links / len(words)
    if block.aside or links > (LINKS_IN_ARTICLE if block.article and len(words) > 1 else LINKS if not block.article else 1):
        return BAD
    if not block.article and ("\xa9" in block.text or (block.links and len(block.text) < SHORT)):
        return BAD
    stops = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_HIGH and len(block.text) >= (SHORT if block.article else LONG):
        return GOOD
    # text without links may be in a language whose stop words aren't known, or a table
    return OPEN if stops >= STOPS_LOW or block.article or not block.links or len(block.text) < SHORT else BAD


def _nearest(labels: list[int], tie: int) -> list[int]:
    """For each place the label of the nearest decided one; ``tie`` where two are as near and differ, open if there is none."""
    near = [(len(labels) + 1, OPEN)] * len(labels)
    for places in (range(len(labels)), reversed(range(len(labels)))):
        label, away = OPEN, 0
        for i in places:
            label, away = (labels[i], 0) if labels[i] else (label, away + 1)
            if label:
                near[i] = min(near[i], (away, label), key=lambda x: (x[0], x[1] != tie))
    return [label for _, label in near]


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by a line break; empty if there is none.

    An open block takes the label of the nearest decided block outside set-aside
    containers, in an article element of the good ones of that article; it is bad if there is none, but good in an article
    element.  An article element in which no block is good by itself goes, if another has one.
    Where the article elements hold most of the good text, what is
    outside them goes.  A page with neither an article element nor a good block
    gives the open blocks.
    """
    found = blocks(page or "")
    labels = [_alone(b) for b in found]
    sure = {b.article for b, label in zip(found, labels, strict=True) if label == GOOD and b.article}
    if sure:
        labels = [BAD if b.article and b.article not in sure else label for b, label in zip(found, labels, strict=True)]
    final = list(labels)
    for article in sorted({b.article for b in found}):
        # a list of links inside an article says nothing about what stands beside it
        body = [i for i, b in enumerate(found) if not b.aside and (not article or (b.article == article and labels[i] != BAD))]
        for i, near in zip(body, _nearest([labels[i] for i in body], GOOD if article else BAD), strict=True):
            if final[i] == OPEN and found[i].article == article:
                final[i] = near or (GOOD if article else BAD)
    if GOOD not in final and not any(b.article for b in found):
        final = [GOOD if label == OPEN else label for label in labels]
    good = [b for b, label in zip(found, final, strict=True) if label == GOOD]
    inside = sum(len(b.text) for b in good if b.article)
    if 2 * inside >= sum(len(b.text) for b in good) > 0:
        good = [b for b in good if b.article]
    return "\n".join(b.text for b in good)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, and text: the main text of each row's page.

    Null and empty pages have an empty text; repeated rows are extracted each;
    a table without rows gives none; other columns are ignored.  No shuffle.
    """
    set_up(pages.sparkSession)
    rows = pages.select(*[pages[c] for c in keep], text_or_empty(html_col).alias("_html"))
    schema = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep], "text string"])
    n = len(keep)

    def run(batches):
        for batch in batches:
            for some in slices(batch, n, 256):
                text = pa.array([main_text(h) for h in some.column(n).to_pylist()], type=pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns[:n], text], names=[*keep, "text"])

    return rows.mapInArrow(run, schema)
