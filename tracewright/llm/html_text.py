"""Main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import map_columns

WINDOW = 3  # lines of a window
SURGE = 80  # characters of a window at which text surges

# A tag ends at the first > outside quoted values, or, where quotes don't close or there are hundreds, at the first > at all.
# Possessive throughout, so no text is read more than twice from one place.
MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
    |<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+'){0,512}+(?=>)|[^>]*+(?=>))>
    |<[!?][^>]*+>
    |<[a-zA-Z/!][^>]*+\Z""",
    re.S | re.I | re.X,
)
NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")

# Elements that end a line, that hold no article text, that are empty, and that hold the article.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead tr ul""".split()
)
ASIDE = frozenset("aside button dialog footer form head header menu nav select fieldset object embed canvas audio video map".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Words of class, id or role that mark something beside the article.
BESIDE = frozenset(
    """ad ads adslot advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist
    consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation navigationbar
    newsletter notice notices notification pagination pager popup promo promoted promotion recommended related search share sharing
    sidebar signup social sponsor sponsored subscribe subscription toolbar widget complementary reply replies respond alertdialog""".split()
)
NEVER_BESIDE = frozenset("html body main article".split())


def _beside(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    words = [w for m in NAMED.finditer(attributes) if m[1].lower() != "itemprop" for w in PARTS.findall((m[2] or m[3] or m[4] or "").lower())]
    if tag == "article":
        return any(w in ("comment", "comments", "reply", "replies", "advert", "ad", "sponsored", "promo") for w in words)
    return tag not in NEVER_BESIDE and any(w in BESIDE for w in words)


def _main(tag: str, attributes: str) -> bool:
    if tag in MAIN:
        return True
    return any(
        (m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) in (("role", "main"), ("itemprop", "articlebody"))
        for m in NAMED.finditer(attributes)
    )


def lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside the article element) of every block of text, without markup.

    Elements beside the article (menus, headers, footers, forms, adverts,
    notices, comments and the like, by element or by their class, id or role)
    are stripped with their content. Character references are decoded and white
    space is one space.
    """
    out, held = [], []
    skip: list[str] = []  # open elements of one beside the article, outermost first
    main: list[str] = []  # open elements of the article, outermost first
    links = linked = at = 0

    def close():
        nonlocal linked
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append((text, max(0, len(text) - linked), bool(main)))
        held.clear()
        linked = 0

    for m in MARKUP.finditer(html):
        if not skip and m.start() > at:
            held.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        attributes = m["rest"]
        if skip:
            if tag == skip[-1] and m["close"]:
                skip.pop()
            elif tag == skip[0] and not m["close"] and tag not in EMPTY:
                skip.append(tag)
            elif tag in MAIN and not m["close"] and skip[0] in ("div", "section", "p", "span", "ul", "li"):
                skip.clear()  # an element that was never closed
            elif not m["close"] and (tag == "body" or skip[0] == "p" and tag in BLOCKS) or m["close"] and skip[0] == "p" and tag in BLOCKS:
                skip.clear()  # ended by what follows
            if skip or m["close"]:
                continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            close()
        if m["close"]:
            if main and tag == main[-1]:
                close()
                main.pop()
            if tag == "a":
                links = max(0, links - 1)
            continue
        if tag in EMPTY:
            continue
        if _beside(tag, attributes):
            close()
            skip.append(tag)
        elif main and tag == main[0] or not main and _main(tag, attributes):
            close()
            main.append(tag)
        elif tag == "a":
            links += 1
    if not skip and at < len(html):
        held.append(html[at:])
    close()
    return out


def surge_and_dive(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """First and last line (exclusive) of the text: from where window sums surge to where the last of them dives to nothing.

    The sum over the ``window`` lines from i on must exceed ``surge`` at the
    surge; the text ends at the last line of a window that still exceeds it.
    """
    if not weights:
        return 0, 0
    sums = np.convolve(np.array(weights, np.int64), np.ones(window, np.int64))[window - 1 :]
    high = np.flatnonzero(sums > surge)
    if not len(high):
        return 0, 0
    start, last = int(high[0]), int(high[-1])
    held = [i for i in range(start, min(len(weights), last + window)) if weights[i]]
    return held[0], held[-1] + 1


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First and last line (exclusive) of every stretch of text: the lines of consecutive windows over ``surge``.

    Lines that weigh nothing are left out at both ends of a stretch. The first
    start and the last end are those of :func:`surge_and_dive`.
    """
    if not weights:
        return []
    weighed = np.array(weights, np.int64)
    high = np.convolve(weighed, np.ones(window, np.int64))[window - 1 :] > surge
    covered = np.convolve(high, np.ones(window, np.int64))[: len(weights)] > 0
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    out = []
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        held = np.flatnonzero(weighed[first:last])
        if len(held):
            out.append((first + int(held[0]), first + int(held[-1]) + 1))
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Blocks of the article joined by an empty line.

    A line weighs its characters outside links. Where the page names its article
    (an article or main element, role main), that is a hint: lines that are
    mostly links weigh nothing, of the lines in stretches between surge and dive
    those inside it stay, and so do lines inside it that lie in no stretch but
    are not mostly links.
    """
    found = lines(html or "")
    weights = [weight for _, weight, _ in found]
    if any(inside for _, _, inside in found):
        own = [weight if 2 * weight >= len(text) else 0 for text, weight, _ in found]
        in_stretch = {i for first, last in stretches(own, window, surge) for i in range(first, last)}
        kept = [text for i, (text, _, inside) in enumerate(found) if inside and (own[i] or i in in_stretch)]
        return "\n\n".join(kept)
    first, last = surge_and_dive(weights, window, surge)
    return "\n\n".join(text for text, _, _ in found[first:last])


def extract(
    pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", *, window: int = WINDOW, surge: int = SURGE
) -> DataFrame:
    """``keep`` columns and text of every row of ``pages``, from its whole html.

    Null html, and pages without text, give an empty text. Repeated rows and
    null ids stay; other columns are ignored; an empty table gives no rows.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string"
    return map_columns(
        pages.select(*keep, F.col(html_col)),
        schema,
        lambda columns: [*columns[:-1], [main_text(h, window, surge) for h in columns[-1]]],
    )
