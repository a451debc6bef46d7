"""Main text of web pages from flat text blocks.

A page is cut into a flat list of text blocks at block-level tags. Each block is
described by its words, its link density, both also for the blocks before and
after it, whether it is a heading, and what kind of container it stands in; a
decision tree (CART, Gini) grown here on the small labelled table LABELLED
decides which blocks are article text.

The scanner is linear in the page: a tag ends at the next '<' outside quotes at
the latest, and is text then.

Defined results: null html is empty; a page without article blocks gives an
empty text; equal pages give equal texts; broken markup (unclosed or stray tags,
unended comments) is read as far as it goes; ``extract`` leaves the html column
out and puts the text in the column named for it, in the place of an old one of
that name; all other columns pass through untouched; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, importable

# fixed values: HTML element names by their role
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video title textarea select option button datalist".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: containers whose class, id or role names one of these hold no article text
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|menu|nav\w*|breadcrumbs?|sidebar|side|widget|footer|header|masthead"
    r"|social|share|sharing|related|recommend\w*|comments?|disqus|replies|reply|respond|pagination|pager|search|toolbar|copyright|legal|disclaimer|complementary|contentinfo|navigation)(?:$|[\s_-]|\d)", re.I)  # fmt: skip
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ENDLESS = re.compile(r"<!--|<!\[CDATA\[")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "boilerplate", "article")


def blocks(page: str | None) -> list[tuple[str, int, float, bool, bool, bool]]:
    """(text, words, link density, heading, in boilerplate, in an article) of each block."""
    page = page or ""
    out: list[tuple[str, int, float, bool, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open containers; whether each holds boilerplate
    named: Counter[str] = Counter()  # and how many of each name
    state = {"link": 0, "heading": False, "bad": 0, "article": 0}
    parts: list[str] = []
    linked: list[str] = []

    def end() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                n = text.count(" ") + 1
                own = len("".join(linked).split())
                out.append((text, n, min(1.0, own / n), state["heading"], state["bad"] > 0, state["article"] > 0))
            parts.clear()
            linked.clear()

    def text(a: int, b: int) -> None:
        if a < b:
            parts.append(page[a:b])
            if state["link"]:
                linked.append(page[a:b])

    # behind the last '>' there is no tag, and a comment without end has the rest
    at, last = 0, page.rfind(">") + 1
    while m := PIECE.search(page, at, last):
        text(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            if at == last and ENDLESS.match(m[0]) and not m[0].endswith(("-->", "]]>")):
                at = len(page)
            continue
        name = name.lower()
        if name in SKIPPED and not m[1]:
            if m[3].rstrip().endswith("/") and name in ("svg", "object"):
                continue
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in SKIPPED:
            continue
        if name == "a":
            state["link"] = 0 if m[1] else 1
        if name in INLINE and not (name == "span" and not m[1] and (MARKED.search(_names(m[3])) or HIDDEN.search(m[3]))):
            continue
        end()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in HEADINGS:
            state["heading"] = not m[1]
            continue
        if name == "p":
            state["heading"] = False
            if not m[3]:
                continue
        if m[1]:
            if named[name]:
                while stack:
                    k, bad = stack.pop()
                    named[k] -= 1
                    state["bad"] -= bad
                    state["article"] -= k in ARTICLE
                    if k == name:
                        break
            state["link"] = 0
            continue
        # a header inside an article is the article's own, with its title
        bad = (name in BOILERPLATE and not (name == "header" and state["article"])) or bool(m[3]) and name not in ("body", "html", *ARTICLE) and bool(MARKED.search(_names(m[3])) or HIDDEN.search(m[3]))
        if name == "p" and not bad:
            continue
        stack.append((name, bad))
        named[name] += 1
        state["bad"] += bad
        state["article"] += name in ARTICLE
    rest = ENDLESS.search(page, at)
    text(at, rest.start() if rest else len(page))
    end()
    return out


def _names(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if attributes else ""


def features(found: list[tuple]) -> np.ndarray:
    """A row of FEATURES per block."""
    none = ("", 0, 0.0)
    rows = []
    for i, (_, n, links, heading, bad, article) in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        rows.append((n, links, before[1], before[2], after[1], after[2], heading, bad, article))
    return np.asarray(rows, "f8").reshape(-1, len(FEATURES))


#: The labelled table: a block's FEATURES, then 1 for article text.
LABELLED = np.asarray([
    # navigation, menus and link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0, 1, 0, 0), (4, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0), (6, 0.8, 4, 1.0, 5, 1.0, 0, 0, 0, 0), (9, 0.9, 60, 0.0, 8, 1.0, 0, 0, 0, 0), (5, 1.0, 40, 0.0, 5, 1.0, 0, 1, 1, 0),
    (3, 1.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0), (12, 0.9, 30, 0.0, 0, 0.0, 0, 0, 0, 0), (7, 1.0, 55, 0.0, 60, 0.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 80, 0.0, 0, 0, 0, 0), (15, 0.8, 25, 0.0, 30, 0.0, 0, 0, 0, 0), (4, 0.75, 10, 0.0, 45, 0.0, 0, 0, 0, 0),
    (20, 1.0, 45, 0.0, 20, 0.0, 0, 0, 0, 0), (1, 1.0, 40, 0.1, 30, 0.0, 0, 0, 0, 0), (10, 0.7, 90, 0.0, 6, 0.0, 0, 0, 0, 0), (6, 1.0, 5, 0.0, 70, 0.0, 1, 0, 0, 0), (30, 0.9, 60, 0.0, 50, 0.0, 0, 0, 0, 0), (5, 0.8, 35, 0.0, 12, 0.0, 0, 0, 0, 0),
    # adverts, notices, sidebars, forms, comments: marked containers, whatever their length
    (12, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (35, 0.0, 50, 0.0, 60, 0.0, 0, 1, 1, 0), (80, 0.0, 70, 0.0, 4, 0.0, 0, 1, 0, 0), (6, 0.0, 30, 0.1, 7, 0.0, 1, 1, 0, 0), (25, 0.2, 3, 0.0, 30, 0.0, 0, 1, 1, 0), (150, 0.0, 20, 0.0, 15, 0.0, 0, 1, 1, 0),
    # page headers and footers
    (5, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (4, 0.0, 45, 0.0, 0, 0.0, 0, 1, 0, 0), (3, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0), (6, 0.5, 20, 0.0, 0, 0.0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0),
    (5, 0.0, 4, 1.0, 6, 1.0, 0, 0, 0, 0), (8, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0, 0),
    # paragraphs of an article element, short ones too
    (80, 0.0, 9, 0.0, 75, 0.0, 0, 0, 1, 1), (1, 0.0, 60, 0.0, 40, 0.0, 0, 0, 1, 1), (3, 0.0, 12, 0.0, 0, 0.0, 0, 0, 1, 1), (2, 0.0, 70, 0.0, 4, 0.0, 0, 0, 1, 1), (30, 0.3, 25, 0.0, 45, 0.1, 0, 0, 1, 1), (5, 1.0, 30, 0.0, 50, 0.0, 0, 0, 1, 1),
    (5, 1.0, 60, 0.0, 50, 0.0, 0, 0, 1, 1), (9, 0.9, 80, 0.1, 3, 0.0, 0, 0, 1, 1), (2, 1.0, 45, 0.0, 30, 1.0, 0, 0, 1, 1),
    (45, 0.0, 30, 0.0, 6, 0.0, 0, 0, 1, 1), (8, 0.0, 12, 0.0, 9, 0.0, 1, 0, 1, 1), (1, 0.0, 1, 1.0, 1, 0.0, 1, 0, 1, 1), (20, 0.0, 8, 0.0, 3, 0.0, 0, 0, 1, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1), (12, 0.0, 12, 0.0, 1, 0.0, 0, 0, 1, 1),
    # the same without an article element
    (80, 0.0, 20, 0.0, 6, 1.0, 0, 0, 0, 1), (50, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 1), (35, 0.1, 5, 1.0, 9, 0.9, 0, 0, 0, 1), (22, 0.0, 70, 0.0, 1, 1.0, 0, 0, 0, 1), (28, 0.4, 40, 0.0, 50, 0.0, 0, 0, 0, 1),
    (75, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0, 1), (40, 0.1, 50, 0.0, 35, 0.0, 0, 0, 0, 1), (25, 0.0, 30, 0.0, 28, 0.2, 0, 0, 0, 1), (60, 0.0, 1, 1.0, 4, 0.0, 0, 0, 0, 1), (18, 0.0, 45, 0.0, 70, 0.0, 0, 0, 0, 1), (33, 0.2, 3, 1.0, 40, 0.0, 0, 0, 0, 1),
    (9, 0.0, 4, 1.0, 80, 0.0, 1, 0, 0, 1), (7, 0.0, 60, 0.0, 55, 0.0, 1, 0, 0, 1), (5, 0.0, 60, 0.0, 65, 0.0, 0, 0, 0, 1), (3, 0.0, 70, 0.0, 45, 0.0, 0, 0, 0, 1), (120, 0.0, 0, 0.0, 5, 0.0, 0, 0, 0, 1),
], "f8")


def grow(rows: np.ndarray, depth: int = 6):
    """CART by Gini impurity: (feature, cut, below, above), or the leaf's class."""
    x, y = rows[:, :-1], rows[:, -1]
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = (share * (1 - share) * len(y) - 1e-9, None, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            below = x[:, f] < cut
            cost = sum(p.mean() * (1 - p.mean()) * len(p) for p in (y[below], y[~below]))
            if cost < best[0]:
                best = (cost, f, float(cut))
    _, f, cut = best
    if f is None:
        return int(share >= 0.5)
    below = x[:, f] < cut
    return (f, cut, grow(rows[below], depth - 1), grow(rows[~below], depth - 1))


def decide(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, cut, low, high = tree
    below = x[:, f] < cut
    out = np.zeros(len(x), bool)
    out[below], out[~below] = decide(low, x[below]), decide(high, x[~below])
    return out


_TREE = grow(LABELLED)


def main_text(page: str | None, tree=None) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = decide(_TREE if tree is None else tree, features(found))
    return " ".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """pages without html, with the main text of each."""
    importable(pages.sparkSession)
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(column):
        import pandas as pd

        return pd.Series([main_text(x) for x in column], dtype=object)

    made = fresh(pages, "ht_text")
    return pages.withColumn(made, text(F.coalesce(F.col(html), F.lit("")))).drop(html, to).withColumnRenamed(made, to)
