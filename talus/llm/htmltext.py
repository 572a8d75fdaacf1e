"""Operator 9: main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks in a tree of elements. A linear
classifier over a block's own features (length, sentence marks, share of linked
text, tag), the page's regions (how much of all text an element holds, whether
the page has a main part and the block stands in it) and the names of its
elements gives the cost of calling the block boilerplate rather than content;
these are the capacities to the two terminals. Neighbouring blocks and blocks
of one DOM parent or grandparent are tied by smoothness edges, which are of the
same order as the costs, so that a short or doubtful block goes with its
surroundings. The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import map_batches, table

SCHEMA = "page_id long, url string, text string, n_chars long"

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NONE = re.compile(r"display\s*:\s*none")

# Element names by role.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "select"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "noscript", "object", "ol", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag of the key ends an open element of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
#: Log odds for content (above 0) of standing inside an element.
REGION = {
    "nav": -6.0, "menu": -5.0, "aside": -5.0, "footer": -6.0, "form": -4.0, "dialog": -5.0, "head": -30.0, "button": -5.0,
    "fieldset": -1.0, "header": -4.0, "noscript": -4.0,
}
#: Regions that may wrap a whole page: they count only if they hold less than MOST of its text.
WRAPPERS = {"form", "fieldset", "header", "aside", "dialog", "menu", "noscript"}
#: Log odds of a block's own element.
OWN = {
    "p": 0.5, "h1": 1.5, "h2": 1.0, "h3": 0.6, "h4": 0.4, "blockquote": 0.5, "pre": 0.5, "li": -0.3, "td": -0.2,
}
#: Words that name boilerplate if a class or id is made of them and of layout words only; else they weigh little.
BOILERPLATE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "discussion", "footer", "gdpr", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "alert", "pagination", "pager", "popup", "promo",
    "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget",
    "widgets", "complementary", "contentinfo", "announcement", "copyright", "disclaimer", "feedback", "overlay", "toast",
}
LAYOUT = {
    "area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "form",
    "group", "holder", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post",
    "posts", "right", "row", "section", "site", "slot", "text", "thread", "top", "wrap", "wrapper", "policy", "media", "icons",
}
#: Words that alone say little.
DOUBTFUL = {"links", "toc", "side", "legal", "rail", "skip", "form", "cta", "aside"}
GOOD = {"article", "body", "content", "entry", "main", "post", "story", "text"}
#: Such words in a name say that the rest of it is about something else in the page.
NEGATING = {"with", "has", "no", "without", "hide"}
STRONG, WEAK, KIND = -7.0, -0.8, 0.5
_PHRASE = re.compile(
    r"(?i)^(©|\(c\)\s|copyright\b|all rights reserved|advertisement\b|sponsored\b|subscribe\b|sign (up|in)\b|log in\b"
    r"|share (this|on)\b|we use cookies|accept (all )?cookies|read more\b|leave a (comment|reply)\b)"
)
#: Headings of reader comments; what follows them under the same parent is theirs, up to a heading of the same rank.
_COMMENTS = re.compile(
    r"(?i)^(\d+\s+)?((reader|user|all|your|recent)\s+)?(comments?|responses?|replies|discussion|(leser)?kommentare?|kommentar(e|bereich)|commentaires?|comentarios?|commenti|reacties)"
    r"(\s*\(?\d+\)?)?\s*:?$"
)
MAIN, OUTSIDE, MOST = 1.5, -4.0, 0.6
#: A block is out of question below this cost of its regions and names; the best of the others is content by at least LEAST.
OUT, LEAST = -3.0, 1.0
ADJACENT, SAME_PARENT, SAME_GRANDPARENT = 0.4, 0.8, 0.3


@dataclass(slots=True)
class Element:
    tag: str
    parent: int  # place in the list of elements; -1: none
    strong: bool  # a name made of boilerplate words
    weak: bool  # a name that holds one
    kind: bool  # a name that speaks for content
    hidden: bool
    chars: int = 0  # of the text below


@dataclass(slots=True)
class Block:
    text: str
    element: int  # -1: none
    linked: float


def named(tag: str, attrs: str, parent: int) -> Element:
    out = Element(tag, parent, False, False, False, False)
    if not attrs or tag in ("html", "body"):
        return out
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for part in value.split():
                words = {w.lower() for w in _WORD.findall(part)}
                if words & NEGATING:
                    continue
                if words & BOILERPLATE:
                    if words <= BOILERPLATE | LAYOUT:
                        out.strong = True
                    else:
                        out.weak = True
                elif words & DOUBTFUL:
                    out.weak = True
                elif words & GOOD:
                    out.kind = True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _NONE.search(value)):
            out.hidden = True
    return out


class Tags:
    """Ends of tags, in time proportional to the page whatever its quotes are like."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.waste = 4 * len(page) + 1000

    def end(self, at: int) -> int:
        """Place after the tag that opens at ``at``; a tag that is never closed ends before the next one."""
        page = self.page
        if self.last[">"] < at:
            after = page.find("<", at + 1)
            return after if after >= 0 else len(page)
        i = at
        while self.waste > 0:
            m = _STOP.search(page, i)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            if self.last[m[0]] <= m.start():
                i = len(page)
                break
            i = page.find(m[0], m.end()) + 1
            if self.last[">"] < i:
                break
        self.waste -= i - at
        return page.find(">", at) + 1


def parsed(page: str) -> tuple[list[Element], list[Block]]:
    """The elements of a page that make blocks and its text blocks in order, whatever its markup is like."""
    elements: list[Element] = []
    blocks: list[Block] = []
    stack: list[int] = []
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()
    words: list[str] = []
    tags, at, end = Tags(page), 0, len(page)
    link, linked, total = False, 0, 0

    def flush() -> None:
        nonlocal linked, total
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            top = stack[-1] if stack else -1
            if text and not (top >= 0 and elements[top].hidden):
                blocks.append(Block(text, top, linked / max(total, 1)))
            words.clear()
        linked = total = 0

    def close(tag: str) -> None:
        while stack:
            gone = elements[stack.pop()].tag
            open_tags[gone] -= 1
            if gone == tag:
                return

    while at < end:
        start = page.find("<", at)
        stop = start if start >= 0 else end
        if stop > at:
            words.append(page[at:stop])
            total += stop - at
            linked += stop - at if link else 0
        if start < 0:
            break
        if page.startswith("<!--", start):
            after = page.find("-->", start + 4)
            at = after + 3 if after >= 0 else end
            continue
        if page.startswith(("<!", "<?"), start):
            after = page.find(">", start)
            at = after + 1 if after >= 0 else end
            continue
        m = _NAME.match(page, start)
        if m is None:
            words.append("<")
            at = start + 1
            continue
        at = tags.end(start)
        tag, attrs = m[1].lower(), page[m.end() : at]
        if page.startswith("</", start):
            if tag == "a":
                link = False
            if tag in BLOCKS:
                flush()
                link = False
                if open_tags[tag]:
                    close(tag)
            continue
        if tag in RAW:
            words.append(" ")
            if tag not in unclosed:
                m = re.compile(f"</{tag}", re.I).search(page, at)
                if m is None:
                    unclosed.add(tag)
                    at = end if tag in ("script", "style") else at
                else:
                    at = tags.end(m.start())
            continue
        if tag == "a":
            link = True
        if tag == "br":
            words.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if tag == "hr" or attrs.endswith("/>"):
            continue
        if stack and elements[stack[-1]].tag == "p":
            close("p")
        while stack and elements[stack[-1]].tag in CLOSES.get(tag, ()):
            close(elements[stack[-1]].tag)
        parent = stack[-1] if stack else -1
        e = named(tag, attrs.rstrip(">"), parent)
        e.hidden |= parent >= 0 and elements[parent].hidden
        stack.append(len(elements))
        elements.append(e)
        open_tags[tag] += 1
    flush()
    return elements, blocks


def costs(elements: list[Element], blocks: list[Block]) -> list[float]:
    """Classifier: how much more it costs to call each block boilerplate than content (log odds)."""
    for b in blocks:
        if b.element >= 0:
            elements[b.element].chars += len(b.text)
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].chars += e.chars
    whole = max(1, sum(len(b.text) for b in blocks))
    below: list[float] = []  # cost of standing in each element
    inside: list[bool] = []  # of a main part
    names: list[float] = []  # the share of names in it
    for e in elements:
        up = e.parent
        cost, main, name = (below[up], inside[up], names[up]) if up >= 0 else (0.0, False, 0.0)
        most = e.chars > MOST * whole
        if e.tag in ("article", "main"):
            main = True
        elif e.tag == "header" and main:
            cost -= 0.3
        elif e.tag == "noscript" and main:
            cost -= 0.5  # often the text of something that a script would load
        elif not (most and e.tag in WRAPPERS):
            cost += REGION.get(e.tag, 0.0)
        if e.strong:
            name += WEAK if most or (e.tag == "header" and main) or e.tag in ("h1", "h2") else STRONG
        elif e.weak:
            name += WEAK
        elif e.kind:
            name += KIND
        below.append(cost)
        inside.append(main)
        names.append(min(1.0, max(-12.0, name)))
    ruled = sum(len(b.text) for b in blocks if b.element >= 0 and inside[b.element] and below[b.element] > -3) > 0.4 * sum(
        len(b.text) for b in blocks if b.element < 0 or below[b.element] > -3
    )
    out, asked = [], []
    comments = commented(elements, blocks)
    for k, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        s = 0.7 * math.log1p(n) - 1.8 + 0.35 * min(3, sum(map(b.text.count, ".!?;:")))
        s -= 4.0 * b.linked if b.linked > 0.3 else 0.0
        main = b.element >= 0 and inside[b.element]
        if b.element >= 0:
            s += OWN.get(elements[b.element].tag, 0.0) + below[b.element] + names[b.element]
        if main:
            s += MAIN
        elif ruled:
            s += OUTSIDE
        phrase = n < 25 and _PHRASE.match(b.text)
        if phrase:
            s -= 2.0 if main else 4.0
        if comments[k]:
            s += STRONG
        out.append(s)
        placed = below[b.element] + names[b.element] if b.element >= 0 else 0.0
        if placed > OUT and b.linked <= 0.3 and not phrase and not comments[k] and (main or not ruled):
            asked.append(k)
    # length counts against the page's own blocks: where all are short, short ones are the article
    lift = LEAST - max((out[k] for k in asked), default=LEAST)
    if lift > 0:
        for k in asked:
            out[k] += lift
    return out


def commented(elements: list[Element], blocks: list[Block]) -> list[bool]:
    """Which blocks stand under a heading of reader comments (the heading too)."""
    out = [False] * len(blocks)
    over: list[tuple[int, str]] = []  # parent and rank of the headings that hold
    for k, b in enumerate(blocks):
        if b.element < 0:
            continue
        up, chain = b.element, set()
        while up >= 0 and over:
            chain.add(up)
            up = elements[up].parent
        over = [(p, rank) for p, rank in over if p in chain]
        tag, parent = elements[b.element].tag, elements[b.element].parent
        if tag in ("h2", "h3", "h4", "h5", "h6"):
            over = [(p, rank) for p, rank in over if not (p == parent and tag <= rank)]
            if parent >= 0 and _COMMENTS.match(b.text):
                over.append((parent, tag))
        out[k] = bool(over)
    return out


def min_cut(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: source side) of the least cut; ``unary`` above 0 ties a node to the source.

    Flow is pushed from each source node along shortest residual paths to the
    next node with room to the sink. Nodes from which no such path is left
    are source side for good, so that a vain search is paid once.
    """
    n = len(unary)
    cap: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        cap[i][j] = cap[i].get(j, 0.0) + w
        cap[j][i] = cap[j].get(i, 0.0) + w
    left, label = list(unary), [False] * n
    for start in range(n):
        while left[start] > 1e-9 and not label[start]:
            came, queue, goal = {start: start}, [start], -1
            for x in queue:
                for y, c in cap[x].items():
                    if c > 1e-9 and y not in came and not label[y]:
                        came[y] = x
                        queue.append(y)
                        if left[y] < -1e-9:
                            goal = y
                            break
                if goal >= 0:
                    break
            if goal < 0:
                for x in queue:
                    label[x] = True
                break
            path, y = [], goal
            while y != start:
                path.append((came[y], y))
                y = came[y]
            f = min(left[start], -left[goal], min(cap[a][b] for a, b in path))
            left[start] -= f
            left[goal] += f
            for a, b in path:
                cap[a][b] -= f
                cap[b][a] += f
    return label


def smoothness(elements: list[Element], blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbouring blocks and between successive blocks of one parent and of one grandparent."""
    edges: dict[tuple[int, int], float] = {}
    seen: dict[tuple[int, int], int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = ADJACENT
        own = b.element
        if own < 0:
            continue
        parent = elements[own].parent
        # text that stands beside elements belongs to the parent of these
        for level, k, w in ((0, own, SAME_PARENT), (0, parent, SAME_PARENT), (1, elements[parent].parent if parent >= 0 else -1, SAME_GRANDPARENT)):
            if k < 0:
                continue
            j = seen.get((level, k))
            if j is not None:
                edges[j, i] = edges.get((j, i), 0.0) + w
            seen[level, k] = i
    return edges


def labelled(page: str | None) -> tuple[list[Block], list[float], list[bool]]:
    """Blocks of a page, their costs and whether the minimum cut makes them content."""
    elements, blocks = parsed(page or "")
    unary = costs(elements, blocks)
    return blocks, unary, min_cut(unary, smoothness(elements, blocks))


def main_text(page: str | None) -> str:
    """The main text of a page: content blocks joined by line feeds; "" if there is none."""
    blocks, _, keep = labelled(page)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page row.

    Left out before any labelling: the contents of script, style, title,
    template, textarea, select and iframe elements, comments, declarations,
    and elements that are hidden by attribute; all other text is in a block
    and is kept or not by the minimum cut. Pages of any length are read whole
    in linear time, broken markup too: an unclosed quote or tag is markup, not
    text. Null and empty pages give an empty text; null ids are kept; repeated
    rows are extracted as often as they occur; an empty table gives no rows;
    columns besides page_id, url and html are ignored.
    """

    def make():
        def of(batch):
            text = [main_text(h) for h in batch["html"].to_pylist()]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]}

        return of

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, SCHEMA)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
