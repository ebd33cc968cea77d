"""Main text of web pages by tag-path ratios.

Method: a page's text blocks are grouped by their root-to-leaf tag path. Each path gets the mean length of its
blocks and their mean number of punctuation marks, links not counted; the two are fused, smoothed over neighbouring
blocks in page order, averaged over the path, and paths above a threshold are content. The deepest element that holds
most of the content's text is its container; a container below the page's body is taken whole, so that short
headings and paragraphs between long ones stay, and of the body only what stands from the first to the last content
block, with the headings right before it, or from an only h1. No element is content for its name.

Before that, what markup itself says to be a menu, header, footer, sidebar, notice, advert, form or reader comment (by
element or role) is left out of what may be chosen; it still counts in its path's ratios. A class or id says so only of an element that holds
paragraphs and has less than half of the page's text; names of paragraphs and headings themselves say nothing. Blocks that are
links for the most part, and copyright lines after the content, go.

Null or empty html: empty text. Null or repeated page_id, repeated rows and extra columns: each row is a page of
its own. Broken or cut-off markup is read as far as it goes. Empty table: empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, need

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style title textarea noscript template iframe svg head object canvas select button math".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
APART = frozenset("nav footer aside form dialog menu".split())
#: Parts of class and id names, and roles, of what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus foot footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted promotion recommendations recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription topbar toolbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Elements that hold one paragraph of the content and are no container of it.
LEAVES = frozenset("p li td th dd dt pre blockquote h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these kinds, up to the container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag. A quote begins a value only after =, and without a closing quote it is a character as any other.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+>""")
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


@dataclass
class Node:
    tag: str
    parent: int
    path: str
    apart: bool = False
    named: bool = False
    holds_article: bool = False


@dataclass
class Block:
    node: int
    text: str
    linked: int
    score: float = field(default=0.0)


def _tag_end(page: str, at: int) -> int:
    """The place after the > that ends a tag; one inside a quoted value doesn't, if the quote is closed. -1 if there is none."""
    m = REST.match(page, at)
    return m.end() if m else -1


def _apart(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether the markup itself sets an element apart, and whether only a part of its class or id does. Names of paragraphs say nothing."""
    if tag in APART or tag == "header" and not in_article:
        return True, False
    if not attributes or tag in ("html", "body", "main", "article"):
        return False, False
    named = False
    for m in NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in ROLES or key == "hidden" and not value or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        named |= key in ("class", "id") and tag not in LEAVES and bool(NAMES & set(re.split(r"[^a-z0-9]+", value)))
    return False, named


def set_apart(nodes: list[Node], blocks: list[Block]) -> None:
    """Passes on what sets elements apart to what they hold. A name does so only where the element has less than half of the page's text."""
    own: dict[int, int] = defaultdict(int)
    for b in blocks:
        held = list(_up(nodes, b.node))
        if not any(nodes[k].apart for k in held):
            for k in held:
                own[k] += len(b.text) - b.linked
    for i, node in enumerate(nodes):
        if node.parent >= 0:
            node.apart |= nodes[node.parent].apart or node.named and 2 * own[i] < own[0]


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The elements and the text blocks in page order."""
    nodes, blocks = [Node("", -1, "")], []
    stack, links, hidden, articles = [0], 0, 0, 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            blocks.append(Block(owner[0], joined, min(linked, len(joined))))
        text.clear()
        linked = 0

    owner = [0]

    def close(n: int) -> None:
        nonlocal links, hidden, articles
        for i in stack[n:]:
            links -= nodes[i].tag == "a"
            hidden -= nodes[i].tag in HIDDEN
            articles -= nodes[i].tag in ("article", "main")
        del stack[n:]

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            said = entities.unescape(raw)
            if not text and not said.strip():  # white space before a block's first word
                return
            if not text:
                owner[0] = stack[-1]
            text.append(said)
            linked += len(said) * bool(links)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:  # cut off inside a tag
            break
        tag = m[2].lower()
        at = end
        if m[1]:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                say(" ")
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag == tag:
                    close(k)
                    break
                if open_tag in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        attributes = page[m.end() : end - 1]
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                open_tag = nodes[stack[k]].tag
                if open_tag == "p":
                    close(k)
                    break
                if open_tag in BLOCKS:
                    break
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in stop:
                    break
                if open_tag in shut:
                    close(k)
                    break
        if attributes.endswith("/") and tag in ("svg", "path", "iframe"):
            continue
        up = stack[-1]
        named = re.search(r"""\bclass\s*=\s*["']?([\w-]+)""", attributes) if attributes else None
        nodes.append(Node(tag, up, f"{nodes[up].path}/{tag}{'.' + named[1] if named else ''}", *_apart(tag, attributes, articles > 0)))
        if tag in ("article", "main", "h1"):
            i = up
            while i > 0 and not nodes[i].holds_article:
                nodes[i].holds_article = tag != "h1"
                i = nodes[i].parent
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}", re.I).search(page, at)
            at = n if end is None else (_tag_end(page, end.end()) if _tag_end(page, end.end()) > 0 else n)
            continue
        stack.append(len(nodes) - 1)
        links += tag == "a"
        hidden += tag in HIDDEN
        articles += tag in ("article", "main")
    flush()
    return nodes, blocks


#: How much of a neighbour's ratio a block takes on.
NEAR = 0.25
COPYRIGHT = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)


def score(nodes: list[Node], blocks: list[Block]) -> None:
    """Sets each block's score: its path's fused ratios, smoothed over the blocks around it and averaged over the path."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b in blocks:
        s = sums[nodes[b.node].path]
        own = 1 - b.linked / len(b.text)
        s[0] += len(b.text) * own
        s[1] += len(PUNCTUATION.findall(b.text)) * own
        s[2] += 1
    ratio = {p: (a / n, c / n) for p, (a, c, n) in sums.items()}
    fused = [math.sqrt(ratio[p][0] * (1 + ratio[p][1])) for p in (nodes[b.node].path for b in blocks)]
    total = defaultdict(lambda: [0.0, 0])
    for i, b in enumerate(blocks):
        around = fused[max(0, i - 1) : i] + fused[i + 1 : i + 2]
        t = total[nodes[b.node].path]
        t[0] += (fused[i] + NEAR * sum(around)) / (1 + NEAR * len(around))
        t[1] += 1
    for b in blocks:
        a, n = total[nodes[b.node].path]
        b.score = a / n


def threshold(blocks: list[Block]) -> float:
    """The mean over characters, less their spread: most of a page's text stands in its content."""
    n = sum(len(b.text) for b in blocks)
    mean = sum(b.score * len(b.text) for b in blocks) / n
    spread = math.sqrt(sum((b.score - mean) ** 2 * len(b.text) for b in blocks) / n)
    return max(mean - spread, mean / 2)


def main_text(page: str | None) -> str:
    """The blocks of the main text in page order, joined by line breaks."""
    nodes, blocks = parse(page or "")
    set_apart(nodes, blocks)
    for node in nodes:  # a wrapper that only looks like a menu but holds the article is none
        up = nodes[node.parent] if node.parent >= 0 else None
        if node.apart and node.holds_article and not (up and up.apart and not up.holds_article):
            node.apart = False
    if not blocks:
        return ""
    score(nodes, blocks)
    blocks = [b for b in blocks if not _set_apart(nodes, b.node) and 5 * b.linked <= 4 * len(b.text)]
    if not blocks:
        return ""
    limit = threshold(blocks)
    content = [b for b in blocks if b.score >= limit]
    root = container(nodes, content)
    own = titled(nodes, blocks)
    root = root if own < 0 or _under(nodes, root, own) else own
    within = [i for i, b in enumerate(blocks) if _under(nodes, b.node, root)]
    first, last = within[0], within[-1]
    if nodes[root].tag in ("", "html", "body"):
        first, last = _span(nodes, blocks, limit)
    while first and re.fullmatch("h[1-6]", nodes[blocks[first - 1].node].tag):
        first -= 1
    return "\n".join(b.text for i, b in enumerate(blocks[first : last + 1], first) if i < within[0] or _under(nodes, b.node, root))


def _span(nodes: list[Node], blocks: list[Block], limit: float) -> tuple[int, int]:
    """From the first content block, or an only h1 between content, to the last one that is no copyright line."""
    at = [i for i, b in enumerate(blocks) if b.score >= limit]
    first, last = at[0], at[-1]
    titles = [i for i, b in enumerate(blocks) if nodes[b.node].tag == "h1"]
    if len(titles) == 1 and first < titles[0] < last:
        first = titles[0]
    while last > first and COPYRIGHT.match(blocks[last].text):
        last -= 1
    return first, last


def _up(nodes: list[Node], i: int) -> Iterator[int]:
    while i >= 0:
        yield i
        i = nodes[i].parent


def _set_apart(nodes: list[Node], i: int) -> bool:
    """Set apart by an element above it, unless that one holds the article and this is inside the article."""
    for k in _up(nodes, i):
        if nodes[k].apart and (nodes[k].parent < 0 or not nodes[nodes[k].parent].apart):
            return not nodes[k].holds_article
        if nodes[k].tag == "header" and not nodes[i].tag.startswith("h"):
            return True
    return False


def _under(nodes: list[Node], i: int, root: int) -> bool:
    return any(k == root for k in _up(nodes, i))


def container(nodes: list[Node], content: list[Block], share: float = 0.8, most: float = 0.5) -> int:
    """The deepest element that holds ``share`` of the content's text, or ``most`` of it where the rest has lower scores."""
    weight: dict[int, int] = defaultdict(int)
    for b in content:
        for k in _up(nodes, b.node):
            weight[k] += len(b.text)
    root, total = 0, weight[0]
    while True:
        inner = [k for k in weight if nodes[k].parent == root and weight[k] >= most * total and nodes[k].tag in BLOCKS and nodes[k].tag not in LEAVES]
        best = max(inner, key=weight.__getitem__, default=-1)
        if best < 0 or weight[best] < share * total and not _by_itself(nodes, content, root, best):
            return root
        root, total = best, total if weight[best] >= share * total else weight[best]


def titled(nodes: list[Node], blocks: list[Block]) -> int:
    """The element around an only h1 and the text nearest to it, if that text's path has at least half of the best score; else -1."""
    titles = [b for b in blocks if nodes[b.node].tag == "h1"]
    if len(titles) != 1:
        return -1
    for k in _up(nodes, nodes[titles[0].node].parent):
        if nodes[k].tag in ("", "html", "body"):
            return -1
        text = [b.score for b in blocks if not re.fullmatch("h[1-6]", nodes[b.node].tag) and _under(nodes, b.node, k)]
        if text:
            return k if 2 * max(text) >= max(b.score for b in blocks) else -1
    return -1


def _by_itself(nodes: list[Node], content: list[Block], root: int, inner: int) -> bool:
    """Whether all the rest of the content stands on paths with lower scores than the inner element's text has."""
    sums, rest = [0.0, 0], 0.0
    for b in content:
        held = list(_up(nodes, b.node))
        if inner in held:
            sums[0] += b.score * len(b.text)
            sums[1] += len(b.text)
        elif root in held:
            rest = max(rest, b.score)
    return rest < sums[0] / max(sums[1], 1)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(text=[main_text(x) for x in batch["html"]]).drop(columns="html")


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    need(pages, page_id, url, html)
    rows = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = kept(rows.mapInPandas(_extract, "page_id string, url string, text string"), "pages", batch=64)
    return out.select(F.col("page_id").cast(pages.schema[page_id].dataType).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
