"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags.  A linear classifier reads
each block's own text (length, punctuation, linked share, its tag) and each
container's role (its tag, and the word in its class or id that says what it is);
their log-odds are the capacities of the edges to the two terminals.  Smoothness
edges join blocks that follow each other, blocks with their container, and
containers that are near in the tree, the weaker the further.  The minimum cut
separates content from boilerplate.  No single cost settles a label: what a
block's text says is often overruled by its surroundings, and a container's name
by its text and what it stands in (``agreement`` counts how often).
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import runtime

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S,
)
LEGAL = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=", re.I)

# Tags of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
MATHEMATICS = frozenset("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd".split())
HIDDEN = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video map head title textarea select option".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: What a head can hold; anything else ends one whose end tag is left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: A new one of these closes an open one of the same set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Block tags that a paragraph can't hold.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# Tags, ARIA roles and words of classes and ids that tell what a container is for.
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT_ROLES = frozenset("main article".split())
AGAINST = frozenset("nav navbar navigation menu header masthead footer aside sidebar sidenav ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register form search share sharing social related recommended recommendation recommendations trending popular comment comments reply replies disqus respond discussion breadcrumb breadcrumbs pagination pager copyright legal disclaimer toolbar widget skip tags rail teaser outbrain taboola contentinfo complementary".split())
FOR = frozenset("article main content post entry story articlebody prose".split())
READERS = frozenset("comment comments reply replies".split())
#: Words that say nothing of their own at the end of a compound: the word before them names the role.
VAGUE = frozenset("area bar block body box button buttons col column container content div group holder inner item items left links list module outer panel posts right row section slot text top bottom unit widget wrap wrapper stories articles banner".split())
#: A compound that begins with one of these tells of a state or a layout.
STATES = frozenset("has with without no is not overflow hide show hidden js".split())
#: Tags that hold the text of one block, and parts of tables: blocks belong to what they are in.
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th tr tbody thead tfoot pre caption figcaption summary".split())
#: Attributes with one of these words are looked at one by one.
MAYBE_HIDING = re.compile(r"hidden|display", re.I)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|(?:content-)?visibility\s*:\s*hidden)\b", re.I)

#: Weights of a block's own text, and of its container's role; log-odds of content.  Set by hand: no labels of pages exist.
TEXT = {"start": -0.3, "linked": -1.6, "paragraph": 0.7, "heading": 0.1, "long": 1.0, "sentence": 0.5, "legal": -1.5}
ROLE = {"tag for": 3.0, "tag against": -4.0, "name for": 1.5, "name against": -3.0, "part against": -2.5, "inherited": 0.3}
#: Capacities of the edges from a block to the next, to its container (one with a role, one without), and from a container to the next ones.
NEXT, INSIDE, LOOSE, NEAR = 0.4, 2.4, 1.2, 0.8


#: Tags that don't end a block.
FLOWING = INLINE | MATHEMATICS | HIDDEN


@dataclass
class Container:
    """An element that holds blocks; ``role`` is its log-odds for each block that is directly in it."""

    number: int
    depth: int
    role: float
    above: Container | None


@dataclass
class Block:
    """A run of text without a block-level tag inside."""

    text: str
    container: Container
    tag: str
    linked: int
    size: int


@dataclass
class _Open:
    tag: str
    container: Container
    hidden: bool


def _named_role(name: str, inside: float) -> float:
    """What one class or id says: its last word that isn't vague counts, less in a compound."""
    words = [w.lower() for w in PART.findall(name)]
    if not words or words[0] in STATES:
        return 0.0
    told = list(words)
    while len(told) > 1 and told[-1] in VAGUE:
        told.pop()
    if told[-1] in AGAINST:
        if told[-1] == "header" and inside > 0:
            return 0.0  # an article's own heading
        return ROLE["name against"] if len(words) == 1 else ROLE["part against"]
    return ROLE["name for"] if told[-1] in FOR else 0.0


def _role(tag: str, attributes: str, inside: float) -> float:
    """A container's role from its tag, its ARIA role and its names; ``inside`` is that of what it is in."""
    told = 0.0
    if tag in CONTENT_TAGS:
        told = ROLE["tag for"]
    elif tag in BOILERPLATE_TAGS and not (tag == "header" and inside > 0):
        told = ROLE["tag against"]
    if attributes and NAMED.search(attributes):
        values: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        aria = values.get("role", "").strip().lower()
        if aria in BOILERPLATE_ROLES:
            told = ROLE["tag against"]
        elif aria in CONTENT_ROLES and not told:
            told = ROLE["tag for"]
        names = values.get("class", "").split() + values.get("id", "").split() + values.get("itemprop", "").split()
        each = [_named_role(n, inside) for n in names]
        against = min((x for x in each if x < 0), default=0.0)
        if tag == "article" and any(n.lower() in READERS for n in names):
            told = ROLE["part against"]  # an article in an article is how comments are marked up
        elif told > 0 and against:
            return inside  # tag and name disagree: as what it is in
        elif tag != "body" and not told:
            told = against or max(each, default=0.0)
    if not told:
        return inside
    return max(-4.0, min(4.0, told + ROLE["inherited"] * (inside if told > 0 else min(0.0, inside))))


def _hides(attributes: str) -> bool:
    """Whether a tag's attributes hide it: hidden, aria-hidden=true, or a style that does."""
    if not MAYBE_HIDING.search(attributes):
        return False
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of repeated ones the first counts
    if values.get("hidden", "false").strip().lower() != "false" or values.get("aria-hidden", "").strip().lower() == "true":
        return True
    return bool(HIDING_STYLE.search(html.unescape(values.get("style", ""))))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; markup errors are read leniently, a tag cut off at the end is dropped."""
    out: list[Block] = []
    stack = [_Open("", Container(0, 0, 0.0, None), False)]
    pieces: list[str] = []
    linked = counter = at = 0
    held: Counter[str] = Counter()  # open tags by name, so that a name that isn't open is not looked for

    def last(names: set[str]) -> int:
        """Place in the stack of the innermost of these tags, 0 if none is open."""
        if not any(held[n] for n in names):
            return 0
        return next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in names), 0)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            tag = next(o.tag for o in reversed(stack) if o.tag not in FLOWING)
            out.append(Block(text, stack[-1].container, tag, linked, len(text)))
        pieces.clear()
        linked = 0

    def close(k: int) -> None:
        if not stack[k - 1].hidden and any(o.tag not in FLOWING for o in stack[k:]):
            flush()
        held.subtract(o.tag for o in stack[k:])
        del stack[k:]

    def end_head() -> None:
        """Close an open head, unless its open part can hold anything."""
        k = last({"head"})
        if k and not any(o.tag in ("template", "noframes") for o in stack[k:]):
            close(k)

    def add(raw: str) -> None:
        nonlocal linked
        if stack[-1].tag == "head" and not raw.isspace() and raw:
            end_head()
        if raw and not stack[-1].hidden:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if held["a"] > 0:
                linked += len(text.strip())

    while True:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            k = last({tag})
            # an inline tag's end doesn't reach out of its block
            if k and not (tag in INLINE and any(o.tag not in INLINE for o in stack[k:])):
                close(k)
            continue
        if held["head"] and tag not in IN_HEAD:
            end_head()
        if tag == "br":
            pieces.append(" ")
            continue
        unseen = stack[-1].hidden
        if tag not in FLOWING and not unseen:
            flush()
        if tag in ENDS_P and not unseen:
            k = last({"p"})
            if k:
                close(k)
        if tag in CLOSES and last(CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "body"):
                    break
        if tag in VOID:
            continue
        counter += 1
        held[tag] += 1
        top = stack[-1]
        hidden = top.hidden or tag in HIDDEN or bool(attributes and _hides(attributes))
        within = top.container
        if tag not in FLOWING:
            role = _role(tag, attributes, within.role)
            if tag not in LEAVES or role != within.role:
                within = Container(counter, within.depth + 1, role, within)
        stack.append(_Open(tag, within, hidden))
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                at = end.start()
    flush()
    return out


def log_odds(block: Block) -> float:
    """The classifier's log-odds that a block is content, from its own text alone."""
    w = TEXT
    x = w["start"] + w["linked"] * min(1.0, block.linked / block.size)
    x += w["paragraph"] * (block.tag in ("p", "blockquote", "pre")) + w["heading"] * (block.tag in ("h1", "h2", "h3", "h4")) + w["legal"] * bool(LEGAL.search(block.text))
    return x + w["long"] * min(1.0, block.size / 120) + w["sentence"] * block.text.endswith((".", "!", "?", "…", ":"))


def _apart(a: Container, b: Container) -> int:
    """Steps in the tree from one container to another."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
        steps += 1
    return steps


def graph(found: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal costs and smoothness edges; the blocks' nodes come first, then those of containers that hold blocks.

    A container has its role's cost once for each of its blocks.  Across the border of
    containers whose roles disagree an edge holds a quarter.
    """
    odds = [log_odds(b) for b in found]
    edges: list[tuple[int, int, float]] = []
    node: dict[int, int] = {}
    before: Container | None = None
    for k, b in enumerate(found):
        here = b.container
        if here.number not in node:
            node[here.number] = len(found) + len(node)
            odds.append(0.0)
            up = here.above
            while up is not None and up.number not in node:
                up = up.above
            for other in {c.number: c for c in (before, up) if c is not None}.values():
                far = _apart(here, other)
                edges.append((node[other.number], node[here.number], NEAR / max(1, far) * (1.0 if here.role * other.role > 0 or here.role == other.role else 0.25)))
        odds[node[here.number]] += here.role
        edges.append((k, node[here.number], INSIDE if here.role else LOOSE))
        if before is not None:
            far = _apart(before, here)
            edges.append((k - 1, k, NEXT / (1 + far) * (1.0 if before.role * here.role > 0 or before.role == here.role else 0.25)))
        before = here
    return odds, edges


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    return minimum_cut(*graph(found))[: len(found)]


def agreement(page: str) -> tuple[int, int, int]:
    """Blocks of a page, and for how many the cut overrules the block's own text, or its container's role (0: undecided)."""
    found = blocks(page)
    side = labels(found)
    by_text = sum(content != (log_odds(b) > 0) for b, content in zip(found, side, strict=True))
    return len(found), by_text, sum(content != (b.container.role > 0) for b, content in zip(found, side, strict=True))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side; a node's odds are its capacity from the source, or if negative to the sink.

    Dinic's algorithm, by layers and without recursion.
    """
    n = len(odds)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adjacent: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        adjacent[a].append(len(to))
        to.append(b)
        cap.append(there)
        adjacent[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, x in enumerate(odds):
        if x > 0:
            join(s, k, x, 0.0)
        elif x < 0:
            join(k, t, -x, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in adjacent[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[a] < len(adjacent[a]):
                e = adjacent[a][place[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(adjacent[a]):
                path.append(adjacent[a][place[a]])
                a = to[path[-1]]
            elif not path:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                place[a] += 1


def main_text(page: str) -> str:
    """The content blocks in page order, joined by line breaks."""
    found = blocks(page)
    return "\n".join(b.text for b, content in zip(found, labels(found), strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null html is an empty one and gives an empty text.  Null and repeated ids
    are rows like any other; an empty table gives an empty one; extra columns are
    left out.
    """
    runtime.small_batches(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(runtime.frugal(run), "page_id long, url string, text string, n_chars long")
