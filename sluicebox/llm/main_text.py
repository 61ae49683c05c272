"""Main text of web pages: boosted trees judge the nodes of the document tree, and a walk down the tree decides."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.boosted_trees import Trees, fit_trees
from sluicebox.llm.common import map_texts

#: The trees are fitted on so many pages at most, the first by a hash of their keys.
FIT_PAGES = 300

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What holds no text for readers: it is left out whatever the trees say.
UNREAD = set(
    "script style noscript template head title svg iframe object select option button textarea annotation annotation-xml".split()
)
RAW = set("script style textarea title iframe noscript".split())
#: Elements in which a slash at the end of a start tag closes it, unless it ends a value without quotes.
FOREIGN = {"svg", "math"}
OPEN_VALUE = re.compile(r"=\s*[^\s\"'=<>`]*/$")
#: Tags of what is left out and may hold others of its kind, beside comments and raw elements, whose tags do not count.
NESTED = re.compile(
    r"(?i)<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])|\Z)"
    rf"|<(/?)({'|'.join(sorted(UNREAD - RAW, reverse=True))})(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>",
    re.S,
)
BLOCK = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption nav header footer aside form fieldset address details summary hgroup menu "
    "dialog search center caption".split()
)
CLOSES_P = BLOCK - set("html body td th tr thead tbody tfoot caption".split())
#: A start tag closes an open one of its group, unless one of the outer tags stands between.
GROUPS = {
    **{t: ({"li"}, {"ul", "ol", "menu"}) for t in ("li",)},
    **{t: ({"dt", "dd"}, {"dl"}) for t in ("dt", "dd")},
    **{t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")},
    "tr": ({"tr", "td", "th"}, {"table"}),
}
ASIDE_TAGS = set("nav header footer aside form fieldset menu dialog search address".split())
MAIN_TAGS = {"article", "main"}
#: Words of class, id and role that name the parts around an article, and those that name the article.
ASIDE_WORDS = set(
    "nav navigation menu navbar header masthead footer sidebar aside side rail notice cookie cookies consent gdpr banner "
    "alert ad ads adv advert adverts advertisement sponsor sponsored promo promotion form login signup subscribe "
    "newsletter search comment comments respond reply replies discussion disqus share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager widget toolbar popup modal copyright".split()
)
MAIN_WORDS = set("article content post entry main story body text prose".split())
#: Blocks whose attributes may name the article; those of a heading, paragraph or list name a part of it.
HOLDERS = set("div section td table center".split())
KINDS = {"p": 1, "li": 3, "ul": 3, "ol": 3, "dl": 3, "blockquote": 4, "pre": 4, "figure": 4, "table": 5, "td": 5, "tr": 5}
KINDS |= {f"h{i}": 2 for i in range(1, 7)} | {t: 6 for t in MAIN_TAGS} | {t: 7 for t in ASIDE_TAGS}

FEATURES = 24


class Node:
    """A block element: its tag, the words of its attributes, and its content, runs of text and child nodes in order."""

    __slots__ = ("tag", "words", "parent", "content", "text", "links", "tags", "size", "kept")

    def __init__(self, tag: str, words: list[str], parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.content: list[Node | tuple[str, int]] = []

    @property
    def children(self) -> list[Node]:
        return [c for c in self.content if isinstance(c, Node)]


def parse_page(html: str) -> Node:
    """The tree of block elements. Inline elements only add their text and links to the block that holds them."""
    root = Node("html", [], None)
    node, open_tags = root, [("html", root)]
    parts: list[str] = []
    links = anchors = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            node.content.append((text, min(links, len(text))))
        parts.clear()
        links = 0

    def close(until: int) -> None:
        nonlocal node, anchors
        if any(t in BLOCK for t, _ in open_tags[until:]):
            flush()
        anchors -= sum(t == "a" for t, _ in open_tags[until:])
        del open_tags[until:]
        node = open_tags[-1][1]

    def close_open(tags: set[str], bounds: set[str]) -> None:
        for i in range(len(open_tags) - 1, 0, -1):
            if open_tags[i][0] in tags:
                close(i)
                return
            if open_tags[i][0] in bounds:
                return

    at, end = 0, len(html)
    ends: dict[int, int] | None = None
    while at < end:
        match = TOKEN.search(html, at)
        text = html[at : match.start() if match else end]
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            links += len(text) if anchors else 0
        if not match:
            break
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in VOID:
            parts.append(" ")
            continue
        attributes = match[3] or match[6] or ""
        if tag in FOREIGN and is_empty(attributes):
            continue
        if tag in RAW:
            at = skip_raw(html, at, tag)
            continue
        if tag in UNREAD:
            ends = element_ends(html) if ends is None else ends
            at = html.find("<", at) if tag == "option" and at not in ends else ends.get(at, at)
            at = end if at < 0 else at
            continue
        if tag in CLOSES_P:
            close_open({"p"}, {"table", "td", "th", "article", "body"})
        if tag in GROUPS:
            close_open(*GROUPS[tag])
        if tag in BLOCK and tag not in ("html", "body"):
            flush()
            found = [next(filter(None, a), "") for a in ATTRIBUTE.findall(attributes)] if "=" in attributes else []
            words = [w.lower() for value in found for w in WORD.findall(value)]
            node.content.append(child := Node(tag, words, node))
            node = child
        anchors += tag == "a"
        if tag not in ("html", "body"):
            open_tags.append((tag, node))
    flush()
    return root


def is_empty(attributes: str) -> bool:
    """Whether a slash ends the start tag of an svg or math element."""
    return attributes.endswith("/") and not OPEN_VALUE.search(attributes)


def skip_raw(html: str, at: int, tag: str) -> int:
    """Behind the end tag of an element that holds no tags; a title that never ends is passed over."""
    match = re.compile(rf"(?i)</{tag}(?=[\s/>])[^>]*>").search(html, at)
    return match.end() if match else at if tag == "title" else len(html)


def element_ends(html: str) -> dict[int, int]:
    """Where the elements without text for readers end, by the end of their start tag.

    One pass over the page, however many there are. An element that is never closed has no entry: what follows may be
    the page.
    """
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for match in NESTED.finditer(html):
        tag = (match[3] or "").lower()
        if not tag:
            continue
        if not match[2]:
            if tag not in FOREIGN or not is_empty(match[4]):
                waiting.setdefault(tag, []).append(match.end())
        elif waiting.get(tag):
            ends[waiting[tag].pop()] = match.end()
    return ends


def walk(root: Node) -> list[Node]:
    """All nodes in page order, without recursion, as pages can be nested deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += node.children[::-1]
    return out


def node_features(root: Node) -> tuple[list[Node], np.ndarray]:
    """The nodes that hold text and their features: tag, attribute words, density, depth, siblings."""
    nodes = walk(root)
    for n in reversed(nodes):
        own = [c for c in n.content if not isinstance(c, Node)]
        children = n.children
        n.text = sum(len(t) for t, _ in own) + sum(c.text for c in children)
        n.links = sum(k for _, k in own) + sum(c.links for c in children)
        n.tags = 1 + sum(c.tags for c in children)
        n.size = sum(t.count(" ") + 1 for t, _ in own), sum(t.count(".") + t.count(",") for t, _ in own)
    has_main = any(n.tag in MAIN_TAGS for n in nodes)
    whole = max(1, root.text)
    state: dict[int, tuple] = {}
    rows = np.zeros((len(nodes), FEATURES))
    place: dict[int, tuple[int, int, Node | None, Node | None, float, float]] = {}
    for n in nodes:
        siblings = n.children
        if siblings:
            density = sum(s.links for s in siblings) / max(1, sum(s.text for s in siblings))
            tags = [s.tag for s in siblings]
            for i, s in enumerate(siblings):
                before, after = siblings[i - 1] if i else None, siblings[i + 1] if i + 1 < len(siblings) else None
                place[id(s)] = (i, len(siblings), before, after, density, tags.count(s.tag) / len(tags) if i < 50 else 1)
    for row, n in zip(rows, nodes):
        depth, main, aside, named, good = state[id(n.parent)] if n.parent else (0, 0, 0, 0, 0)
        hits, fine = sum(w in ASIDE_WORDS for w in n.words), sum(w in MAIN_WORDS for w in n.words)
        main |= n.tag in MAIN_TAGS
        aside |= n.tag in ASIDE_TAGS
        state[id(n)] = (depth + 1, main, aside, named + hits, good + fine)
        i, count, before, after, density, same = place.get(id(n), (0, 1, None, None, 0.0, 1.0))
        own = sum(len(c[0]) for c in n.content if not isinstance(c, Node))
        row[:] = (
            KINDS.get(n.tag, 0),
            main if has_main else -1,
            aside,
            min(hits, 3),
            min(named + hits, 4),
            min(fine, 3),
            min(good + fine, 4),
            depth,
            len(n.children),
            i / max(1, count - 1),
            count,
            np.log1p(n.text),
            np.log1p(own),
            n.links / max(1, n.text),
            n.text / n.tags,
            n.size[1] / max(1, n.size[0]),
            n.text / whole,
            n.size[0],
            n.parent.text / n.parent.tags if n.parent else 0,
            n.parent.links / max(1, n.parent.text) if n.parent else 0,
            np.log1p(before.text) if before else -1,
            np.log1p(after.text) if after else -1,
            density,
            same,
        )
    return nodes, rows


def decode(nodes: list[Node], margins: np.ndarray, most: float = 4.0) -> str:
    """The text of the kept nodes in page order.

    A node is only kept within a kept one. Of all such choices the one with the greatest sum of log odds is taken: from
    the leaves up, a node is worth its own log odds and what its children are worth, or nothing if that is negative;
    then it goes with all below it. Only the root is no choice, as it holds the page.
    """
    score = {id(n): float(np.clip(m, -most, most)) for n, m in zip(nodes, margins)}
    for n in reversed(nodes):
        worth = score[id(n)] + sum(max(0.0, score[id(c)]) for c in n.children)
        score[id(n)], n.kept = worth, worth > 0
    runs: list[str] = []
    stack: list[Node | str] = [nodes[0]]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            runs.append(item)
            continue
        if item.parent is None:
            own = margins[0] > 0 or len(nodes) == 1
        elif not item.kept:
            continue
        else:
            own = True
        stack += [c if isinstance(c, Node) else c[0] for c in reversed(item.content) if isinstance(c, Node) or own]
    return " ".join(runs)


def is_apart(node: Node) -> bool:
    return node.tag in ASIDE_TAGS or any(w in ASIDE_WORDS for w in node.words)


def named_main(nodes: list[Node]) -> list[Node]:
    """The nodes that the markup names as the article, of a page's nodes in page order.

    Tags decide; where a page has none, class, id and role of a block that holds others do, outside parts set apart.
    """
    if main := [n for n in nodes if n.tag in MAIN_TAGS]:
        return main
    apart: dict[int, bool] = {}
    for n in nodes:
        apart[id(n)] = apart.get(id(n.parent), False) or is_apart(n)
        if n.tag in HOLDERS and not apart[id(n)] and n.content and any(w in MAIN_WORDS for w in n.words):
            main.append(n)
    return main


def dense_text(nodes: list[Node]) -> str:
    """The main text by text and link density, for a page whose markup names no article.

    The published rules of Kohlschuetter et al. (2010) on the words and link densities of a block and its neighbours; a
    block is the text that a node holds itself. On a page of short blocks all count that are not mostly links, and parts
    that are set apart by name count only if nothing else is left.
    """
    if len(nodes) == 1:
        return " ".join(c[0] for c in nodes[0].content)
    apart: dict[int, bool] = {}
    blocks: list[tuple[Node, float, float]] = []
    for n in nodes:
        apart[id(n)] = apart.get(id(n.parent), False) or is_apart(n)
        own = [c for c in n.content if not isinstance(c, Node)]
        if own:
            # Texts without spaces have few words, but as many bytes.
            words = max(n.size[0], sum(len(t.encode()) for t, _ in own) / 8)
            blocks.append((n, words, sum(k for _, k in own) / max(1, sum(len(t) for t, _ in own))))
    good, none = [], (None, 0.0, 0.0)
    for before, block, after in zip([none, *blocks], blocks, [*blocks[1:], none]):
        if before[2] <= 5 / 9:
            fine = block[1] > 16 or after[1] > 15 or before[1] > 4
        else:
            fine = block[1] > 40 or after[1] > 17
        good.append(fine and block[2] <= 1 / 3)
    plain = [density <= 1 / 3 for _, _, density in blocks]
    beside = [not apart[id(n)] for n, _, _ in blocks]
    choices = ([g and b for g, b in zip(good, beside)], [p and b for p, b in zip(plain, beside)], good, plain)
    chosen = next(filter(any, choices), plain)
    kept = {id(n) for (n, _, _), use in zip(blocks, chosen) if use}
    runs: list[str] = []
    stack: list[Node | str] = [nodes[0]]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            runs.append(item)
        else:
            stack += [c if isinstance(c, Node) else c[0] for c in reversed(item.content) if isinstance(c, Node) or id(item) in kept]
    return " ".join(runs)


def teaching_labels(nodes: list[Node]) -> np.ndarray:
    """What the markup itself says of the nodes: inside an article and in no part that is set apart, or not.

    A node that holds both counts by most of its text.
    """
    good: dict[int, int] = {}
    inside: dict[int, bool] = {}
    main = {id(n) for n in named_main(nodes)}
    for n in nodes:
        above = inside.get(id(n.parent), False)
        inside[id(n)] = (above or id(n) in main) and not is_apart(n)
    for n in reversed(nodes):
        own = sum(len(c[0]) for c in n.content if not isinstance(c, Node)) if inside[id(n)] else 0
        good[id(n)] = own + sum(good[id(c)] for c in n.children)
    return np.array([good[id(n)] * 2 > n.text or (inside[id(n)] and not n.text) for n in nodes], float)


def set_apart(root: Node, others: list[Node], rng: random.Random) -> None:
    """Put parts that do not belong to an article into it: what stands around it, and text of other pages by name."""
    main = next(iter(named_main(walk(root))), None)
    if main is None:
        return
    for _ in range(rng.randint(1, 3)):
        tag, words = rng.choice(
            [(t, []) for t in sorted(ASIDE_TAGS)] + [("div", [w]) for w in sorted(ASIDE_WORDS)] * 2
        )
        part = Node(tag, words, main if rng.random() < 0.5 else root)
        for run in rng.sample(others, min(len(others), rng.randint(1, 4))):
            child = Node(rng.choice(["p", "div", "li"]), [], part)
            child.content = list(run.content)
            part.content.append(child)
        part.parent.content.insert(rng.randint(0, len(part.parent.content)), part)


def vary(root: Node, rng: random.Random) -> None:
    """Make a page unlike its site's others: short texts, other block tags in the article, less around it."""
    named = named_main(walk(root))
    main = {id(n) for n in named}
    inside: dict[int, bool] = {}
    for n in walk(root):
        inside[id(n)] = inside.get(id(n.parent), False) or id(n) in main
        if n.tag == "p" and inside[id(n)] and rng.random() < 0.3:
            n.tag = rng.choice(["li", "blockquote", "div", "td", "h2", "h3", "pre", "section", "dd"])
        if rng.random() < 0.5:
            n.content = [c if isinstance(c, Node) else shortened(c, rng) for c in n.content]
    root.content = [
        c for c in root.content if not isinstance(c, Node) or any(id(m) in main for m in walk(c)) or rng.random() < 0.6
    ]
    first = named[0]
    if rng.random() < 0.3 and len(first.content) > 1:
        first.content = rng.sample(first.content, rng.randint(1, min(4, len(first.content))))


def shortened(run: tuple[str, int], rng: random.Random) -> tuple[str, int]:
    text = " ".join(run[0].split()[: rng.randint(1, 12)])
    return text, min(run[1], len(text))


def without_names(root: Node) -> None:
    """Take the telling tags and attributes away, so that shape and density have to tell."""
    for n in walk(root):
        n.tag = "div" if n.tag in MAIN_TAGS | ASIDE_TAGS else n.tag
        n.words = []


def fit_pages(pages: list[str], seed: int = 7) -> Trees | None:
    """Trees from pages whose markup names their article, by tag or by attribute; None if there is no such page.

    Each page teaches four times: as it is, with its telling names taken away, and twice varied, with parts set apart
    put into it.
    """
    rng = random.Random(seed)
    roots = [r for r in map(parse_page, pages) if named_main(walk(r))]
    leaves = [n for r in roots[:100] for n in walk(r) if n.content and not n.children]
    rows, labels = [], []

    def learn(root: Node, wanted: np.ndarray | None = None) -> np.ndarray:
        nodes, found = node_features(root)
        wanted = teaching_labels(nodes) if wanted is None else wanted
        rows.append(found[1:])
        labels.append(wanted[1:])
        return wanted

    for root in roots:
        wanted = learn(root)
        without_names(root)
        learn(root, wanted)
    for turn in range(2):
        for root in [r for r in map(parse_page, pages) if named_main(walk(r))]:
            vary(root, rng)
            if turn or rng.random() < 0.5:
                set_apart(root, leaves, rng)
            learn(root)
    y = np.concatenate(labels) if labels else np.zeros(0)
    return fit_trees(np.concatenate(rows), y, rounds=100, depth=4) if len(set(y.tolist())) == 2 else None


def extract_text(pages: list[str], trees: Trees | None) -> Iterator[str]:
    """The main text of each page; without trees the markup's own names decide, and where it names none, density."""
    parsed = [node_features(parse_page(p)) for p in pages]
    if trees is None:
        for nodes, _ in parsed:
            yield decode(nodes, teaching_labels(nodes) * 2 - 1) if named_main(nodes) else dense_text(nodes)
        return
    margins = trees.margin(np.concatenate([rows for _, rows in parsed])) if parsed else np.zeros(0)
    start = 0
    for nodes, rows in parsed:
        yield decode(nodes, margins[start : start + len(rows)])
        start += len(rows)


def sampled_pages(pages: DataFrame, html: str, rows: int) -> list[str]:
    """``rows`` different pages at most, the first by a hash of the page.

    Only hashes are sorted, so that no task sends pages that are not among the first; copies of a page are one.
    """
    hashed = pages.where(F.col(html).isNotNull()).select(F.xxhash64(html).alias("h"), F.col(html).alias("page"))
    first = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not first:
        return []
    found = hashed.where(F.col("h") <= first[-1]).groupBy("h").agg(F.first("page").alias("page"))
    return [r["page"] for r in sorted(found.collect())]


def extract_main_text(pages: DataFrame, keep: list[str], html: str = "html", rows: int = FIT_PAGES) -> DataFrame:
    """The columns ``keep`` and ``main_text`` of every page.

    The trees are fitted on ``rows`` pages at most. Each page is parsed whole, in the task that reads it; nothing is
    shuffled. A null or empty page has no text; a page without tags is all text. Repeated rows and null keys are pages
    like any other, an empty table gives no row.
    """
    trees = fit_pages(sampled_pages(pages, html, rows))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def work(texts: list[str | None]) -> dict[str, object]:
        return {"main_text": list(extract_text([t or "" for t in texts], trees))}

    return map_texts(pages, work, f"{kept}, main_text string", keep, html)
