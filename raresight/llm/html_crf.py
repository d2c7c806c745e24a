"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raresight.llm.common import carried, small_batches

#: Pages the fit sees at most, of smallest seeded hash, none longer than PAGE_LENGTH; layouts made around each.
SAMPLE, PAGE_LENGTH, LAYOUTS = 250, 20_000, 4
ROUNDS, RATE, L2 = 120, 0.15, 1e-3

#: Element kinds of the markup language.
RAW = frozenset("script style template noscript iframe object svg math textarea select option button title head canvas audio video".split())
UNPARSED = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an open head may hold; anything else ends it, whether its end tag is there or not.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>?|[^<]+|<""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: A start tag that closes itself, which only void and foreign elements can: the stroke isn't the end of a bare value.
CLOSED = re.compile(r"""(?:^|["'\s])/\s*\Z""")
FOREIGN = ("svg", "math")
DIGIT = re.compile(r"\d")
#: Digits that are no decimal ones, such as raised and ringed ones; Latin-1 has three of them.
RAISED = re.compile(f"[{''.join(c for c in map(chr, range(128, 0x1F200)) if c.isdigit() and not c.isdecimal())}]")
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
END = {tag: re.compile(rf"</{tag}", re.I) for tag in UNPARSED}
QUOTES = "\"'"


class Node:
    """An element that is no inline one, by its parent; ``fresh`` are the features that no ancestor has."""

    __slots__ = ("parent", "tag", "fresh", "weight")

    def __init__(self, parent: Node | None, tag: str, fresh: tuple[str, ...]):
        self.parent, self.tag, self.fresh, self.weight = parent, tag, fresh, None


@dataclass(slots=True)
class Block:
    """A run of text between block boundaries: its innermost element, text, characters inside links, gold label if any."""

    node: Node | None
    text: str
    linked: int = 0
    gold: int | None = None


_OWN: dict[tuple[str, str], tuple[str, ...]] = {}


def own_features(tag: str, names: str) -> tuple[str, ...]:
    """An element's tag and the words of its class, id and role."""
    found = _OWN.get((tag, names))
    if found is None:
        if len(_OWN) > 20_000:
            _OWN.clear()
        of_tag = {f"a:{tag}"} if tag not in ("html", "body") else set()
        found = _OWN[tag, names] = tuple(sorted(of_tag | {f"c:{word.lower()}" for word in PART.findall(names)}))
    return found


@dataclass(slots=True)
class _Open:
    """An open element; ``outer`` and ``blocks`` count the elements up to it that are not inline, and those that hold blocks."""

    tag: str
    node: Node | None
    gold: int | None
    outer: int
    blocks: int


class _Stack:
    """Open elements. Every question about them takes the same time however deep they are."""

    def __init__(self):
        self.items: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.active: set[str] = set()

    def last(self, tag: str) -> int | None:
        places = self.places.get(tag)
        return places[-1] if places else None

    def push(self, tag: str, names: str, gold: int | None) -> None:
        top = self.items[-1] if self.items else _Open("", None, None, 0, 0)
        inline, node = tag in INLINE, top.node
        if not inline:
            fresh = tuple(f for f in own_features(tag, names) if f not in self.active)
            self.active.update(fresh)
            node = Node(top.node, tag, fresh)
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append(_Open(tag, node, top.gold if gold is None else gold, top.outer + (not inline), top.blocks + (not inline and tag not in RAW)))

    def cut(self, depth: int) -> list[str]:
        """Close the elements from ``depth`` on; their tags."""
        gone = self.items[depth:]
        del self.items[depth:]
        for x in gone:
            self.places[x.tag].pop()
            if x.tag not in INLINE:
                self.active.difference_update(x.node.fresh)
        return [x.tag for x in gone]

    def above(self, depth: int, what: str) -> int:
        """How many elements from ``depth`` on are not inline (``outer``), or hold blocks (``blocks``)."""
        return getattr(self.items[-1], what) - (getattr(self.items[depth - 1], what) if depth else 0)


def leaf_blocks(page: str | None, gold: dict[int, int] | None = None) -> list[Block]:
    """Leaf blocks in page order; references decoded, white space made single, empty ones left out.

    ``gold`` labels what stands in the elements whose start tags begin at its places.
    Time and memory are in proportion to the page, however deep its elements are.
    """
    out: list[Block] = []
    stack, parts = _Stack(), []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack.items[-1] if stack.items else None
                out.append(Block(top and top.node, text, linked, top and top.gold))
            parts.clear()
        linked = 0

    page = page or ""
    at, hidden, links = 0, 0, 0

    def close(depth: int) -> None:
        nonlocal hidden, links
        for tag in stack.cut(depth):
            hidden -= tag in RAW
            links -= tag == "a"

    while at < len(page):
        found = TOKEN.match(page, at)
        begin, at = at, found.end()
        tag = found[2]
        in_head = bool(stack.items) and stack.items[-1].tag == "head"
        if tag is None:
            piece = found[0]
            if in_head and (piece[0] != "<" or piece == "<") and piece.strip():
                close(len(stack.items) - 1)
            if not hidden and (piece[0] != "<" or piece == "<"):
                piece = html.unescape(piece)
                parts.append(piece)
                if links:
                    linked += len(piece.strip())
            continue
        tag = tag.lower()
        if found[1]:
            depth = stack.last(tag)
            if depth is None:
                continue
            if stack.above(depth, "blocks"):
                # an inline end tag that comes late doesn't close the blocks around it
                if tag in INLINE:
                    continue
                flush()
            close(depth)
            continue
        if in_head and tag not in IN_HEAD:
            close(len(stack.items) - 1)
        if tag in VOID:
            if tag == "hr":
                flush()
            parts.append(" ")
            continue
        if tag not in INLINE and tag not in RAW:
            flush()
            for other in CLOSES.get(tag, ()):
                depth = stack.last(other)
                # only inline elements may stand between for the end to be implied
                if depth is not None and stack.above(depth, "outer") == 1:
                    close(depth)
        if (tag in FOREIGN or any(stack.places.get(x) for x in FOREIGN)) and CLOSED.search(found[3]):
            continue
        names = "".join(f" {value.strip(QUOTES)}" for _, value in NAMED.findall(found[3])) if found[3] else ""
        stack.push(tag, names, gold.get(begin) if gold else None)
        hidden += tag in RAW
        links += tag == "a"
        if tag in UNPARSED:
            end = END[tag].search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def near_features(node: Node | None) -> tuple[str, str]:
    """The nearest tag, and the two nearest."""
    near = node.tag if node else ""
    return f"t:{near}", f"n:{node.parent.tag}/{near}" if node and node.parent else f"n:{near}"


def path_features(node: Node | None) -> list[str]:
    """Ancestor tags and the words of their classes, ids and roles, each once, and the two nearest tags."""
    out, at = [*near_features(node)], node
    while at:
        out += at.fresh
        at = at.parent
    return out


def has_digit(text: str) -> bool:
    if DIGIT.search(text) is not None:
        return True
    if text.isascii():
        return False
    try:
        latin = text.encode("latin-1")
    except UnicodeEncodeError:
        return RAISED.search(text) is not None
    return any(x in latin for x in (b"\xb2", b"\xb3", b"\xb9"))


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    return [
        f"w:{min(8, words.bit_length())}",
        f"l:{min(4, int(4 * share))}",
        f"e:{text[-1] in '.!?…:;»”'}",
        f"u:{text[0].isupper()}",
        f"d:{has_digit(text)}",
        f"s:{'©' in text or '|' in text}",
        f"p:{min(3, text.count('. '))}",
    ]


class Field:
    """Two labels, 0 boilerplate and 1 main text: a weight per feature, transitions and a start."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, start: np.ndarray):
        self.weights, self.steps, self.start = weights, steps, start

    def evidence(self, block: Block) -> float:
        """What a block's features weigh; each element's share is worked out once."""
        get, todo, at = self.weights.get, [], block.node
        while at and at.weight is None:
            todo.append(at)
            at = at.parent
        weight = at.weight if at else 0.0
        for node in reversed(todo):
            weight += sum(get(f, 0.0) for f in node.fresh)
            node.weight = weight
        return weight + sum(get(f, 0.0) for f in near_features(block.node)) + sum(get(f, 0.0) for f in text_features(block))

    def decode(self, blocks: list[Block]) -> list[int]:
        """Most likely labels (Viterbi)."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        back, zero, one = [], *self.start.tolist()
        for i, block in enumerate(blocks):
            e = self.evidence(block)
            if i:
                from0, from1 = zero + s00 >= one + s10, zero + s01 > one + s11
                back.append((0 if from0 else 1, 0 if from1 else 1))
                zero, one = (zero + s00 if from0 else one + s10), (zero + s01 if from1 else one + s11)
            one += e
        at, out = int(one > zero), []
        for step in reversed(back):
            out.append(at)
            at = step[at]
        return [at, *reversed(out)] if blocks else []

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return "\n".join(b.text for b, main in zip(blocks, self.decode(blocks)) if main)


def train(pages: list[list[Block]]) -> Field:
    """Weights that maximise the conditional likelihood of the gold labels (Adam, L2), all pages side by side."""
    pages = [p for p in pages if p]
    place: dict[str, int] = {}
    cell_block, cell_feature, gold = [], [], []
    longest = max(map(len, pages))
    for i, page in enumerate(pages):
        for j, block in enumerate(page):
            for f in path_features(block.node) + text_features(block):
                cell_block.append(i * longest + j)
                cell_feature.append(place.setdefault(f, len(place)))
    cell_block, cell_feature = np.array(cell_block), np.array(cell_feature)
    n = len(pages)
    lengths = np.array([len(p) for p in pages])
    gold = np.zeros((n, longest), int)
    for i, page in enumerate(pages):
        gold[i, : len(page)] = [b.gold or 0 for b in page]
    there = np.arange(longest)[None, :] < lengths[:, None]
    w, steps, start = np.zeros(len(place)), np.zeros((2, 2)), np.zeros(2)
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & there[:, 1:]).sum()
    first, second = np.zeros(len(place) + 6), np.zeros(len(place) + 6)
    log_sum = np.logaddexp.reduce
    for t in range(1, ROUNDS + 1):
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(cell_block, weights=w[cell_feature], minlength=n * longest).reshape(n, longest)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = start + emit[:, 0]
        for j in range(1, longest):
            step = log_sum(alpha[:, j - 1, :, None] + steps[None], axis=1) + emit[:, j]
            alpha[:, j] = np.where(there[:, j, None], step, alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = log_sum(steps[None] + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            beta[:, j] = np.where(there[:, j + 1, None], step, 0)
        total = log_sum(alpha[:, -1], axis=1)
        one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * there
        pair = alpha[:, :-1, :, None] + steps[None, None] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * there[:, 1:, None, None]).sum(axis=(0, 1))
        error = ((gold == 1) & there) - one
        grad = np.concatenate((np.bincount(cell_feature, weights=error.ravel()[cell_block], minlength=len(place)) - L2 * n * w, (seen - pair).ravel() - L2 * n * steps.ravel(), [-error[:, 0].sum(), error[:, 0].sum()]))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, steps, start = w + move[:-6], steps + move[-6:-2].reshape(2, 2), start + move[-2:]
    return Field({f: float(w[i]) for f, i in place.items()}, steps, start)


#: Wrappers of the labelled layouts, by what they hold.
BOILERPLATE = {
    "menu": ["<nav>", '<div class="menu">', '<div id="navbar">', '<div class="breadcrumb">', '<ul class="nav">', '<div role="navigation">', '<div class="toolbar">', '<div class="pagination">'],
    "header": ["<header>", '<div id="header">', '<div class="masthead">', '<div id="top" class="site-header">', '<div class="logo">', '<div role="banner">'],
    "footer": ["<footer>", '<div class="footer">', '<div id="bottom" class="copyright">', '<div class="site-footer legal">', '<div role="contentinfo">'],
    "sidebar": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<section class="recommended">', '<div class="popular">', '<div class="teaser">', '<div role="complementary">'],
    "notice": ['<div class="notice">', '<div class="cookie">', '<div id="cookie-banner">', '<div class="consent">', '<div class="alert">', '<div class="popup modal">', '<div class="newsletter">', '<div class="subscribe">', "<dialog>", '<div role="dialog">', '<div class="gdpr">', '<div class="warning">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div id="promo">', '<section class="banner">', '<aside class="ad">', '<div class="sponsor">'],
    "form": ["<form>", '<form class="search">', '<div class="login">', '<form id="signup">', '<div class="search-box">'],
    "comments": ['<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="commentlist">', '<div class="responses">', '<div id="disqus">', '<article class="comment">', '<div class="replies">', '<div class="discussion">'],
    "share": ['<div class="share">', '<div class="social">', '<div class="tags">', '<div class="meta">', '<div class="byline author">'],
}
MAIN = ["<article>", "<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry">', '<div class="story">', '<div class="article-body">', '<section class="text">', "<div>", '<div role="main">', '<main class="main">']


def _open(wrapper: str, gold: int) -> str:
    return f'{wrapper[:-1]} data-gold="{gold}">'


def _close(wrapper: str) -> str:
    return f"</{re.match('<([a-z]+)', wrapper)[1]}>"


GOLD = re.compile(r' data-gold="(\d)"')


def labelled_blocks(made: str) -> list[Block]:
    """Blocks of a made-up page, whose gold labels are taken out of it before it is read."""
    gold, shift = {}, 0
    for found in GOLD.finditer(made):
        gold[made.rindex("<", 0, found.start()) - shift] = int(found[1])
        shift += len(found[0])
    return leaf_blocks(GOLD.sub("", made), gold)


def layout(texts: list[str], rng: random.Random) -> str:
    """A labelled page around the given paragraphs: boilerplate of all kinds in some wrapper before, in and after them."""
    safe = [html.escape(t) for t in texts] or ["Lorem."]
    some = lambda: " ".join(rng.choice(safe).split()[: rng.randint(2, 14)])

    def boilerplate(kind: str) -> str:
        wrapper = rng.choice(BOILERPLATE[kind])
        long = kind in ("comments", "sidebar", "notice", "advert", "footer") and rng.random() < 0.6
        if kind in ("menu", "share", "header") or rng.random() < 0.2:
            inner = "".join(f'<li><a href="/">{" ".join(some().split()[: rng.randint(1, 3)])}</a></li>' for _ in range(rng.randint(2, 8)))
            inner = f"<ul>{inner}</ul>" if rng.random() < 0.6 else inner.replace("li>", "span>").replace("</a>", "</a> ")
            inner = f"<h1>{some()}</h1>{inner}" if kind == "header" and rng.random() < 0.4 else inner
        elif kind == "form":
            inner = f"<label>{some()}</label><input><p>{some()}</p><button>{some()}</button>"
        else:
            pick = (lambda: rng.choice(safe)) if long else some
            inner = "".join(f"<p>{pick()}</p>" if rng.random() < 0.6 else f"<div>{pick()}</div>" for _ in range(rng.randint(1, 4)))
            inner = f"<h3>{some()}</h3>{inner}" if rng.random() < 0.4 else inner
            inner = rng.choice(safe) if rng.random() < 0.3 else inner
            inner = f"&copy; example &middot; {inner}" if kind == "footer" and rng.random() < 0.7 else inner
        return f"{_open(wrapper, 0)}{inner}{_close(wrapper)}"

    def paragraph(text: str) -> str:
        kind = rng.random()
        if kind < 0.8:
            return f"<p>{text}</p>"
        return rng.choice(["<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<h3>{}</h3>", "<div>{}</div>", "<ol><li>{}</li></ol>"]).format(text)

    main, body = rng.choice(MAIN), []
    for i, text in enumerate(safe):
        cut = text if i and rng.random() < 0.7 else " ".join(text.split()[: rng.randint(1, 12)])
        body.append(paragraph(cut) if i else rng.choice([f"<h1>{cut}</h1>", f"<header><h1>{cut}</h1></header>", f"<h1>{cut}</h1>", paragraph(cut)]))
        if rng.random() < 0.12:
            body.append(boilerplate(rng.choice(["advert", "sidebar", "share", "notice", "form"])))
    before = [boilerplate(k) for k in ("notice", "header", "menu", "advert", "form", "sidebar", "share") if rng.random() < 0.5]
    after = [boilerplate(k) for k in ("share", "comments", "sidebar", "advert", "menu", "notice", "form", "footer") if rng.random() < 0.5]
    inside = f"{_open(main, 1)}{''.join(body)}{_close(main)}"
    if rng.random() < 0.4:
        inside = f'<div class="{rng.choice(["container", "wrapper", "page", "row"])}">{inside}</div>'
    return f"<html><body>{''.join(before)}{inside}{''.join(after)}</body></html>"


def by_elements(blocks: list[Block]) -> list[Block]:
    """Gold labels of a page that marks its article by element: main inside it, outside of what isn't its text."""
    kinds = {"nav", "aside", "footer", "form", "header"}
    for b in blocks:
        tags, at = set(), b.node
        while at:
            tags.add(at.tag)
            at = at.parent
        b.gold = int(bool(tags & {"article", "main"}) and not tags & kinds)
    return blocks


def fit(pages: DataFrame, page: str = "html", seed: int = 11) -> Field:
    """Field trained on labelled pages: pages of the table that mark their article by element, and layouts around their texts.

    ``SAMPLE`` pages of smallest seeded hash at most, none longer than ``PAGE_LENGTH``.
    The layouts hold each kind of boilerplate in several wrappers, with the texts of
    the sampled pages, so that neither tags nor lengths alone decide. A table without
    such pages leaves the layouts around made-up words.
    """
    marked = pages.where(F.col(page).rlike("(?i)<(article|main)[ >]") & (F.length(page) <= PAGE_LENGTH)).select(F.col(page).alias("page"))
    hashed = marked.withColumn("h", F.xxhash64("page", F.lit(seed)))
    smallest = [r[0] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    rows = sorted(map(tuple, hashed.where(F.col("h") <= F.lit(max(smallest, default=0))).groupBy("h").agg(F.min("page")).collect())) if smallest else []
    rng = random.Random(seed)
    labelled, texts = [], []
    for _, text in rows:
        blocks = by_elements(leaf_blocks(text))
        labelled.append(blocks)
        texts.append([b.text for b in blocks if b.gold][:12])
    filler = [[" ".join("".join(rng.choice(["ta", "re", "no", "il", "en", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 60))) + "." for _ in range(6)] for _ in range(20 if not texts else 0)]
    for paragraphs in [t for t in texts if t] + filler * 4:
        labelled += [labelled_blocks(layout(paragraphs, rng)) for _ in range(LAYOUTS)]
    return train([[b for b in p if b.gold is not None] for p in labelled])


def main_text(spark: SparkSession, model: Field, page: Column) -> Column:
    """Main text of each whole page, one block a line; null and empty pages have none."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def each(pages: pd.Series) -> pd.Series:
        return pd.Series([shared.value.main_text(p) for p in pages], dtype=object)

    return F.pandas_udf(each, "string")(page)


carried(__name__)
