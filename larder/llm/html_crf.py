"""Main text of web pages by a linear-chain conditional random field (operator 9).

A page is cut into leaf blocks: runs of text between block-level tags, with the block's tag, its
ancestors' tags and their class and id words. A two-label chain (main text or not) scores each block
by hashed ancestor and text features, and neighbouring blocks by label pairs. It is trained by
stochastic gradient on the likelihood of labelled pages and decoded by Viterbi.

Labels: a bounded sample of pages whose markup tells its parts apart (an article or main element) is
labelled by that markup. Copies of them are varied, so that the weights rest on many kinds of
containers: parts are put into other containers, boilerplate of other kinds is added from the blocks
at hand, and the article element is replaced by other content containers.

Edge cases: a null html is an empty one and gives an empty text; unclosed, misnested and cut-off
markup is read as far as it goes; without any page to learn from, the containers' names alone are
used as training pages; repeated rows stay; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
RAW = frozenset("script style textarea title".split())  # up to their end tag, or to the page's end
SKIPPED = frozenset("button noscript template select svg iframe object canvas".split())  # up to their end tag, if there is one
# A tag ends at its >, or is given up at the next <; quoted values are read up to a bound. So reading is linear.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']++|\"[^\"]{0,2000}+\"|'[^']{0,2000}+')*+)[\"']?>?", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BUTTON = re.compile(r"</?button")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mfenced mtable mtr mtd semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
OPENS_OVER_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# Names that mark parts of pages: used to label and vary training pages, never to extract.
BOILERPLATE = {
    "nav": ("nav menu", "navbar", "breadcrumb", "site-nav", "menu", "pagination"), "header": ("site-header", "masthead", "topbar", "banner", "header"),
    "footer": ("site-footer", "footer", "copyright", "legal", "bottom"), "aside": ("sidebar", "related", "widget", "rail", "promo", "side"),
    "div": ("ad", "ads", "advert", "advertisement", "sponsored", "banner-ad", "cookie", "cookie-notice", "consent", "notice", "popup", "modal", "newsletter",
            "subscribe", "share", "social", "sidebar", "related", "comments", "comment", "comment-list", "reader-comments", "discussion", "replies", "reply", "disqus", "disqus-thread", "menu", "navigation", "footer", "header", "breadcrumbs", "login", "search", "toolbar"),
    "section": ("comments", "related-posts", "newsletter", "promo", "recommendations", "responses", "disqus"), "form": ("search", "subscribe", "login", "comment-form", "contact"),
    "ul": ("menu", "nav-list", "links", "share", "comment-list"), "ol": ("commentlist", "comments", "breadcrumb"),
}
CONTENT = {"article": ("", "post", "article", "entry", "story"), "main": ("", "content", "main"), "div": ("content", "main-content", "article-body", "post-content", "entry-content", "story-body", "text"), "section": ("article-body", "content", "post")}
# Leaf blocks of main text, with the elements that they stand in.
LEAVES = {"p": ("p",), "h2": ("h2",), "h3": ("h3",), "li": ("ul", "li"), "item": ("ol", "li"), "blockquote": ("blockquote",), "quote": ("blockquote", "p"), "div": ("div",), "": (),
          "pre": ("pre",), "td": ("table", "tbody", "tr", "td"), "cell": ("table", "tr", "td"), "th": ("table", "tr", "th"), "dt": ("dl", "dt"), "dd": ("dl", "dd"), "figcaption": ("figure", "figcaption"), "section": ("section", "p")}
_NEVER = frozenset("nav footer aside form header menu dialog".split())


@lru_cache(maxsize=50_000)
def _pair_slots(tag: str, words: str) -> tuple[int, ...]:
    return tuple(_slot(n) for n in (f"in={tag}", *(f"word={w}" for w in _WORD.findall(words))))


class Path:
    """An element of a page as its parent's node and (tag, class and id words), so that blocks share their ancestors.

    Equal paths of one page are one node. Iterating gives the pairs from the outermost ancestor.
    """

    __slots__ = ("parent", "pair", "children", "known", "slots")

    def __init__(self, parent: Path | None = None, pair: tuple[str, str] = ("", "")) -> None:
        self.parent, self.pair, self.children = parent, pair, {}
        self.known: frozenset[tuple[str, str]] = parent.known if parent else frozenset()
        self.slots: tuple[int, ...] = parent.slots if parent else ()
        if parent and pair not in self.known:
            self.known, self.slots = self.known | {pair}, self.slots + _pair_slots(*pair)

    def child(self, pair: tuple[str, str]) -> Path:
        found = self.children.get(pair)
        if found is None:
            found = self.children[pair] = Path(self, pair)
        return found

    def __iter__(self) -> Iterator[tuple[str, str]]:
        pairs, node = [], self
        while node.parent:
            pairs.append(node.pair)
            node = node.parent
        return reversed(pairs)


@dataclass(frozen=True)
class Block:
    text: str
    tag: str
    path: Path | tuple[tuple[str, str], ...]  # (tag, class and id words) from the outermost ancestor
    link_chars: int
    hidden: bool


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order, white space made single, character references decoded.

    Open elements are looked up by their tag and never searched for, so the time is linear in the page
    whatever end tags are missing or stray.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, Path]] = []
    places: dict[str, list[int]] = {}  # where elements of each tag are open in the stack
    solid: list[int] = []  # where elements that aren't inline are
    root, n_hidden = Path(), 0
    run: list[str] = []
    links = [0, 0]  # open links, characters inside them

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(Block(text, stack[solid[-1]][0] if solid else "", stack[-1][2] if stack else root, links[1], n_hidden > 0))
        links[1] = 0

    def close(upto: int) -> None:
        nonlocal n_hidden
        while len(stack) > upto:
            name, hidden, _ = stack.pop()
            places[name].pop()
            n_hidden -= hidden
            if solid and solid[-1] == len(stack):
                solid.pop()

    at, lower, absent = 0, html.lower(), set()
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            piece = html[at:m.start()]
            run.append(piece)
            if links[0]:
                links[1] += len(piece)
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        attributes = m.group(3) or ""
        if not m.group(1) and (name in RAW or name in SKIPPED and name not in absent and not attributes.endswith("/")):
            if name == "button":  # it ends where the next one starts
                other = _BUTTON.search(lower, at)
                end = other.start() if other else -1
            else:
                end = lower.find(f"</{name}", at)
            if end >= 0 or name in RAW:
                run.append(" ")
                at = end if end >= 0 else len(html)
            else:
                absent.add(name)
            continue
        if name in SKIPPED or name in RAW:
            continue
        if m.group(1):
            if name == "a":
                links[0] = 0
            place = last(name)
            if name not in INLINE:
                flush()
            if place >= 0 and (name not in INLINE or not solid or solid[-1] < place):
                close(place)
            continue
        if name in INLINE:
            if name in ("br", "img", "input"):
                run.append(" ")
                continue
            if name == "a":
                links[0] = 1
        else:
            flush()
            if name in OPENS_OVER_P:
                place = max(last(t) for t in ("p", "td", "article", "div", "section", "body"))
                if place >= 0 and stack[place][0] == "p":
                    close(place)
            for other in CLOSES.get(name, ()):
                if solid and stack[solid[-1]][0] == other:
                    close(solid[-1])
        if name in VOID or attributes.endswith("/"):
            continue
        words, hidden = [], False
        for key, a, b, c in _ATTR.findall(attributes):
            value, key = (a or b or c).lower(), key.lower()
            if key in ("class", "id", "role"):
                words.append(value)
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= key == "hidden" or value == "true"
        pair, above = (name, " ".join(words)), stack[-1][2] if stack else root
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        stack.append((name, hidden, above.child(pair) if name not in INLINE or pair[1] else above))
        n_hidden += hidden
    run.append(html[at:])
    flush()
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def _path_slots(path: Path | tuple[tuple[str, str], ...]) -> tuple[int, ...]:
    if isinstance(path, Path):
        return path.slots
    return tuple(slot for pair in dict.fromkeys(path) for slot in _pair_slots(*pair))


@lru_cache(maxsize=50_000)
def _text_slots(tag: str, length: int, link: int, end: bool, hidden: bool, same: bool | None) -> tuple[int, ...]:
    return tuple(_slot(n) for n in (f"tag={tag}", f"len={length}", f"link={link}", f"end={end}", f"hidden={hidden}", f"same={same}"))


def _features(block: Block, previous: Block | None) -> list[int]:
    size = len(block.text)
    own = _text_slots(block.tag, min(9, size.bit_length()), min(4, 4 * block.link_chars // max(1, size)), block.text[-1] in ".!?", block.hidden,
                      None if previous is None else previous.path == block.path)
    return [*own, *_path_slots(block.path)]


def page_features(page: list[Block]) -> list[list[int]]:
    return [_features(b, page[i - 1] if i else None) for i, b in enumerate(page)]


@dataclass(frozen=True)
class Chain:
    """Weights of label 1 against 0 per feature, of the label pairs, and of the start."""

    weights: np.ndarray
    pairs: np.ndarray
    start: np.ndarray

    def _scores(self, features: list[list[int]]) -> np.ndarray:
        ones = np.array([self.weights[f].sum() for f in features])
        return np.stack([np.zeros(len(ones)), ones], axis=1)

    def viterbi(self, features: list[list[int]]) -> list[int]:
        if not features:
            return []
        local, pairs = self._scores(features).tolist(), self.pairs.tolist()
        s0, s1 = local[0][0] + self.start[0], local[0][1] + self.start[1]
        back = []
        for a, b in local[1:]:
            from0 = (0, s0 + pairs[0][0]) if s0 + pairs[0][0] >= s1 + pairs[1][0] else (1, s1 + pairs[1][0])
            from1 = (0, s0 + pairs[0][1]) if s0 + pairs[0][1] > s1 + pairs[1][1] else (1, s1 + pairs[1][1])
            back.append((from0[0], from1[0]))
            s0, s1 = from0[1] + a, from1[1] + b
        labels = [0 if s0 >= s1 else 1]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def marginals(self, features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each block, and of each pair of neighbours."""
        local = self._scores(features)
        n = len(local)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = local[0] + self.start
        for i in range(1, n):
            step = ahead[i - 1][:, None] + self.pairs
            ahead[i] = local[i] + np.logaddexp(step[0], step[1])
        for i in range(n - 2, -1, -1):
            step = self.pairs + (local[i + 1] + behind[i + 1])[None, :]
            behind[i] = np.logaddexp(step[:, 0], step[:, 1])
        whole = np.logaddexp(*ahead[-1])
        single = np.exp(ahead + behind - whole)
        double = np.exp(ahead[:-1, :, None] + self.pairs[None] + (local[1:] + behind[1:])[:, None, :] - whole)
        return single, double


def train_chain(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 5, rate: float = 0.3, seed: int = 7) -> Chain:
    """Adagrad ascent of the conditional log-likelihood."""
    chain = Chain(np.zeros(1 << BITS), np.zeros((2, 2)), np.zeros(2))
    grown, pair_grown, start_grown = np.full(1 << BITS, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    order, rng = [p for p in pages if p[0]], random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for features, labels in order:
            single, double = chain.marginals(features)
            gold = np.array(labels)
            pull = np.zeros(1 << BITS)
            for f, miss in zip(features, gold - single[:, 1]):
                pull[f] += miss
            touched = np.flatnonzero(pull)
            grown[touched] += pull[touched] ** 2
            chain.weights[touched] += rate * pull[touched] / np.sqrt(grown[touched])
            truth = np.zeros((2, 2))
            np.add.at(truth, (gold[:-1], gold[1:]), 1.0)
            step = truth - double.sum(axis=0)
            pair_grown[:] += step ** 2
            chain.pairs[:] += rate * step / np.sqrt(pair_grown)
            step = np.eye(2)[gold[0]] - single[0]
            start_grown[:] += step ** 2
            chain.start[:] += rate * step / np.sqrt(start_grown)
        chain.weights[:] *= 0.999
    return chain


def markup_labels(page: list[Block]) -> list[int] | None:
    """Labels by an article or main element, if the page has one."""
    inside = [any(t in ("article", "main") for t, _ in b.path) for b in page]
    if not any(inside):
        return None
    marks = {w for names in BOILERPLATE.values() for n in names for w in _WORD.findall(n)} - {"top", "bottom", "side"}

    def other(path: tuple[tuple[str, str], ...]) -> bool:
        """Whether a part that isn't main text is among the ancestors; an article's own header is main text."""
        article = False
        for t, c in path:
            if t in _NEVER and not (t == "header" and article) or marks & set(_WORD.findall(c)):
                return True
            article |= t == "article"
        return False

    return [int(on and not b.hidden and not other(b.path)) for on, b in zip(inside, page)]


def _moved(block: Block, container: tuple[str, str], inner: str, link: bool = False) -> Block:
    path = (("html", ""), ("body", ""), container, *(((inner, ""),) if inner else ()))
    return Block(block.text, inner or container[0], path, len(block.text) if link else 0, False)


def varied(page: list[Block], labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A copy with other content containers, and boilerplate of other kinds around and inside."""
    main = [b for b, y in zip(page, labels) if y]
    if not main:
        return page, labels
    tag = rng.choice(list(CONTENT))
    body = (tag, rng.choice(CONTENT[tag]) if rng.random() < 0.6 else "")
    shape = rng.random()
    outer = (("main", ""),) if shape < 0.25 else (("div", ""),) if shape < 0.5 else ()
    bare = rng.random() < 0.2  # a page of its text alone, without names and mostly without a content container
    plain = rng.choice(("p", "div", "div", "h2", "li"))
    if rng.random() < 0.2:
        main = main[:rng.randint(1, 3)]
    out: list[tuple[Block, int]] = []

    def junk(inside: bool) -> None:
        kind = rng.choice([*BOILERPLATE, *["div"] * (9 if inside else 3)])  # the kind with the most names
        name = rng.choice(BOILERPLATE[kind]) if kind == "div" or rng.random() < 0.7 else ""
        inner = {"ul": "li", "ol": "li"}.get(kind) or rng.choice(("", "p", "li", "div", "h3", "a"))
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(main).text
            size = rng.choice((1, 2, 5, 12, 60))
            words = text.split(" ")[:size] if rng.random() < 0.5 else text.split(" ")[-size:]
            block = _moved(Block(" ".join(words), "", (), 0, False), (kind, name), "" if inner == "a" else inner, inner == "a" or kind in ("nav", "ul"))
            if inside:
                block = Block(block.text, block.tag, (("html", ""), ("body", ""), *outer, body, *block.path[2:]), block.link_chars, False)
            out.append((block, 0))

    around = 0 if bare else 3
    for _ in range(rng.randint(min(1, around), around)):
        junk(False)
    for i, b in enumerate(main):
        leaf = plain if bare else b.tag if b.tag in ("h1", "p") and rng.random() < 0.6 else rng.choice(list(LEAVES))
        if rng.random() < 0.2:  # short paragraphs are main text too
            b = Block(" ".join(b.text.split(" ")[-rng.randint(1, 4):]), b.tag, b.path, 0, False)
        inner = (("header", ""), ("h1", "")) if i == 0 and tag == "article" and rng.random() < 0.4 else tuple((t, "") for t in LEAVES.get(leaf, (leaf,)))
        holder = () if bare and rng.random() < 0.7 else (*outer, body)
        out.append((Block(b.text, inner[-1][0] if inner else (holder or (("body", ""),))[-1][0], (("html", ""), ("body", ""), *holder, *inner), 0, False), 1))
        if not bare and rng.random() < 0.25:
            junk(True)
    if not bare and rng.random() < 0.4:
        junk(True)
    for _ in range(rng.randint(min(1, around), around)):
        junk(False)
    return [b for b, _ in out], [y for _, y in out]


_FALLBACK = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title of a page.</h1><p>A first paragraph with some words.</p><p>A second paragraph, which ends here.</p></article><footer>All rights</footer></body></html>"


def fit(pages: list[str], copies: int = 2400, seed: int = 7) -> Chain:
    """Train on labelled pages and about ``copies`` varied copies of them."""
    rng, rows = random.Random(seed), []
    pages = [*pages, _FALLBACK]
    copies = copies // len(pages) + 1
    for html in pages:
        page = blocks(html)
        labels = markup_labels(page)
        if labels is None:
            continue
        rows.append((page_features(page), labels))
        short = [Block(b.text.split(" ")[-1], b.tag, b.path, b.link_chars, b.hidden) if rng.random() < 0.3 else b for b in page]
        rows.append((page_features(short), labels))
        for _ in range(copies):
            changed, marks = varied(page, labels, rng)
            rows.append((page_features(changed), marks))
    return train_chain(rows)


def main_text(html: str, chain: Chain) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, y in zip(page, chain.viterbi(page_features(page))) if y)


@dataclass(frozen=True)
class TrainingBounds:
    pages: int = 400
    max_chars: int = 60000  # longer pages are not used for training (all are extracted)


def train(pages: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> Chain:
    """Fit on a bounded sample: the pages of least hash of page_id and url."""
    usable = pages.select("page_id", "url", F.col("html")).where(F.length("html").between(1, bounds.max_chars))
    ids = usable.select(F.xxhash64("page_id", "url").alias("k")).distinct().orderBy("k").limit(bounds.pages)
    rows = usable.withColumn("k", F.xxhash64("page_id", "url")).join(F.broadcast(ids), "k").groupBy("k").agg(F.min("html").alias("html")).orderBy("k").collect()
    return fit([r.html for r in rows])


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    chain = chain or train(pages)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h or "", chain) for h in batch], dtype=object)

    rows = pages.select("page_id", "url", extracted(F.coalesce("html", F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
