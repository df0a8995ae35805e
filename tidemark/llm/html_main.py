"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its text blocks. Every block has a vector of its tag path (names, classes, ids
and roles of all open elements, hashed), a vector of all its words, hashed, and some measures. A bidirectional LSTM
reads the whole sequence both ways, so that every block is judged in the context of the document.

The network is trained on a bounded sample of the given pages. Marked-up pages teach themselves: what stands in an
article is main text and what stands in menus, footers and the like is not. To learn more than one layout, the
sample's texts are also set in other layouts, where it is known which blocks are main text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import widened

SAMPLE = 300  # pages to train on: those with the smallest hashes of their ids
SAMPLE_CHARS = 100_000  # longer pages are not trained on
PATH, WORDS, MEASURES = 256, 128, 10
INPUT = PATH + WORDS + MEASURES
HIDDEN = 16
ROUNDS = 12
BATCH = 32
RATE = 0.01
DEPTH = 16
STEPS = 60_000  # blocks times pages that are labelled at once

# Elements that do not end a block, elements without content, and elements whose content is no text of the page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle"
    " msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
# Elements whose blocks are refused after labelling, where an end tag closes them and they hold at most half of the page's text.
NEVER = frozenset("nav aside footer menu dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_CONTENT = frozenset(
    "script style noscript template svg textarea select iframe object canvas title audio video annotation annotation-xml".split()
)
# Of these, the ones that run to the page's end if nothing closes them; an unclosed one of the others hides nothing.
RAW = frozenset("script style textarea title iframe".split())
# A start tag closes an open element of the same group.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
# A paragraph also ends where a block element begins.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
KEEPS = frozenset("ul ol dl table".split())  # an item closes no item of an outer list

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[^a-z]+")


@lru_cache(100_000)
def _hashed(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@lru_cache(20_000)
def _element(name: str, attributes: str) -> tuple[str, tuple[int, ...]]:
    """An element's name and the places in the path vector that it fills."""
    tokens = {"<" + name}
    for _, *values in _ATTRIBUTE.findall(attributes):
        for part in _PART.split("".join(values).lower()):
            if len(part) > 1:
                tokens.add(part)
    return name, tuple(sorted({_hashed(t, PATH) for t in tokens}))


@lru_cache(20_000)
def _path(elements: tuple) -> tuple[np.ndarray, frozenset]:
    """Path vector and names of open elements."""
    vector = np.zeros(PATH, np.float32)
    for _, places in elements:
        vector[list(places)] += 1
    return np.minimum(vector, 2), frozenset(n for n, _ in elements)


@dataclass
class Block:
    text: str
    path: np.ndarray  # how often each place of the path vector is filled, 2 at most
    names: frozenset  # open elements
    links: int  # characters inside links
    refused: bool = False  # inside one of NEVER


@dataclass
class _Reader:
    """Collects the blocks of one page."""

    open: list = field(default_factory=list)
    names: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    blocks: list = field(default_factory=list)
    in_link: bool = False
    link_chars: int = 0
    begins: list = field(default_factory=list)  # of every open element the place of its tag and the number of blocks before it
    opened: Counter = field(default_factory=Counter)  # open elements by name
    unclosed: set = field(default_factory=set)  # places of the tags of NEVER that no end tag of theirs closed
    closed: list = field(default_factory=list)  # ranges of blocks inside closed elements of NEVER

    def text(self, raw: str) -> None:
        self.parts.append(raw)
        if self.in_link:
            self.link_chars += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                # Of very deep nesting, the outermost and the innermost elements count.
                deep = self.open if len(self.open) <= 2 * DEPTH else self.open[:DEPTH] + self.open[-DEPTH:]
                self.blocks.append(Block(text, *_path(tuple(deep)), self.link_chars))
            self.parts = []
        self.link_chars = 0

    def push(self, name: str, attributes: str, at: int) -> None:
        self.open.append(_element(name, attributes if "=" in attributes else ""))
        self.names.append(name)
        self.begins.append((at, len(self.blocks)))
        self.opened[name] += 1

    def drop(self, i: int) -> None:
        """Close the elements from the ``i``-th on; none of them has an end tag of its own."""
        self.unclosed.update(at for name, (at, _) in zip(self.names[i:], self.begins[i:]) if name in NEVER)
        self.opened.subtract(self.names[i:])
        del self.open[i:], self.names[i:], self.begins[i:]

    def close(self, names: frozenset, barrier: frozenset = frozenset()) -> None:
        """Close the innermost open element among ``names``, unless one of ``barrier`` stands in between."""
        if not any(self.opened[name] for name in names):
            return
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in names:
                self.drop(i + 1)
                at, first = self.begins[i]
                self.drop(i)
                if at in self.unclosed:  # one of NEVER, closed by its own end tag
                    self.unclosed.remove(at)
                    self.closed.append((first, len(self.blocks)))
                return
            if self.names[i] in barrier:
                return


def blocks_of(page: str | None) -> list[Block]:
    """Text blocks in page order; scripts, styles, comments and other content that is not shown are left out.

    An element of NEVER without an end tag would swallow what follows, so its tag counts for nothing. Blocks of closed
    ones are marked, but for those of an element that holds more than half of the page's text.
    """
    if not page:
        return []
    reader = _read(page, frozenset())
    if reader.unclosed:
        reader = _read(page, frozenset(reader.unclosed))
    ends = np.cumsum([0, *(len(b.text) for b in reader.blocks)])
    outside = np.zeros(len(ends), np.int64)  # where refused ranges begin and end
    for first, last in reader.closed:
        if 2 * (ends[last] - ends[first]) <= ends[-1]:
            outside[first] += 1
            outside[last] -= 1
    for block, depth in zip(reader.blocks, np.cumsum(outside)):
        block.refused = bool(depth)
    return reader.blocks


def _read(page: str, ignored: frozenset) -> _Reader:
    """Read a page without the tags at the places ``ignored``. Every tag is looked at once, so the time is linear."""
    reader, at, endless = _Reader(), 0, set()
    while True:
        m = _TAG.search(page, at)
        if not m:
            if at < len(page):
                reader.text(page[at:])
            break
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        ends = m[1] or m[4]
        if name in INLINE:
            if name == "a":
                reader.in_link = not ends
            elif name == "br":
                reader.text(" ")
            continue
        attributes = m[3] if m[2] else m[6]
        if name in HIDDEN_CONTENT:
            if not ends and not attributes.endswith("/"):
                end = None if name in endless else re.compile(f"</{re.escape(name)}[^>]*>?", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    break
                else:
                    endless.add(name)  # nor does one follow any later tag
            continue
        if m.start() in ignored:
            reader.flush()
            continue
        reader.flush()
        reader.in_link = False
        if ends:
            reader.close(frozenset((name,)))
            continue
        if name in ENDS_P:
            reader.close(_P, _P_STAYS)
        if name in CLOSES and name != "p":
            reader.close(CLOSES[name], KEEPS)
        if name not in VOID:
            reader.push(name, attributes, m.start())
    reader.flush()
    reader.drop(0)
    return reader


_P, _P_STAYS = frozenset(("p",)), frozenset(("td", "th", "li", "div", "article", "section"))


def in_forms(blocks: list[Block]) -> float:
    """Share of a page's text that stands in forms: small for a search box, large where a form holds the whole page."""
    return sum(len(b.text) for b in blocks if "form" in b.names) / max(1, sum(len(b.text) for b in blocks))


def vectors(blocks: list[Block]) -> np.ndarray:
    out, formed = np.zeros((len(blocks), INPUT), np.float32), in_forms(blocks)
    for i, b in enumerate(blocks):
        words = b.text.lower().split()
        x = out[i]
        x[:PATH] = b.path
        x[PATH : PATH + WORDS] = np.bincount([_hashed(w, WORDS) for w in words], minlength=WORDS) / np.sqrt(len(words))
        x[PATH + WORDS :] = [
            np.log1p(len(b.text)) / 5, min(1.0, b.links / len(b.text)), np.log1p(len(words)) / 4,
            float(b.text[-1] in ".!?:;"), float(b.text[0].isupper()), i / len(blocks), float(i == 0), float("©" in b.text),
            2 * formed * ("form" in b.names), 2 * (1 - formed) * ("form" in b.names),
        ]
    return out


# ---- the network -------------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Labeller:
    """Weights of the forward and the backward LSTM and of the output."""

    wx: list  # (INPUT, 4 * HIDDEN) for both directions
    wh: list  # (HIDDEN, 4 * HIDDEN)
    b: list
    out: np.ndarray  # (2 * HIDDEN,)
    bias: np.ndarray  # (1,)

    @staticmethod
    def new(seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.normal(0, 0.5, shape) / np.sqrt(shape[0])).astype(np.float32)
        start = np.zeros(4 * HIDDEN, np.float32)
        start[HIDDEN : 2 * HIDDEN] = 1  # remember by default
        return Labeller(
            [draw(INPUT, 4 * HIDDEN), draw(INPUT, 4 * HIDDEN)], [draw(HIDDEN, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)],
            [start.copy(), start.copy()], draw(2 * HIDDEN), np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, *self.b, self.out, self.bias]

    def _pass(self, x, mask, d, keep=None):
        """States of one direction for ``x`` (time, pages, input); where ``mask`` is 0 nothing changes."""
        steps, pages, _ = x.shape
        gates = x.reshape(steps * pages, -1) @ self.wx[d] + self.b[d]
        gates = gates.reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        hs = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.wh[d]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep is not None:
                keep.append((t, i, f, o, g, c, th, h, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            hs[t] = h
        return hs

    def label(self, x, mask) -> np.ndarray:
        states = np.concatenate([self._pass(x, mask, 0), self._pass(x, mask, 1)], 2)
        return _sigmoid(states @ self.out + self.bias)

    def slopes(self, x, mask, y) -> list[np.ndarray]:
        """Gradient of the mean cross-entropy, by back-propagation through time."""
        kept = ([], [])
        states = [self._pass(x, mask, d, kept[d]) for d in (0, 1)]
        both = np.concatenate(states, 2)
        dz = (_sigmoid(both @ self.out + self.bias) - y) * mask / mask.sum()
        d_out = np.einsum("tbh,tb->h", both, dz)
        dwx, dwh, db = [], [], []
        for d in (0, 1):
            dh_out = dz[:, :, None] * self.out[d * HIDDEN : (d + 1) * HIDDEN]
            dgates = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            gh = np.zeros((4 * HIDDEN, HIDDEN), np.float32)
            dh, dc = np.zeros_like(states[d][0]), np.zeros_like(states[d][0])
            for t, i, f, o, g, c, th, h, m in reversed(kept[d]):
                dh = dh + dh_out[t]
                dm, dcm = dh * m, dc * m
                dc2 = dm * o * (1 - th * th) + dcm
                dzt = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dm * th * o * (1 - o), dc2 * i * (1 - g * g)], 1)
                dgates[t] = dzt
                gh += dzt.T @ h
                dh = dzt @ self.wh[d].T + dh * (1 - m)
                dc = dc2 * f + dc * (1 - m)
            flat = dgates.reshape(-1, 4 * HIDDEN)
            dwx.append(x.reshape(len(flat), -1).T @ flat)
            dwh.append(gh.T)
            db.append(flat.sum(0))
        return [*dwx, *dwh, *db, d_out, np.array([dz.sum()], np.float32)]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 3, rounds: int = ROUNDS) -> Labeller:
    """Adam over batches of pages with similar lengths; ``pages`` are (vectors, labels)."""
    net, rng = Labeller.new(seed), np.random.default_rng(seed)
    pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
    first, second, step = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    for n in range(rounds):
        starts = list(range(0, len(pages), BATCH))
        rng.shuffle(starts)
        for s in starts:
            batch = pages[s : s + BATCH]
            x, mask = _padded([p[0] for p in batch])
            # Often without their words, so that layout alone must do.
            x[:, :, PATH : PATH + WORDS] *= rng.random((*mask.shape, 1)) < 0.5
            y, _ = _padded([p[1][:, None].astype(np.float32) for p in batch])
            step += 1
            rate = RATE * (1 - n / rounds * 0.8)
            for w, g, a, b in zip(net.weights(), net.slopes(x, mask, y[:, :, 0]), first, second):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def label_pages(net: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of being main text for every block; pages of similar length are read together."""
    out: list = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    while order:
        take = max(1, min(len(order), STEPS // len(pages[order[0]])))
        while take > 1 and take * len(pages[order[take - 1]]) > STEPS:
            take //= 2
        now, order = order[:take], order[take:]
        x, mask = _padded([pages[i] for i in now])
        p = net.label(x, mask)
        for j, i in enumerate(now):
            out[i] = p[: len(pages[i]), j]
    return out


# ---- what it learns from -----------------------------------------------------------------------------

MAIN = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu head dialog button".split())
# Layouts: containers of main text, and of everything else; their words are names that sites commonly use.
MAIN_BOXES = (
    "<article>", "<main>", '<main><article class="post">', '<div class="content">', '<div id="main-content">', '<div class="article-body">',
    '<div class="post-content entry">', '<section class="story">', '<div id="content" role="main">', '<article class="article">', "<body><article>", "",
)
SIDE_BOXES = (
    "<nav>", '<nav class="menu">', '<div class="nav">', '<ul class="menu">', "<header>", '<div class="header">', '<div id="header" class="site-header">',
    "<footer>", '<div class="footer">', '<div id="footer">', "<aside>", '<aside class="sidebar">', '<div class="sidebar widget">', '<div id="sidebar">',
    '<div class="ad">', '<div class="ads banner">', '<div class="advert sponsored">', '<div class="promo">', '<aside class="ad">',
    '<div class="cookie-notice">', '<div class="notice cookie consent">', '<div id="cookie-banner" role="alert">', '<div class="popup modal">',
    '<form>', '<form class="search">', '<form class="newsletter subscribe">', '<div class="breadcrumbs">', '<div class="share social">',
    '<div class="related links">', '<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="commentlist">',
    '<div class="user-comments replies">', '<div class="copyright">', '<div role="navigation">', '<div role="complementary">', '<div role="banner">',
)
# Around the whole page; some servers put every page into one form.
WRAPS = (("", ""), ('<div class="wrapper page">', "</div>"), ("<form>", "</form>"), ('<form method="post"><div class="page">', "</div></form>"))
INSIDE = tuple(n for n, box in enumerate(SIDE_BOXES) if "header" not in box)  # may also stand within the main box
INSIDE += 4 * tuple(n for n, box in enumerate(SIDE_BOXES) if box.startswith("<form"))


def _closing(box: str) -> str:
    return "".join(f"</{n}>" for n in reversed(re.findall(r"<(\w+)", box)) if n != "body")


def lesson(texts: list[str], others: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page in a random layout with ``texts`` as main text and pieces of ``others`` around it, with labels."""
    mark = "\x02"

    def side(boxes) -> str:
        box = SIDE_BOXES[boxes[rng.integers(len(boxes))]]
        kind, n = rng.integers(4), int(rng.integers(1, 6))
        pieces = [others[rng.integers(len(others))] for _ in range(n)]
        pieces = [html.escape(p if rng.random() < 0.4 else " ".join(p.split()[: int(rng.integers(1, 9))])) for p in pieces]
        if kind == 0:
            inner = "<ul>" + "".join(f'<li><a href="#">{p}</a></li>' for p in pieces) + "</ul>"
        elif kind == 1:
            inner = "".join(f"<p>{p}</p>" for p in pieces)
        elif kind == 2:
            inner = pieces[0]
        else:
            inner = f"<h3>{pieces[0]}</h3>" + "".join(f"<div>{p}</div>" for p in pieces)
        return box + inner + _closing(box)

    everywhere = list(range(len(SIDE_BOXES)))
    before = "".join(side(everywhere) for _ in range(rng.integers(0, 5)))
    after = "".join(side(everywhere) for _ in range(rng.integers(0, 5)))
    box = MAIN_BOXES[rng.integers(len(MAIN_BOXES))]
    body = []
    for i, t in enumerate(texts):
        tag = ("h1", "h2")[rng.integers(2)] if i == 0 and rng.random() < 0.8 else ("p", "p", "p", "li", "blockquote", "h2", "pre", "div", "td")[rng.integers(9)]
        body.append(f"<{tag}>{mark}{html.escape(t)}" + (f"</{tag}>" if rng.random() < 0.9 else ""))
        if rng.random() < 0.08:
            body.append(side(INSIDE))
    wrap = WRAPS[rng.choice(len(WRAPS), p=(0.45, 0.35, 0.1, 0.1))]
    found = blocks_of(f"<html><body>{wrap[0]}{before}{box}{''.join(body)}{_closing(box)}{after}{wrap[1]}</body></html>")
    labels = np.array([mark in b.text for b in found], bool)
    for b in found:
        b.text = b.text.replace(mark, "") or "."
    return found, labels


_SIDE_WORDS = frozenset("ad ads advert nav menu header footer sidebar comment comments cookie notice banner form".split())


def lessons(pages: list[str], seed: int = 5, layouts: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training data of marked-up pages as they are, and of their texts in other layouts."""
    rng, out, read = np.random.default_rng(seed), [], []
    side_places = {_hashed(w, PATH) for w in _SIDE_WORDS} - {_hashed("<" + n, PATH) for n in ("html", "body", "article", "main", "p", "h1", "div", "li", "ul", "section")}
    for page in pages:
        found = blocks_of(page)
        # A form that holds most of the page says nothing about its blocks.
        aside, places = (ASIDE - {"form"}, side_places - {_hashed("<form", PATH)}) if in_forms(found) > 0.5 else (ASIDE, side_places)
        main = np.array([
            bool(MAIN & b.names) and not aside & b.names and not any(b.path[p] for p in places) for b in found
        ], bool)
        if main.any():
            out += [(vectors(found), main)] * 2
            read.append(([b.text for b, m in zip(found, main) if m], [b.text for b in found]))
    others = [t for _, texts in read for t in texts] or ["Home", "Contact", "All rights reserved"]
    own = [texts for texts, _ in read] or [["A first paragraph.", "And a second one, somewhat longer."]]
    for texts in own * (layouts if read else 50):
        found, labels = lesson(texts[: int(rng.integers(1, 40))], others, rng)
        out.append((vectors(found), labels))
    return out


def train_labeller(pages: DataFrame, page_id: str = "page_id", page: str = "html", size: int = SAMPLE) -> Labeller:
    """Train on the ``size`` pages with the smallest hashes of their ids; equal tables give equal networks."""
    ids = pages.select(F.col(f"`{page_id}`").alias("id")).where("id IS NOT NULL").distinct()
    chosen = ids.orderBy(F.xxhash64("id", F.lit(23)), "id").limit(size)
    named = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{page}`").alias("html"))
    rows = named.join(F.broadcast(chosen), "id").where(F.length("html") <= SAMPLE_CHARS)
    rows = rows.groupBy("id").agg(F.min("html").alias("html"))
    sample = sorted((r["id"], r["html"] or "") for r in rows.collect())
    return train(lessons([h for _, h in sample]))


def main_text(blocks: list[Block], chances: np.ndarray) -> str:
    return "\n".join(b.text for b, p in zip(blocks, chances) if p >= 0.5 and not b.refused)


def extract_main_text(pages: DataFrame, net: Labeller, page: str = "html", text: str = "text") -> DataFrame:
    """Add ``text``: the blocks labelled as main text, white space collapsed, joined by line ends.

    The whole page is read. A null or empty page, or one without main text, gives an empty text; unclosed and
    broken markup is read as far as possible; repeated rows stay; a column named like the new one is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in pages.columns if c != text]
    inner = pages.select(*[F.col(f"`{c}`") for c in kept if c != page], F.col(f"`{page}`").alias("_page"))
    rest = [c for c in kept if c != page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                blocks = [blocks_of(h) for h in part.column(len(rest)).to_pylist()]
                chances = label_pages(shared.value, [vectors(b) for b in blocks])
                texts = [main_text(bs, ps) for bs, ps in zip(blocks, chances)]
                columns = [part.column(i) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*rest, text])

    return inner.mapInArrow(run, widened(inner.drop("_page"), **{text: "string"}))
