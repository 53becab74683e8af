"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks in order: runs of text between block-level tags, with the
tags above them. Each block becomes a vector: embeddings of its hashed tag path (all names, and all
class, id and role words), embeddings of all its hashed words, and numbers (length, links, place).
A bidirectional LSTM in numpy reads a page's whole sequence and labels every block as article or
not, so a block is judged by all that surrounds it.

The labeller is trained here, on at most MOST_PAGES pages (distinct ones, those of least hash,
whatever their length), without labels: blocks inside article or main elements, and outside
navigation and the like, are articles; further pages are made from the same blocks by
putting them under other tags and class names, as other sites would, with comments, forms,
notices and sidebars around and between them. Of a page of more than RUN blocks, RUN neighbouring
ones are learnt from, where its hash says. The pages are read where they lie; the driver gets
what the labeller sees of them, some kilobytes a block at most. Pages without such elements teach
nothing, as it is not known what their article is.

Text that is never shown (scripts, styles, templates, the head, comments in the markup) is not
a block. ``br`` is white space within its block. Reading is linear in the page, however deep its
elements nest and however many it leaves open; labelling keeps no states but the last.

Defined results: null and empty html, and a page without article blocks, give an empty text;
repeated rows are read again; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from launchgrid.llm.storage import bounded_batches
from launchgrid.llm.textkit import slices, utf8, words

# HTML's own tag classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup svg time tt u var wbr nobr ruby rt rp br picture source input math mi mo mn ms mtext mrow mfrac msup msub msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg select textarea canvas audio video".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
IMPLIED = {t: (SIBLINGS[t], SCOPE[t]) for t in SIBLINGS} | {t: ({"p"}, {"td", "th", "li", "div", "article", "section", "body", "table"}) for t in CLOSES_P}

PATHS, WORDS = 1 << 11, 1 << 11
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN_DIM = 16, 6, 8, 16
MOST_PAGES, RUN, COPIES, EPOCHS = 240, 300, 3, 6
KNOWN_PATHS = 50_000  # tag paths that a worker keeps
PAGES_AT_ONCE, BLOCKS_AT_ONCE, STEPS_AT_ONCE = 100, 20_000, 512

ARTICLE_NAMES = frozenset("article main".split())
OUTER_NAMES = frozenset("nav footer aside form header".split())
OUTER_WORDS = frozenset("ad ads comment comments share related".split())


def _hash(s: str, size: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % size


class Path:
    """A tag path: its last tag, the hashes of all its names and words as one bit mask, its depth,
    and whether it is an article's by the page's own elements. Paths of the same steps are one object."""

    __slots__ = ("_ids", "below", "depth", "inside", "mask", "spoilt", "tag")

    def __init__(self, tag: str = "", mask: int = 0, depth: int = 0, inside: bool = False, spoilt: bool = False):
        self.tag, self.mask, self.depth, self.inside, self.spoilt = tag, mask, depth, inside, spoilt
        self.below: dict[tuple[str, tuple[str, ...]], Path] = {}
        self._ids: np.ndarray | None = None

    def step(self, tag: str, own: tuple[str, ...] = ()) -> tuple[Path, bool]:
        """The path one tag further, and whether it is a new object."""
        found = self.below.get((tag, own))
        if found is not None:
            return found, False
        mask = self.mask | 1 << _hash(tag, PATHS)
        for w in own:
            mask |= 1 << _hash("." + w, PATHS)
        inside = self.inside or tag in ARTICLE_NAMES
        spoilt = self.spoilt or (inside and (tag in OUTER_NAMES or not OUTER_WORDS.isdisjoint(own)))
        found = self.below[tag, own] = Path(tag, mask, self.depth + 1, inside, spoilt)
        return found, True

    def of(self, steps: tuple[tuple[str, tuple[str, ...]], ...]) -> Path:
        at = self
        for tag, own in steps:
            at, _ = at.step(tag, own)
        return at

    @property
    def article(self) -> bool:
        return self.inside and not self.spoilt

    def ids(self) -> np.ndarray:
        """The hashes of its names and words, and of its last tag as such."""
        if self._ids is None:
            mask = self.mask | 1 << _hash("^" + self.tag, PATHS)
            self._ids = np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(PATHS // 8, "little"), np.uint8), bitorder="little"))
        return self._ids


class Blocks(HTMLParser):
    """Leaf blocks of one page: (path, text, characters inside links)."""

    root, known = Path(), 0  # shared by a worker's pages

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        if Blocks.known > KNOWN_PATHS:
            Blocks.root, Blocks.known = Path(), 0
        self.stack: list[tuple[str, Path]] = []
        self.open: dict[str, list[int]] = {}  # where each tag is on the stack
        self.hidden = 0
        self.out: list[tuple[Path, str, int]] = []
        self.text: list[str] = []
        self.links = 0
        self.path = Blocks.root

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.out.append((self.path, text, self.links))
            self.text, self.links = [], 0

    def _pop_to(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.hidden -= tag in HIDDEN
            self.open[tag].pop()
        del self.stack[at:]

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _implied_ends(self, tag: str) -> None:
        if tag not in IN_HEAD and self.open.get("head"):
            self._pop_to(self.open["head"][-1])
        if tag in IMPLIED:
            closing, scope = IMPLIED[tag]
            end = self._last(closing)
            if end >= 0:
                limit = self._last(scope)
                while end > limit:
                    self._pop_to(end)
                    end = self._last(closing)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.end_block()
            self._implied_ends(tag)
        if tag not in VOID:
            own = tuple(re.sub(r"\d+", "0", w) for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for w in re.split(r"[^a-z0-9]+", v.lower()) if w) if attrs else ()
            path = self.stack[-1][1] if self.stack else Blocks.root
            if own or tag not in INLINE:
                path, new = path.step(tag, own)
                Blocks.known += new
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append((tag, path))
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_block()
        if self.open.get(tag):
            self._pop_to(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.stack[-1][0] != "head" or data.isspace():
                return
            self._pop_to(len(self.stack) - 1)  # text ends a head left open
            if self.hidden:
                return
        if not self.text:
            self.path = self.stack[-1][1] if self.stack else Blocks.root
        self.text.append(data)
        if self.open.get("a"):
            self.links += len(data)


def closed(html: str) -> str:
    """The page with comments, marked sections and tags that are never closed made plain text, which they
    are to a reader of the whole page: the parser would look for the end of each anew."""
    for opens, ends in (("<!--", "-->"), ("<![", "]"), ("<", ">")):
        at = html.find(opens, html.rfind(ends) + 1)
        if at >= 0:
            html = html[:at] + html[at:].replace("<", "&lt;") if opens == "<" else html[:at] + html[at:].replace(opens, "&lt;" + opens[1:])
    return html


def blocks(html: str) -> list[tuple[Path, str, int]]:
    parser = Blocks()
    parser.feed(closed(html))
    parser.close()
    parser.end_block()
    return parser.out


class Block(NamedTuple):
    """What the labeller sees of a block; ``facts``: code points, words, characters in links, whether a
    sentence ends it, stops. ``ids`` and ``times``: hashed words and how often each is there."""

    path: Path
    facts: tuple[float, ...]
    ids: np.ndarray
    times: np.ndarray


@dataclass
class Vectors:
    """Sparse inputs of a page's blocks: path and word ids, their owners and weights, and numbers."""

    n: int
    path_ids: np.ndarray
    path_own: np.ndarray
    word_ids: np.ndarray
    word_own: np.ndarray
    word_times: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, paths: list[Path], facts: np.ndarray, word_ids: np.ndarray, word_own: np.ndarray, word_times: np.ndarray, at: int = 0, of: int | None = None) -> Vectors:
        """``at`` and ``of``: the first block's place in its page, and the page's blocks."""
        n = len(paths)
        ids = [p.ids() for p in paths]
        size, count, links, ends, stops = facts.T
        place = np.arange(at, at + n)
        depth = np.fromiter((p.depth for p in paths), float, n)
        numbers = np.stack([np.log1p(size) / 5, np.log1p(count) / 4, np.minimum(links / np.maximum(size, 1), 1), ends, stops / np.maximum(count, 1), place / (of or max(n, 1)), place == 0, np.minimum(depth, 12) / 6], 1) if n else np.zeros((0, NUMBERS))
        own = np.repeat(np.arange(n), [len(x) for x in ids])
        return cls(n, np.concatenate([np.zeros(0, np.int64), *ids]), own, word_ids, word_own, word_times, numbers)

    @classmethod
    def made(cls, page: list[Block], at: int = 0, of: int | None = None) -> Vectors:
        none = np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(page)), [len(b.ids) for b in page])
        facts = np.array([b.facts for b in page], float).reshape(-1, 5)
        return cls.of([b.path for b in page], facts, np.concatenate([none, *(b.ids for b in page)]), own, np.concatenate([none, *(b.times for b in page)]), at, of)


def read(pages: list[str | None]) -> tuple[list[list[tuple[Path, str, int]]], list[Vectors]]:
    """The blocks of each page, and what the labeller sees of them; words are hashed all at once."""
    found = [blocks(h) if h else [] for h in pages]
    _, hashes, counts, facts = _facts(found)
    ids, ends, out, at = (hashes % np.uint64(WORDS)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), [], 0
    for page in found:
        n = len(page)
        i, j = ends[at], ends[at + n]
        out.append(Vectors.of([b[0] for b in page], facts[at : at + n], ids[i:j], np.repeat(np.arange(n), counts[at : at + n]), np.ones(j - i)))
        at += n
    return found, out


def _facts(found: list[list[tuple[Path, str, int]]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of several pages: texts, hashes of their words, words per block, and facts."""
    texts = [t for page in found for _, t, _ in page]
    hashes, _, _, counts = words(*utf8(pa.array(texts, pa.string())))
    size = np.fromiter(map(len, texts), float, len(texts))
    links = np.fromiter((k for page in found for _, _, k in page), float, len(texts))
    ends = np.fromiter((t[-1] in ".!?" for t in texts), float, len(texts))
    stops = np.fromiter((t.count(".") + t.count(",") + t.count(";") for t in texts), float, len(texts))
    return texts, hashes, counts, np.stack([size, counts.astype(float), links, ends, stops], 1)


def _mean(table: np.ndarray, ids: np.ndarray, own: np.ndarray, times: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``table`` of each owner (ascending) over the root of how many they are, and how many."""
    size = np.bincount(own, times, n)
    out = np.zeros((n, table.shape[1]), table.dtype)
    if len(own):
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        rows = table[ids]
        out[own[starts]] = np.add.reduceat(rows if times is None else rows * times[:, None].astype(table.dtype), starts)
    size = np.maximum(size, 1)
    return out / np.sqrt(size)[:, None].astype(table.dtype), size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states [time, pages, hidden] of a padded batch; masked steps carry the state on."""
    steps, pages, _ = x.shape
    h = c = np.zeros((pages, HIDDEN_DIM))
    out, kept = np.empty((steps, pages, HIDDEN_DIM)), []
    pre = x @ w + b
    for t in range(steps):
        z = pre[t] + h @ u
        i, f, o, g = (z[:, k * HIDDEN_DIM : (k + 1) * HIDDEN_DIM] for k in range(4))
        i, f, o, g = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g)
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        kept.append((h, c, i, f, o, g, tc))
        h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, kept


def _states(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same, unmasked, with no state kept but the last; STEPS_AT_ONCE steps' inputs at a time."""
    steps, pages, _ = x.shape
    h = c = np.zeros((pages, HIDDEN_DIM), x.dtype)
    out = np.empty((steps, pages, HIDDEN_DIM), x.dtype)
    for at in range(0, steps, STEPS_AT_ONCE):
        pre = x[at : at + STEPS_AT_ONCE] @ w + b
        for t in range(len(pre)):
            z = pre[t] + h @ u
            s = _sigmoid(z[:, : 3 * HIDDEN_DIM])
            c = s[:, HIDDEN_DIM : 2 * HIDDEN_DIM] * c + s[:, :HIDDEN_DIM] * np.tanh(z[:, 3 * HIDDEN_DIM :])
            h = out[at + t] = s[:, 2 * HIDDEN_DIM :] * np.tanh(c)
    return out


def _lstm_back(dout: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    steps, pages, _ = x.shape
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.empty_like(x)
    dh = dc = np.zeros((pages, HIDDEN_DIM))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = kept[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        dhm, dcm = m * dh, m * dc
        dct = dcm + dhm * o * (1 - tc**2)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - g**2)], 1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w.T
        dh, dc = dz @ u.T + (1 - m) * dh, dct * f + (1 - m) * dc
    return dx, dw, du, db


class Labeller:
    """The two embedding tables, the two LSTMs and the output layer."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS
        make = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"path": r.normal(0, 0.3, (PATHS, PATH_DIM)), "word": r.normal(0, 0.1, (WORDS, WORD_DIM)), "out": make(2 * HIDDEN_DIM + PATH_DIM, 1)[:, 0], "bias": np.zeros(1)}
        for k in "fb":
            self.p |= {f"w{k}": make(d, 4 * HIDDEN_DIM), f"u{k}": make(HIDDEN_DIM, 4 * HIDDEN_DIM), f"b{k}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN_DIM)}

    @staticmethod
    def inputs(p: dict[str, np.ndarray], v: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A page's [blocks, inputs], and how many path and word ids each block has."""
        a, sa = _mean(p["path"], v.path_ids, v.path_own, None, v.n)
        b, sb = _mean(p["word"], v.word_ids, v.word_own, v.word_times, v.n)
        return np.concatenate([a, b, v.numbers.astype(a.dtype)], 1), sa, sb

    def forward(self, pages: list[Vectors]) -> tuple[np.ndarray, tuple]:
        """Logits [time, pages] of a batch, and what the way back needs."""
        p = self.p
        steps = max(v.n for v in pages)
        x = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + NUMBERS))
        mask = np.zeros((steps, len(pages)))
        sizes = []
        for j, v in enumerate(pages):
            x[: v.n, j], sa, sb = self.inputs(p, v)
            mask[: v.n, j] = 1
            sizes.append((sa, sb))
        hf, kf = _lstm(x, p["wf"], p["uf"], p["bf"], mask)
        hb, kb = _lstm(x[::-1], p["wb"], p["ub"], p["bb"], mask[::-1])
        top = np.concatenate([hf, hb[::-1], x[:, :, :PATH_DIM]], 2)
        return top @ p["out"] + p["bias"], (x, mask, kf, kb, top, sizes)

    def gradients(self, pages: list[Vectors], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        p = self.p
        logit, (x, mask, kf, kb, top, sizes) = self.forward(pages)
        y = np.zeros_like(mask)
        for j, lab in enumerate(labels):
            y[: len(lab), j] = lab
        d = (_sigmoid(logit) - y) * mask / mask.sum()
        g = {"out": np.einsum("tph,tp->h", top, d), "bias": np.array([d.sum()])}
        dtop = d[:, :, None] * p["out"]
        dx, g["wf"], g["uf"], g["bf"] = _lstm_back(dtop[:, :, :HIDDEN_DIM], x, p["wf"], p["uf"], mask, kf)
        back, g["wb"], g["ub"], g["bb"] = _lstm_back(dtop[::-1, :, HIDDEN_DIM : 2 * HIDDEN_DIM], x[::-1], p["wb"], p["ub"], mask[::-1], kb)
        dx = dx + back[::-1]
        dx[:, :, :PATH_DIM] += dtop[:, :, 2 * HIDDEN_DIM :]
        g["path"], g["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
        for j, (v, (sa, sb)) in enumerate(zip(pages, sizes, strict=True)):
            own = dx[: v.n, j]
            np.add.at(g["path"], v.path_ids, (own[:, :PATH_DIM] / np.sqrt(sa)[:, None])[v.path_own])
            np.add.at(g["word"], v.word_ids, (own[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.sqrt(sb)[:, None])[v.word_own] * v.word_times[:, None])
        return g

    def fit(self, pages: list[Vectors], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 24, seed: int = 5) -> Labeller:
        """Adam; pages of like length share a batch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, step = np.argsort([v.n for v in pages], kind="stable"), 0
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for _ in range(epochs):
            for k in r.permutation(len(groups)):
                g = self.gradients([pages[i] for i in groups[k]], [labels[i] for i in groups[k]])
                step += 1
                for name, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    m[name] += 0.1 * (grad - m[name])
                    s[name] += 0.01 * (grad**2 - s[name])
                    self.p[name] -= 0.02 * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[Vectors]) -> list[np.ndarray]:
        """Which blocks of each page are article."""
        p = {k: v.astype(np.float32) for k, v in self.p.items()}
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: pages[i].n) if pages[i].n]
        at = 0
        while at < len(order):  # pages of like length together, or one long page
            end = at + 1
            while end < len(order) and (end + 1 - at) * pages[order[end]].n <= BLOCKS_AT_ONCE:
                end += 1
            group = [pages[i] for i in order[at:end]]
            # Each page begins at step 0 in both directions, so the padding is at the end.
            ahead = np.zeros((group[-1].n, len(group), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
            back = np.zeros_like(ahead)
            for j, v in enumerate(group):
                ahead[: v.n, j] = self.inputs(p, v)[0]
                back[: v.n, j] = ahead[: v.n, j][::-1]
            h, k = p["out"][:HIDDEN_DIM], p["out"][HIDDEN_DIM : 2 * HIDDEN_DIM]
            logit = _states(ahead, p["wf"], p["uf"], p["bf"]) @ h + ahead[:, :, :PATH_DIM] @ p["out"][2 * HIDDEN_DIM :] + p["bias"]
            other = _states(back, p["wb"], p["ub"], p["bb"]) @ k
            for j, (i, v) in enumerate(zip(order[at:end], group, strict=True)):
                out[i] = logit[: v.n, j] + other[: v.n, j][::-1] > 0
            at = end
        return out


# What sites call the parts of a page; for the pages made for training.
ARTICLE_TAGS = [("article", ()), ("main", ()), ("article", ("post",)), ("div", ("content",)), ("div", ("article", "body")), ("section", ("story",)), ("div", ("entry", "content")), ("div", ("post", "text")), ("div", ("main",)), ("div", ("article",)), ("main", ("page", "content")), ("td", ("content",)), ("div", ("text",)), ("div", ("body",))]
OUTSIDE = {
    "top": [("nav", ()), ("header", ()), ("div", ("header",)), ("div", ("nav",)), ("div", ("navbar",)), ("div", ("menu",)), ("ul", ("menu",)), ("div", ("cookie", "notice")), ("div", ("cookie", "banner")), ("div", ("topbar",)), ("div", ("breadcrumb",)), ("div", ("notice",)), ("div", ("alert",)), ("div", ("consent",)), ("div", ("banner",)), ("div", ("ad",)), ("div", ("masthead",)), ("div", ("search",)), ("form", ())],
    "within": [("div", ("ad",)), ("aside", ()), ("div", ("ads",)), ("div", ("advert",)), ("div", ("promo",)), ("div", ("share",)), ("div", ("social",)), ("div", ("newsletter",)), ("form", ()), ("div", ("sponsored",)), ("aside", ("related",)), ("div", ("notice",)), ("nav", ()), ("div", ("subscribe",)), ("figure", ("ad",))],
    "after": [("aside", ()), ("footer", ()), ("div", ("footer",)), ("div", ("sidebar",)), ("aside", ("sidebar",)), ("section", ("comments",)), ("div", ("comments",)), ("div", ("comment",)), ("ol", ("comment", "list")), ("ul", ("comments",)), ("div", ("related",)), ("div", ("recommended",)), ("form", ("comment", "form")), ("div", ("widget",)), ("div", ("newsletter",)), ("div", ("copyright",)), ("div", ("disqus", "thread")), ("section", ("reader", "comments")), ("div", ("responses",)), ("div", ("ad",)), ("nav", ("pagination",))],
}
BODY = (("html", ()), ("body", ()))


def silver(page: list[tuple[Path, str, int]] | list[Block]) -> np.ndarray:
    """Labels that the page's own article or main elements imply."""
    return np.fromiter((b[0].article for b in page), bool, len(page))


def _made(page: list[Block], label: np.ndarray, other: list[Block], r: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page's blocks under tags that another site might use."""
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    root = Path()
    wrap = (("div", (pick(["wrapper", "container", "page", "layout", "site", "outer"]),)),) if r.random() < 0.5 else ()
    holder = (pick(ARTICLE_TAGS),) if r.random() < 0.85 else ()
    inner = (("div", (pick(["inner", "col", "row", "text", "body"]),)),) if r.random() < 0.3 else ()
    plain = [b for b, a in zip(page, label, strict=True) if not a]
    home = Block(root, (4.0, 1.0, 4.0, 0.0, 0.0), np.array([_hash("home", WORDS)]), np.ones(1))
    out, lab = [], []

    def put(path: tuple, b: Block, links: float, is_article: bool) -> None:
        out.append(Block(root.of(path), (*b.facts[:2], links, *b.facts[3:]), b.ids, b.times))
        lab.append(is_article)

    def outside(where: str, times: int, in_holder: bool) -> None:
        for _ in range(times):
            path = BODY + wrap + (holder + inner if in_holder else ()) + (pick(OUTSIDE[where]),)
            if r.random() < 0.3:
                path += (("div", (pick(["inner", "item", "row", "box"]),)),)
            leaf = pick([(), (("p", ()),), (("ul", ()), ("li", ())), (("li", ()),), (("h3", ()),), (("div", ()),)])
            for _ in range(int(r.integers(1, 6))):
                long = r.random() < 0.5
                b = pick(other) if long and other else pick(plain) if plain else home
                put(path + leaf, b, 0.0 if long else b.facts[2], False)

    outside("top", int(r.integers(1, 5)), False)
    first = True
    for b, a in zip(page, label, strict=True):
        if a:
            leaf = pick([(("h1", ()),), (("h1", ("title",)),), (("h2", ()),)]) if first or r.random() < 0.05 else (("p", ()),) if r.random() < 0.8 else pick([(("blockquote", ()), ("p", ())), (("ul", ()), ("li", ())), (("pre", ()),), (("div", ()),), (("td", ()),), ()])
            put(BODY + wrap + holder + inner + leaf, b, 0.0, True)
            first = False
            if r.random() < 0.08:
                outside("within", 1, r.random() < 0.8)
    outside("after", int(r.integers(1, 6)), r.random() < 0.3)
    if r.random() < 0.7:
        outside("after", int(r.integers(1, 3)), False)
    return out, np.array(lab)


SAMPLE = {"key": pa.int64(), "at": pa.int64(), "of": pa.int64(), "tags": pa.list_(pa.string()), "masks": pa.list_(pa.binary()), "depths": pa.list_(pa.int32()), "articles": pa.list_(pa.bool_()), "facts": pa.list_(pa.list_(pa.float64())), "ids": pa.list_(pa.list_(pa.int32())), "times": pa.list_(pa.list_(pa.int32()))}


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the labeller sees of a page, or of RUN neighbouring blocks of a long one."""
    for batch in batches:
        for key, html in zip(batch.column("key").to_pylist(), batch.column("html"), strict=True):
            page = blocks(html.as_py())
            at = key % (len(page) - RUN + 1) if len(page) > RUN else 0
            part = page[at : at + RUN]
            _, hashes, counts, facts = _facts([part])
            each = np.split((hashes % np.uint64(WORDS)).astype(np.int64), np.cumsum(counts)[:-1]) if part else []
            ids, times = zip(*(np.unique(own, return_counts=True) for own in each), strict=True) if part else ((), ())
            paths = [b[0] for b in part]
            row = [key, at, len(page), [p.tag for p in paths], [p.mask.to_bytes(PATHS // 8, "little") for p in paths], [p.depth for p in paths], [p.article for p in paths], facts.tolist(), ids, times]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, SAMPLE.values(), strict=True)], names=list(SAMPLE))


def sample(pages: DataFrame, most_pages: int = MOST_PAGES, html_col: str = "html") -> list[tuple[list[Block], int, int]]:
    """(blocks, first one's place, blocks of the whole page) of at most ``most_pages`` distinct pages, in order of hash."""
    keyed = pages.select(F.xxhash64(html_col).alias("key"), F.col(html_col).alias("html")).filter(F.col("html") != "")
    keys = keyed.select("key").distinct().orderBy("key").limit(most_pages)
    own = keyed.join(F.broadcast(keys), "key").groupBy("key").agg(F.min("html").alias("html"))
    out = []
    for r in own.mapInArrow(_sampled, from_arrow_schema(pa.schema(list(SAMPLE.items())))).orderBy("key").toLocalIterator():
        paths = [Path(t, int.from_bytes(m, "little"), d, a) for t, m, d, a in zip(r.tags, r.masks, r.depths, r.articles, strict=True)]
        out.append(([Block(p, tuple(f), np.array(i, np.int64), np.array(n, float)) for p, f, i, n in zip(paths, r.facts, r.ids, r.times, strict=True)], r["at"], r["of"]))
    return out


def train(pages: DataFrame, most_pages: int = MOST_PAGES, html_col: str = "html") -> Labeller:
    """Fit to at most ``most_pages`` pages and pages made from them."""
    r = np.random.default_rng(11)
    known = [(p, silver(p), at, of) for p, at, of in sample(pages, most_pages, html_col) if p]
    other = [b for p, a, _, _ in known for b, x in zip(p, a, strict=True) if x]
    some = [x for x in known if x[1].any()]
    own = [(Vectors.made(p, at, of), a) for p, a, at, of in some]
    made = [_made(p, a, other, r) for p, a, _, _ in some for _ in range(COPIES)]
    every = own + [(Vectors.made(p), a) for p, a in made]
    return Labeller().fit([v for v, _ in every], [a.astype(float) for _, a in every]) if every else Labeller()


def main_text(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the article blocks of each page, one line each."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(labeller or train(pages, html_col=html_col))
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                for i in range(0, some.num_rows, PAGES_AT_ONCE):
                    part = some.slice(i, PAGES_AT_ONCE)
                    found, vectors = read(part.column("html").to_pylist())
                    marks = shared.value.label(vectors)
                    texts = ["\n".join(t for (_, t, _), keep in zip(p, a, strict=True) if keep) for p, a in zip(found, marks, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = T.StructType([T.StructField(id_col, plain.schema["id"].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return plain.mapInArrow(run, kind)
