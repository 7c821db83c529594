"""Main text of web pages by a linear-chain conditional random field (operator 9).

A tolerant parser turns a page into leaf blocks: runs of text between block
boundaries, each with its open ancestors. A two-state CRF (main text or not)
over the blocks, with features of ancestor tags, their class and id words and
the text itself, is trained by gradient ascent on labelled pages and decoded
by Viterbi. The labelled pages are written by ``labelled_pages`` from page
layouts in common use, so training needs no table and is bounded.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, elements whose text is never shown, inline elements. (Fixed values of the HTML standard.)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe object svg math canvas audio video select datalist".split())
RAW = frozenset("script style title textarea iframe noscript template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Hidden elements that may stand inside a sentence without ending it.
_SILENT = frozenset("script style template noscript".split())
#: An opening tag that ends an open element of the set. (Fixed values of the HTML standard.)
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}

#: Comments, declarations and tags. A quote that never closes does not hide the rest of the page: its tag ends at the next ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)", re.S)
#: Any attribute, its name and its quoted or bare value, so that no name is looked for inside a value.
_ATTR = re.compile(r"([^\s/=][^\s/=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_MARKS = frozenset({"class", "id", "role"})
_SPACE = re.compile(r"\s+")


class Frame:
    """An open element. What the field reads of all its block-level ancestors is kept in shared sets, so depth costs nothing."""

    __slots__ = ("tag", "marks", "up", "block", "tags", "known", "hidden", "mute", "linked", "emission")

    def __init__(self, tag: str, marks: tuple[str, ...], hidden: bool, up: Frame | None):
        inline = tag in INLINE
        self.tag, self.marks, self.up = tag, marks, up
        #: the nearest open element that is not inline, itself included
        self.block: Frame | None = (up.block if up else None) if inline else self
        tags, known = (up.tags, up.known) if up else (frozenset(), frozenset())
        new = {m for m in marks if m in CHROME or m in MAIN}
        self.tags = tags if inline or tag in tags else tags | {tag}
        self.known = known if inline or new <= known else known | new
        self.hidden = bool(up and up.hidden) or hidden and not inline
        self.mute = bool(up and up.mute) or hidden and inline
        self.linked = bool(up and up.linked) or tag == "a"
        self.emission: np.ndarray | None = None


@dataclass
class Block:
    text: str
    #: the innermost block-level element around the text
    frame: Frame | None
    linked: int

    def _path(self) -> list[Frame]:
        out, f = [], self.frame
        while f:
            if f.block is f:
                out.append(f)
            f = f.up
        return out[::-1]

    @property
    def tags(self) -> tuple[str, ...]:
        return tuple(f.tag for f in self._path())

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(m for f in self._path() for m in f.marks)

    @property
    def hidden(self) -> bool:
        return bool(self.frame and self.frame.hidden)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, their white space folded; blocks without text are left out."""
    out: list[Block] = []
    top: Frame | None = None
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = at = 0
    owner: Frame | None = None

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, owner, linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, owner
        if top and top.mute:
            return
        if not parts or owner is None:
            owner = top.block if top else None
        parts.append(text)
        if top and top.linked:
            linked += len(text)

    def close(until: Frame) -> None:
        """Closes open elements up to ``until``, itself included."""
        nonlocal top
        while top is not until:
            open_tags[top.tag] -= 1
            top = top.up
        open_tags[top.tag] -= 1
        top = top.up

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            if open_tags[tag]:
                f = top
                while f.tag != tag:
                    f = f.up
                close(f)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE and tag not in _SILENT:
            flush()
            f = top.block if top else None
            if f and (f.tag == "p" or f.tag in CLOSES.get(tag, ())):
                close(f)
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        marks, hidden = [], tag in HIDDEN
        for key, value in _ATTR.findall(m[3]):
            key = key.lower()
            if key == "hidden" or key == "aria-hidden" and "true" in value.lower():
                hidden = True
            elif key in _MARKS:
                marks += re.findall(r"[a-z]+", value.lower())
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            if tag == "textarea":
                kept, top = top, Frame(tag, tuple(marks), hidden, top)
                add(page[at : end.start() if end else n])
                flush()
                top = kept
            at = end.end() if end else n
            continue
        top = Frame(tag, tuple(marks), hidden, top)
        open_tags[tag] += 1
    flush()
    return out


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


#: Words of class, id and role attributes that say what a part of a page is.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget related recommended "
    "share sharing social cookie cookies consent notice alert popup modal newsletter subscribe signup login form search comment comments reply replies disqus discussion pagination pager tags toc copyright legal disclaimer skip toolbar".split()
)
MAIN = frozenset("article main content post entry story body text page".split())


def around(frame: Frame | None) -> list[str]:
    """Features of a block's ancestors."""
    if frame is None:
        return ["tag="]
    f = [f"tag={frame.tag}", *(f"in={t}" for t in frame.tags), *(f"mark={m}" for m in frame.known)]
    if not frame.known.isdisjoint(CHROME):
        f.append("chrome")
    return f


def said(b: Block) -> list[str]:
    """Features of a block's own text."""
    n = len(b.text)
    share = b.linked / max(n, 1)
    f = [f"len={min(n.bit_length(), 10)}", "link=" + ("none" if share == 0 else "some" if share < 0.5 else "most"), "end=" + ("stop" if b.text[-1] in ".!?…\"'" else "other")]
    return [*f, "copyright"] if "©" in b.text else f


def features(b: Block) -> list[str]:
    return around(b.frame) + said(b)


#: Emissions that a field remembers.
MEMO = 10_000


class CRF:
    """Two states; emission weights by feature, start and transition weights."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.w = np.zeros((len(names), 2))
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.memo: dict[tuple, np.ndarray] = {}

    def emit(self, feats: list[list[str]]) -> np.ndarray:
        return np.array([self.w[[self.index[x] for x in f if x in self.index]].sum(0) for f in feats])

    def emissions(self, found: list[Block]) -> np.ndarray:
        """Emission scores of blocks; those of equal features are worked out once."""
        return np.array([self._ancestors(b.frame) + self._score(tuple(said(b))) for b in found])

    def _ancestors(self, frame: Frame | None) -> np.ndarray:
        if frame is None:
            return self._score(tuple(around(None)))
        if frame.emission is None:
            key = (frame.tag, frame.tags, frame.known)
            frame.emission = self.memo[key] if key in self.memo else self._score(key, around(frame))
        return frame.emission

    def _score(self, key: tuple, feats: list[str] | None = None) -> np.ndarray:
        """The emission of features; ``key`` stands for them, and at most ``MEMO`` are remembered."""
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            (got,) = self.emit([list(key) if feats is None else feats])
            self.memo[key] = got
        return got

    def decode(self, e: np.ndarray) -> list[int]:
        """Viterbi over emission scores; ties to the state that leaves the block out."""
        (aa, ab), (ba, bb) = self.move.tolist()
        x, y = (self.start + e[0]).tolist()
        back: list[tuple[int, int]] = []
        for u, v in e[1:].tolist():
            to_a, to_b = int(y + ba > x + aa), int(y + bb > x + ab)
            back.append((to_a, to_b))
            x, y = max(x + aa, y + ba) + u, max(x + ab, y + bb) + v
        path = [int(y > x)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def fit(self, data: list[tuple[list[list[str]], list[int]]], epochs: int = 25, rate: float = 0.5, l2: float = 1e-4) -> CRF:
        """Stochastic ascent of the log-likelihood by forward and backward sums."""
        pages = []
        for feats, y in data:
            at = [[self.index[x] for x in f if x in self.index] for f in feats]
            pages.append((np.array([i for a in at for i in a], int), np.repeat(np.arange(len(at)), [len(a) for a in at]), np.eye(2)[y], y))
        for epoch in range(epochs):
            step = rate / (1 + epoch / 5)
            for at, row, gold, y in pages:
                n = len(y)
                e = np.zeros((n, 2))
                np.add.at(e, row, self.w[at])
                grow = np.exp(self.move)
                local = np.exp(e - e.max(1, keepdims=True))
                a, b = np.empty((n, 2)), np.ones((n, 2))  # each row scaled to a sum of 1
                a[0] = np.exp(self.start - self.start.max()) * local[0]
                a[0] /= a[0].sum()
                for i in range(1, n):
                    x = (a[i - 1] @ grow) * local[i]
                    a[i] = x / x.sum()
                for i in range(n - 2, -1, -1):
                    x = grow @ (local[i + 1] * b[i + 1])
                    b[i] = x / x.sum()
                p = a * b
                p /= p.sum(1, keepdims=True)
                self.start += step * (gold[0] - p[0])
                if n > 1:
                    pair = a[:-1, :, None] * grow * (local[1:] * b[1:])[:, None, :]
                    pair /= pair.sum((1, 2), keepdims=True)
                    self.move += step / n * (gold[:-1].T @ gold[1:] - pair.sum(0))
                np.add.at(self.w, at, (step / np.sqrt(n) * (gold - p))[row])
                self.w *= 1 - step * l2
        self.memo.clear()
        return self


def labelled_pages(count: int, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages in several layouts with a label for each block (1: main text)."""
    rng = random.Random(seed)
    words = "ba de ki lo mu na po ra su ti ve wo xa yo zu".split()

    def say(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def chrome(kind: str) -> tuple[str, int]:
        link = lambda: f'<a href="/x">{say(1, 3)}</a>'
        if kind == "nav":
            k = rng.randint(1, 7)
            box = rng.choice(['<nav>{}</nav>', '<div class="menu">{}</div>', '<div id="nav-bar">{}</div>', '<header><nav class="main-nav">{}</nav></header>'])
            return box.format("<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"), k
        if kind == "comments":
            k = rng.randint(1, 4)
            box = rng.choice(['<section id="comments">{}</section>', '<div class="comments">{}</div>', '<div class="reader-comment">{}</div>'])
            return box.format("".join(f"<p>{say(3, 40)}.</p>" for _ in range(k))), k
        if kind == "form":
            return rng.choice(['<form>{}</form>', '<div class="newsletter"><form>{}</form></div>', '<form class="search">{}</form>']).format(f"<p>{say(2, 8)}</p><label>{say(1, 2)}</label><input><button>{say(1, 1)}</button>"), 3
        box = {
            "ad": ['<div class="ad">{}</div>', '<div class="advert">{}</div>', '<aside class="sponsored">{}</aside>', '<div id="banner-ad">{}</div>'],
            "side": ['<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div class="related">{}</div>', '<div class="widget">{}</div>'],
            "notice": ['<div class="cookie-notice">{}</div>', '<div role="alert">{}</div>', '<div class="notice">{}</div>', '<dialog>{}</dialog>'],
            "header": ['<header>{}</header>', '<div class="header">{}</div>', '<div id="masthead">{}</div>'],
            "footer": ['<footer>{}</footer>', '<div class="footer">{}</div>', '<div id="footer">{}</div>'],
        }[kind]
        text = say(2, 30) + rng.choice([".", ""])
        if kind == "footer" and rng.random() < 0.6:
            text = "&copy; " + text
        inner = rng.choice(["{}", "<p>{}</p>", "<p>{}</p>", "<span>{}</span>"])
        return rng.choice(box).format(inner.format(text)), 1

    pages = []
    for _ in range(count):
        out, y = ["<html><head><title>t</title></head><body>"], []
        if rng.random() < 0.1:  # nothing but text
            y = [1] * rng.randint(1, 4)
            pages.append((out[0] + "".join(rng.choice(["<p>{}.</p>", "<div>{}.</div>", "<p>{}</p>"]).format(say(2, 40)) for _ in y), y))
            continue

        def put(kinds: list[str]) -> None:
            for kind in kinds:
                if rng.random() < 0.6:
                    h, k = chrome(kind)
                    out.append(h)
                    y.extend([0] * k)

        put(["notice", "header", "nav", "ad"])
        opening, closing = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>"), ("", "")])
        out.append(opening)
        if rng.random() < 0.8:
            out.append(rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>"]).format(say(1, 9)))
            y.append(1)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.08:
                put(["ad"])
            elif kind < 0.14:
                put(["side", "form"])
            if kind < 0.75:
                out.append(f"<p>{say(1, 60)}{rng.choice(['.', '.', ''])}</p>")
            elif kind < 0.83:
                out.append(f"<h2>{say(1, 5)}</h2>")
            elif kind < 0.88:
                out.append(f"<blockquote>{say(4, 20)}.</blockquote>")
            elif kind < 0.93:
                out.append(f"<pre>{say(4, 20)}</pre>")
            elif kind < 0.96:
                out.append(f'<p><a href="/y">{say(1, 3)}</a> {say(3, 20)}.</p>')
            else:
                out.append(f"<table><tr><td>{say(1, 3)}</td></tr></table>")
            y.append(1)
            if kind > 0.97:
                out.append(f"<ul><li>{say(2, 9)}</li></ul>")
                y.append(1)
        out.append(closing)
        put(["ad", "side", "comments", "form", "footer"])
        out.append("</body></html>")
        pages.append(("".join(out), y))
    return pages


TRAIN_PAGES = 240


@cache
def trained(pages: int = TRAIN_PAGES) -> CRF:
    data = []
    for page, y in labelled_pages(pages):
        found = blocks(page)
        if len(found) == len(y):
            data.append(([features(b) for b in found], y))
    names = sorted({f for feats, _ in data for row in feats for f in row})
    return CRF(names).fit(data)


def extract(page: str, crf: CRF) -> list[str]:
    """Texts of the main blocks in page order."""
    found = [b for b in blocks(page) if not b.hidden]
    if not found:
        return []
    return [b.text for b, s in zip(found, crf.decode(crf.emissions(found))) if s]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages, and pages without main text, give an empty text;
    pages of any length and depth are read whole; where both labels score
    alike a block is left out. Repeated rows give repeated rows; an empty
    table gives no rows; other columns are ignored.
    """
    crf = trained()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n\n".join(extract(h, crf)) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
