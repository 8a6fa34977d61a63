"""Main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks (text between block-level tags, with
the path of open tags). Every block turns into a vector: hashed tag-path
tokens, hashed words, and a few numbers (length, link share, place). A
bidirectional LSTM in numpy reads the whole sequence, so each block is judged in
the context of the entire page, and labels it main text or not.

Training needs no hand labels: on a bounded sample of pages (``SAMPLE_PAGES``
of at most ``SAMPLE_CHARS`` characters, by a hash of the page id) blocks are
labelled from what their paths say, and each page also enters in altered forms:
its article under another container, and menus, notices, sidebars, adverts,
forms and reader comments put around it, so that the labeller learns layouts
beyond those of the sample. All pages are labelled, whatever their size.

Defined results: null html is empty; a page without main blocks gives an empty
text; pages are independent of each other, repeated rows are each extracted; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_chars
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep_one_per, ship

SAMPLE_PAGES = 160
SAMPLE_CHARS = 100_000
#: consecutive blocks that one training sequence holds (a page with more is several sequences; labelling reads pages whole)
TRAIN_BLOCKS = 80
PATH_DIM, WORD_DIM, HIDDEN = 96, 48, 24
NUMBERS = 6
DIM = PATH_DIM + WORD_DIM + NUMBERS

#: elements whose content is not text of the page
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "col", "embed", "hr", "link", "meta", "param", "source", "track", "wbr"}
#: an open element that the next one of its kind ends
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

_BAD_TAG = {"nav", "footer", "aside", "form", "menu", "button", "header", "dialog"}
_GOOD_TAG = {"article", "main"}
_BAD_NAME = re.compile(r"^(?:ads?|advert\w*|banner|cookie\w*|consent|notice\w*|comments?|replies|sidebar|menu|nav\w*|footer|header|promo\w*|"
                       r"related|share|social|subscribe|newsletter|breadcrumbs?|popup|modal|sponsor\w*|widget|disqus|login)$")
_GOOD_NAME = re.compile(r"^(?:article|content|post|entry|story|main|body)$")


@dataclass
class Block:
    path: list[str]  # tokens of the open elements: tag, and tag.name for each word of class, id and role
    text: str
    link_chars: int


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order: maximal runs of text without a block-level tag, white space levelled."""
    page = page or ""
    out: list[Block] = []
    open_: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    links = in_link = 0
    pos = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block([t for _, tokens in open_ for t in tokens], text, min(links, len(text))))
            parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        text = html_chars.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            links += len(text)

    while True:
        m = _TAG.search(page, pos)
        if m is None:
            if pos < len(page):
                add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        closing = m.group(1) == "/"
        if name in RAW and not closing:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
                pos = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    in_link = 0
                    break
        elif name not in VOID and not m.group(3).endswith("/"):
            if name in SELF_CLOSING and open_ and open_[-1][0] == name:
                open_.pop()
            tokens = [name]
            for x in _NAMES.finditer(m.group(3)):
                tokens += [f".{w}" for w in re.split(r"[^a-z]+", (x[2] or x[3] or x[4] or "").lower()) if w]
            open_.append((name, tokens))
    flush()
    return out


_BUCKETS: dict[str, tuple[int, float]] = {}


def _bucket(token: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % dim, 1.0 if h & 0x80000000 else -1.0


def _word_bucket(word: str) -> tuple[int, float]:
    got = _BUCKETS.get(word)
    if got is None:
        if len(_BUCKETS) > 200_000:
            _BUCKETS.clear()
        got = _BUCKETS[word] = _bucket(word, WORD_DIM)
    return got


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), DIM), dtype=np.float32)
    paths: dict[tuple, np.ndarray] = {}
    for k, b in enumerate(blocks):
        key = tuple(b.path)
        v = paths.get(key)
        if v is None:
            v = np.zeros(PATH_DIM, dtype=np.float32)
            for t in set(b.path):
                i, sign = _bucket(t, PATH_DIM)
                v[i] += sign
            for t in b.path[-2:]:  # the innermost elements once more, as themselves
                i, sign = _bucket("/" + t, PATH_DIM)
                v[i] += sign
            paths[key] = v
        x[k, :PATH_DIM] = v
        words = b.text.lower().split(" ")
        hashed = [_word_bucket(w) for w in words]
        w = np.bincount([h[0] for h in hashed], weights=[h[1] for h in hashed], minlength=WORD_DIM)
        x[k, PATH_DIM:PATH_DIM + WORD_DIM] = w / math.sqrt(len(words))
        n = len(b.text)
        x[k, -NUMBERS:] = (math.log1p(len(words)) / 4, b.link_chars / n, sum(map(b.text.count, ".,;!?")) / len(words),
                           k / len(blocks), 1.0 - k / len(blocks), 1.0 if b.text[-1] in ".!?…\"" else 0.0)
    return x


def path_label(path: list[str]) -> int | None:
    """What a path says by itself: 1 main text, 0 not, None nothing."""
    good = any(t in _GOOD_TAG or (t[0] == "." and _GOOD_NAME.match(t[1:])) for t in path)
    bad = any((t in _BAD_TAG and not (t == "header" and good)) or (t[0] == "." and _BAD_NAME.match(t[1:])) for t in path)
    return 0 if bad else 1 if good else None


def weak_labels(blocks: list[Block]) -> list[int]:
    said = [path_label(b.path) for b in blocks]
    if any(s == 1 for s in said):
        return [s or 0 for s in said]
    return [int(len(b.text.split()) >= 12 and b.link_chars * 3 < len(b.text)) if s is None else s for s, b in zip(said, blocks)]


PLAIN_PAGE = ("<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/all'>All texts</a></li></ul></nav><article><h1>The title of a text</h1>"
              + "<p>Some sentences of a longer text, with a few words in each of them. They go on for a while.</p>" * 6
              + "</article><footer>Contact and terms</footer></body>")

_CONTAINERS = [["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".post", ".body"], ["section", ".story"],
               ["div", ".entry", ".content"], ["div", ".main"], ["div", ".article"], ["div"]]
_AROUND = [(["nav", "ul", "li"], 3, 1.0), (["div", ".menu", "ul", "li"], 3, 1.0), (["header", "div", ".logo"], 4, 0.5),
           (["div", ".cookie", ".notice", "p"], 18, 0.0), (["div", ".ad"], 9, 0.0), (["div", ".advert", ".banner", "p"], 9, 0.2),
           (["aside", "p"], 25, 0.1), (["aside", ".sidebar", "div", "p"], 25, 0.1), (["form", "p"], 5, 0.0), (["div", ".newsletter", "form"], 9, 0.0),
           (["div", ".related", "ul", "li"], 7, 1.0), (["footer", "p"], 10, 0.3), (["div", ".footer"], 10, 0.3)]
_COMMENTS = [["section", ".comments", "div", ".comment", "p"], ["div", ".comments", "ul", "li"], ["div", ".comment", ".list", "div", ".comment", "p"],
             ["ol", ".replies", "li", "p"]]


def altered(blocks: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page's main blocks in another container, with other matter around them and comments below."""
    words = [w for b in blocks for w in b.text.split()] or ["text"]

    def some(n: int) -> str:
        at = int(rng.integers(0, len(words)))
        return " ".join((words[at:] + words)[:max(1, int(rng.poisson(n)))])

    def around(count: int) -> list[Block]:
        out = []
        for _ in range(count):
            path, n, link = _AROUND[int(rng.integers(0, len(_AROUND)))]
            for _ in range(int(rng.integers(1, 6)) if "li" in path else 1):
                text = some(n)
                out.append(Block(["html", "body", *path], text, int(len(text) * link)))
        return out

    box = _CONTAINERS[int(rng.integers(0, len(_CONTAINERS)))]
    main = [Block(["html", "body", *box, *[t for t in b.path if t in ("p", "h1", "h2", "h3", "li", "ul", "blockquote", "td")][-1:]], b.text, b.link_chars)
            for b, y in zip(blocks, labels) if y]
    cut = int(rng.integers(0, len(main) + 1)) if rng.random() < 0.5 else len(main)
    middle = around(1) if cut < len(main) else []
    for b in middle:  # an advert or notice inside the article
        b.path = ["html", "body", *box, *b.path[2:]]
    path = _COMMENTS[int(rng.integers(0, len(_COMMENTS)))]
    comments = [Block(["html", "body", *path], some(20), 0) for _ in range(int(rng.integers(1, 8)))] if rng.random() < 0.6 else []
    before, after = around(int(rng.integers(1, 4))), around(int(rng.integers(0, 4)))
    seq = [(b, 0) for b in before] + [(b, 1) for b in main[:cut]] + [(b, 0) for b in middle] + [(b, 1) for b in main[cut:]]
    seq += [(b, 0) for b in comments] + [(b, 0) for b in after]
    return [b for b, _ in seq], [y for _, y in seq]


class BiLSTM:
    """One LSTM per direction and a logistic output on both states of a block."""

    def __init__(self, rng: np.random.Generator, dim: int = DIM, hidden: int = HIDDEN):
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in ("f", "b"):
            self.p["x" + d] = rng.normal(0, 1 / math.sqrt(dim), (dim, 4 * hidden)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 1 / math.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden:2 * hidden] = 1.0  # remember at first
            self.p["c" + d] = bias
        self.p["o"] = rng.normal(0, 0.3, (2 * hidden,)).astype(np.float32)
        self.p["ob"] = np.zeros(1, dtype=np.float32)

    @staticmethod
    def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence of (time, page, ...) the other way round, within its own length."""
        t = np.arange(len(x))[:, None]
        src = np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)
        return np.take_along_axis(x, src.reshape(src.shape + (1,) * (x.ndim - 2)), axis=0)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        steps, pages, _ = x.shape
        n = self.hidden
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        pre = x @ self.p["x" + d] + self.p["c" + d]
        hs, cache = np.empty((steps, pages, n), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ self.p["h" + d]
            gates = 1 / (1 + np.exp(-np.clip(z[:, :3 * n], -30, 30)))
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            g = np.tanh(z[:, 3 * n:])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                cache.append((before, i, f, o, g, tc))
        return hs, cache

    def logits(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        forward, _ = self._run(x, "f", False)
        backward, _ = self._run(self._flip(x, lengths), "b", False)
        both = np.concatenate([forward, self._flip(backward, lengths)], axis=2)
        return both @ self.p["o"] + self.p["ob"]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray):
        n = self.hidden
        turned = self._flip(x, lengths)
        forward, cf = self._run(x, "f", True)
        backward, cb = self._run(turned, "b", True)
        both = np.concatenate([forward, self._flip(backward, lengths)], axis=2)
        mask = (np.arange(len(x))[:, None] < lengths[None, :]).astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["ob"], -30, 30)))
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum()
        e = ((p - y) * mask / mask.sum()).astype(np.float32)
        grad = {"o": np.tensordot(e, both, axes=([0, 1], [0, 1])), "ob": np.array([e.sum()], np.float32)}
        back = e[:, :, None] * self.p["o"]
        for d, inp, hs, cache, dh_all in (("f", x, forward, cf, back[:, :, :n]), ("b", turned, backward, cb, self._flip(back[:, :, n:], lengths))):
            dz_all = np.empty((*hs.shape[:2], 4 * n), np.float32)
            dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
            gh = np.zeros_like(self.p["h" + d])
            for t in range(len(hs) - 1, -1, -1):
                (h0, c0), i, f, o, g, tc = cache[t]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh, dc = dz @ self.p["h" + d].T, dc * f
            grad["x" + d] = np.tensordot(inp, dz_all, axes=([0, 1], [0, 1]))
            grad["h" + d] = gh
            grad["c" + d] = dz_all.sum(axis=(0, 1))
        return float(loss), grad


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in seqs])
    x = np.zeros((int(lengths.max()), len(seqs), DIM), dtype=np.float32)
    for k, s in enumerate(seqs):
        x[:len(s), k] = s
    return x, lengths


def train(pages: list[str], seed: int = 7, epochs: int = 6, batch: int = 24) -> BiLSTM:
    """Fit on the given (bounded) pages and their altered forms with Adam."""
    rng = np.random.default_rng(seed)
    model = BiLSTM(rng)
    parsed = [(b, weak_labels(b)) for b in map(blocks_of, pages)]
    parsed = [(b[i:i + TRAIN_BLOCKS], y[i:i + TRAIN_BLOCKS]) for b, y in parsed for i in range(0, len(b), TRAIN_BLOCKS)]
    if not parsed:  # no usable page in the sample: learn from altered forms of one plain page
        plain = blocks_of(PLAIN_PAGE)
        parsed = [(plain, weak_labels(plain))] * 40
    seqs = [(vectors(b), y) for b, y in parsed]
    for b, y in parsed:
        for _ in range(2):
            bb, yy = altered(b, y, rng)
            if bb:
                seqs.append((vectors(bb), yy))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for a in range(0, len(order), batch):
            some = [seqs[i] for i in order[a:a + batch]]
            x, lengths = padded([s for s, _ in some])
            y = np.zeros(x.shape[:2], np.float32)
            for k, (_, lab) in enumerate(some):
                y[:len(lab), k] = lab
            _, grad = model.gradients(x, lengths, y)
            step += 1
            norm = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                model.p[k] = model.p[k] - 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def label(model: BiLSTM, pages: list[list[Block]], cells: int = 20_000) -> list[np.ndarray]:
    """Per page, whether each block is main text. Pages of like length run together, at most about ``cells`` blocks at once."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= cells:
            b += 1
        x, lengths = padded([vectors(pages[k]) for k in order[a:b]])
        z = model.logits(x, lengths)
        for j, k in enumerate(order[a:b]):
            out[k] = z[:lengths[j], j] > 0
        a = b
    return out


def extract_pages(model: BiLSTM, pages: list[str | None]) -> list[str]:
    parsed = [blocks_of(p) for p in pages]
    return ["\n".join(b.text for b, main in zip(blocks, keep) if main) for blocks, keep in zip(parsed, label(model, parsed))]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> BiLSTM:
    rows = (pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
            .filter((F.length("html") > 0) & (F.length("html") <= SAMPLE_CHARS)).withColumn("h", F.xxhash64("html")))
    chosen = rows.select("id", "h").distinct().orderBy(F.xxhash64("id"), "id", "h").limit(sample)  # ids first: no task sends pages
    picked = rows.alias("r").join(F.broadcast(chosen).alias("c"), F.expr("r.id <=> c.id AND r.h = c.h"), "left_semi")
    one = keep_one_per(picked, ["id", "h"]).orderBy(F.xxhash64("id"), "id", "h")
    return train([r["html"] for r in one.collect()])  # at most sample * SAMPLE_CHARS characters


def extract(pages: DataFrame, model: BiLSTM, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, also..., text): the main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = extract_pages(shared.value, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    picked = pages.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in also], F.col(f"`{html_col}`").cast("string").alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return ship(picked).mapInArrow(run, f"{fields}, text string")
