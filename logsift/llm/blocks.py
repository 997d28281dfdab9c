"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags. A bidirectional LSTM (numpy) reads
the sequence of all blocks, each as a vector of its tag path (names, classes, ids and roles of the open
elements), of its hashed words and of a few figures, and labels every block as main text or not, with the whole
document as context.

It is trained here, on a bounded sample of the pages themselves: blocks inside or outside of an article element are
labelled by that, and further pages are laid out from the sample's own texts in other ways that authors
mark up articles, menus, notices, adverts, forms and comments, where the label of each block is known.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, utf8_bodies

#: Different pages learnt from at most (those with the smallest hashes), their bytes at most all together, pages learnt from
#: whatever their bytes, pages laid out from each, passes over them, and the blocks labelled at a time.
SAMPLE, SAMPLE_BYTES, LEAST, LAID_OUT, EPOCHS, AT_A_TIME = 96, 3 << 20, 4, 5, 8, 1 << 13
#: Blocks of each label that laid-out pages take from a sample page.
PAGE_BLOCKS = 40

#: Fixed values of HTML: elements that end a block, have no content, hold no page text, and that a tag of the same kind closes.
BLOCK = set("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style title textarea iframe noembed noframes noscript template xmp svg math object".split())
CLOSES = {"li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']*(?:"[^"]*(?:"|\Z)[^>"']*|'[^']*(?:'|\Z)[^>"']*)*))(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")

PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 256, 64, 8, 24
DIM = PATH_DIM + WORD_DIM + FIGURES


@dataclass
class Block:
    path: tuple[str, ...]  # features of the open elements, the innermost last
    leaf: str
    text: str
    linked: float  # share of its characters inside links


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    """Features of an element: its name, and the words of its class, id and role."""
    found = [w for _, v in _NAMED.findall(attributes) for w in _WORD.findall(v.lower())]
    return (f"<{name}>", *(f".{w}" for w in found))


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: character references decoded, white space turned into single spaces, none empty.
    Comments, scripts, styles and other text that is no part of the page are skipped; missing and stray end tags and
    a page that breaks off anywhere are taken as they come."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(parts)
        text = " ".join(raw.split())
        if text:
            path = tuple(m for _, ms in open_ for m in ms)
            out.append(Block(path, open_[-1][0] if open_ else "", text, min(1.0, linked / max(1, len(raw)))))
        parts.clear()
        linked = 0

    def read(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(text := html.unescape(raw))
            if links:
                linked += len(text)

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        read(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                flush()
                k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
                if k is not None:
                    del open_[k:]
            continue
        if name in SILENT:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
        elif name in BLOCK:
            flush()
            links = 0
            if open_ and open_[-1][0] == "p":
                open_.pop()
            while open_ and open_[-1][0] in CLOSES.get(name, ()):
                open_.pop()
            if name not in VOID:
                open_.append((name, _marks(name, m[3])))
        elif name == "a":
            links += 1
        elif name == "br":
            parts.append(" ")
    rest = page[at:]
    cut = re.search(r"<(?:/?[a-zA-Z]|!)[^>]*\Z", rest)
    read(rest[: cut.start()] if cut else rest)
    flush()
    return out


@lru_cache(maxsize=1 << 14)
def _path_vector(path: tuple[str, ...], leaf: str) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for f in {*path, f"leaf {leaf}"}:
        v[zlib.crc32(f.encode()) % PATH_DIM] = 1
    return v


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: tag path, hashed words (as shares), figures."""
    x = np.zeros((len(page), DIM), np.float32)
    for i, b in enumerate(page):
        x[i, :PATH_DIM] = _path_vector(b.path, b.leaf)
        w = b.text.lower().encode().split()
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(np.fromiter(map(zlib.crc32, w), np.int64, len(w)) % WORD_DIM, minlength=WORD_DIM) / len(w)
        chars = Counter(b.text)
        share = lambda kind: sum(n for c, n in chars.items() if kind(c)) / len(b.text)  # noqa: E731, B023
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(len(w)) / 5, b.linked, b.text[-1] in ".!?:", share(str.isupper), share(str.isdigit), i / len(page), b.text[0] == "©", b.leaf[:1] == "h" and b.leaf[1:].isdigit())
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM over padded sequences (time, batch, features), with its gradients."""

    def __init__(self, draw: np.random.Generator | None = None) -> None:
        if draw is not None:
            self.wx = (draw.standard_normal((DIM, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.wh = (draw.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            self.b = np.zeros(4 * HIDDEN, np.float32)
            self.b[HIDDEN : 2 * HIDDEN] = 1  # remembers at first

    def forward(self, x: np.ndarray, keep: bool = False) -> np.ndarray:
        steps, n, _ = x.shape
        pre = (x.reshape(-1, DIM) @ self.wx + self.b).reshape(steps, n, -1)
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        trace = []
        for t in range(steps):
            z = pre[t] + h @ self.wh
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                trace.append((i, f, o, g, before, tc, h))
            h = o * tc
            out[t] = h
        if keep:
            self.trace = (x, trace)
        return out

    def backward(self, dout: np.ndarray) -> list[np.ndarray]:
        x, trace = self.trace
        steps, n, _ = dout.shape
        dz = np.zeros((steps, n, 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(self.wh)
        dh = np.zeros((n, HIDDEN), np.float32)
        dc = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, tc, h = trace[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dwh += h.T @ dz[t]
            dh = dz[t] @ self.wh.T
            dc = dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        return [x.reshape(-1, DIM).T @ flat, dwh, flat.sum(axis=0)]

    def weights(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages as (time, batch, features), the same backwards, and which steps are blocks."""
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), DIM), np.float32)
    y = np.zeros_like(x)
    real = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], y[: len(p), k], real[: len(p), k] = p, p[::-1], True
    return x, y, real


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output."""

    def __init__(self, draw: np.random.Generator) -> None:
        self.ahead, self.back = Direction(draw), Direction(draw)
        self.out = (draw.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def _both(self, pages: list[np.ndarray], keep: bool) -> tuple[np.ndarray, np.ndarray]:
        x, y, real = _padded(pages)
        a, b = self.ahead.forward(x, keep), self.back.forward(y, keep)
        turned = np.zeros_like(b)
        for k, p in enumerate(pages):
            turned[: len(p), k] = b[: len(p), k][::-1]
        return np.concatenate([a, turned], axis=2), real

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page, how likely each block is main text."""
        if not pages:
            return []
        h, _ = self._both(pages, False)
        p = _sigmoid(h @ self.out + self.bias[0])
        return [p[: len(x), k] for k, x in enumerate(pages)]

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        """Logistic loss per block and its gradients, by back-propagation through time."""
        h, real = self._both(pages, True)
        p = _sigmoid(h @ self.out + self.bias[0])
        y = np.zeros_like(p)
        for k, v in enumerate(labels):
            y[: len(v), k] = v
        n = real.sum()
        d = (np.where(real, p - y, 0) / n).astype(np.float32)
        loss = -np.log(np.where(y > 0.5, p, 1 - p)[real] + 1e-9).mean()
        dh = d[:, :, None] * self.out
        db = np.zeros_like(dh[:, :, HIDDEN:])
        for k, v in enumerate(labels):
            db[: len(v), k] = dh[: len(v), k, HIDDEN:][::-1]
        return float(loss), [*self.ahead.backward(dh[:, :, :HIDDEN]), *self.back.backward(db), np.tensordot(d, h, ([0, 1], [0, 1])), np.array([d.sum()], np.float32)]

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights(), *self.back.weights(), self.out, self.bias]


#: How authors name the parts of a page: (element, class) from the outside in. Main text, and all the rest by kind.
MAIN = [("article",), ("main",), ("main", "article"), ("article", "div.content"), ("div.content",), ("div.main-content",), ("div.post", "div.entry-content"), ("div.article-body",), ("section.story",), ("div.page", "div.text"), ("main", "div.article"), ("div.container", "article.post"), ("article.entry",), ()]
MENU = [("nav", "ul"), ("header", "nav", "ul"), ("div.menu", "ul"), ("ul.navbar",), ("div.nav", "ul"), ("header", "ul"), ("div.breadcrumb", "ul"), ("nav",), ("div.navigation",)]
TOP = [("header",), ("div.header",), ("div.banner",), ("div.topbar",), ("div.masthead",), ("header", "div.logo")]
ASIDE = [("aside",), ("div.sidebar",), ("aside.sidebar",), ("div.related", "ul"), ("aside", "ul"), ("div.widget",), ("section.related",), ("div.share",), ("div.social",), ("div.recommended",), ("div.tags",)]
ADVERT = [("div.ad",), ("div.ads",), ("div.advert",), ("div.advertisement",), ("div.sponsored",), ("aside.ad",), ("div.promo",), ("section.ad-slot",)]
NOTICE = [("div.cookie",), ("div.cookie-banner",), ("div.notice",), ("div.consent",), ("div.alert",), ("div.popup",), ("div.modal",), ("div.gdpr",), ("div.disclaimer",)]
FORM = [("form",), ("form.newsletter",), ("div.subscribe", "form"), ("form.search",), ("div.login", "form"), ("div.newsletter",), ("form", "fieldset")]
COMMENT = [("section.comments", "div.comment"), ("div.comments", "ul", "li"), ("div.comments",), ("ol.commentlist", "li.comment"), ("div.discussion",), ("section.comments", "article.comment"), ("div.replies",), ("div.responses", "div.reply"), ("div.reader-comments",)]
FOOT = [("footer",), ("div.footer",), ("footer", "ul"), ("div.copyright",), ("div.bottom",), ("footer", "div.legal")]


def _wrap(path: tuple[str, ...], inner: str) -> str:
    for p in reversed(path):
        name, _, mark = p.partition(".")
        inner = f'<{name} class="{mark}">{inner}</{name}>' if mark else f"<{name}>{inner}</{name}>"
    return inner


def lay_out(main: list[str], other: list[str], draw: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page with the paragraphs ``main`` as its text and parts made of ``other``, and the label of each block. Texts of
    either kind stand in either place over many pages, so that place and markup decide."""
    pick = lambda xs: xs[draw.integers(len(xs))]
    esc = lambda t: html.escape(t, quote=False)
    on, off = "\ue000", "\ue001"  # private-use marks that carry the label through the parser

    def part(kinds: list, tag: str, low: int, high: int, texts: list[str]) -> str:
        path = pick(kinds)
        tag = "li" if path and path[-1] in ("ul", "ol") else tag
        items = [esc(pick(texts)) for _ in range(draw.integers(low, high))]
        if tag == "li" and draw.random() < 0.8:
            items = [f'<a href="#">{" ".join(t.split()[:4])}</a>' for t in items]
        return _wrap(path, "".join(f"<{tag}>{off}{t}</{tag}>" if tag else off + t for t in items))

    def maybe(chance: float, *a) -> str:
        return part(*a) if draw.random() < chance else ""

    inner, anywhere = [], [*other, *main]
    if draw.random() < 0.8:
        inner.append(f"<h1>{on}{esc(' '.join(main[0].split()[:8]))}</h1>")
    for t in main:
        tag = pick(["p"] * 8 + ["h2", "blockquote", "pre", "div", "p"])
        if draw.random() < 0.05:
            inner.append("<ul>" + "".join(f"<li>{on}{esc(x)}</li>" for x in (t, pick(main))) + "</ul>")
        else:
            inner.append(f"<{tag}>{on}{esc(t)}" + (f"</{tag}>" if tag != "p" or draw.random() < 0.8 else ""))
        inner.append(maybe(0.06, ADVERT, pick(["p", ""]), 1, 2, anywhere))
        inner.append(maybe(0.03, ASIDE, "p", 1, 3, anywhere))
    late = maybe(0.25, ASIDE, "p", 1, 4, anywhere) + maybe(0.15, FORM, pick(["p", "label"]), 1, 3, anywhere) + maybe(0.3, COMMENT, "p", 1, 6, anywhere)
    inside = draw.random() < 0.4
    body = _wrap(pick(MAIN), "".join(inner) + (late if inside else "")) + ("" if inside else late)
    first = maybe(0.25, NOTICE, pick(["p", ""]), 1, 2, anywhere) + maybe(0.3, TOP, pick(["p", "", "h1"]), 1, 2, anywhere) + maybe(0.8, MENU, "li", 2, 8, anywhere) + maybe(0.4, ADVERT, pick(["p", ""]), 1, 2, anywhere) + maybe(0.15, ASIDE, "p", 1, 4, anywhere)
    last = maybe(0.2, ADVERT, "p", 1, 2, anywhere) + maybe(0.3, NOTICE, "p", 1, 2, anywhere) + maybe(0.85, FOOT, pick(["p", ""]), 1, 3, anywhere)
    got = blocks(f"<html><body>{first}{body}{last}</body></html>")
    y = np.array([on in b.text for b in got], np.float32)
    for b in got:
        b.text = b.text.replace(on, "").replace(off, "").strip() or "."
    return got, y


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """Labels by the article element (or main), for pages that have one: what is in it is main text but for parts of it that
    say otherwise by their element."""
    inside = np.array([("<article>" in b.path or "<main>" in b.path) for b in page], bool)
    if not inside.any() or inside.all():
        return None
    out = {"<nav>", "<aside>", "<footer>", "<form>", "<header>"}
    return np.array([k and not (out & set(b.path)) for k, b in zip(inside, page, strict=True)], np.float32)


def fit(pages: list[str], laid_out: int = LAID_OUT, epochs: int = EPOCHS, page_blocks: int = PAGE_BLOCKS) -> Labeller:
    """Trains a labeller on sample pages and on pages laid out from their texts (Adam, batches of pages of similar length). The
    same pages in the same order give the same labeller. Sample pages are learnt from whole; laid-out pages draw on the first
    ``page_blocks`` blocks of either label of each, which bounds what is held of a very long one."""
    draw = np.random.default_rng(11)
    model = Labeller(draw)
    data: list[tuple[np.ndarray, np.ndarray]] = []
    main: list[list[str]] = []
    other: list[str] = []
    for p in pages:
        got = blocks(p)
        if not got:
            continue
        y = weak_labels(got)
        if y is not None:
            data.append((vectors(got), y))
        keep = y if y is not None else np.ones(len(got))
        main.append([b.text for b, k in zip(got, keep, strict=True) if k][:page_blocks])
        other += [b.text for b, k in zip(got, keep, strict=True) if not k][:page_blocks]
    main = [m for m in main if m] or [["Text."]]
    for k in range(laid_out * len(main)):
        got, y = lay_out(main[k % len(main)][: int(draw.integers(1, 25))], other or main[0], draw)
        data.append((vectors(got), y))
    data.sort(key=lambda d: len(d[0]))
    batches: list[list] = []
    for d in data:  # a batch is padded to its longest page, the last
        if not batches or len(batches[-1]) == 24 or (len(batches[-1]) + 1) * len(d[0]) > AT_A_TIME:
            batches.append([])
        batches[-1].append(d)
    m, v = ([np.zeros_like(w) for w in model.weights()] for _ in range(2))
    t = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - 0.8 * epoch / epochs)
        for k in draw.permutation(len(batches)):
            _, grads = model.step([x for x, _ in batches[k]], [y for _, y in batches[k]])
            t += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for w, g, a, b in zip(model.weights(), grads, m, v, strict=True):
                g = g * min(1.0, 5 / (size + 1e-9))
                a[:] = 0.9 * a + 0.1 * g
                b[:] = 0.99 * b + 0.01 * g * g
                w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    model.ahead.trace = model.back.trace = None
    return model


def sample_of(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[str]:
    """The pages learnt from, in the order of their hashes: of the ``sample`` different pages with the smallest, those that fit
    one after another into ``sample_bytes``, and the shortest of the others if these are fewer than ``LEAST``. Copies count once."""
    key = ["hash", "size"]
    rows = pages.select(F.make_valid_utf8(F.col(html_col)).alias("html")).filter(F.octet_length("html") > 0).select("html", F.xxhash64("html").alias("hash"), F.octet_length("html").alias("size"))
    rest = [tuple(r) for r in rows.select(*key).distinct().orderBy(*key).limit(sample).collect()]
    chosen, left = [], sample_bytes
    for k in rest:
        if k[1] <= left:
            chosen.append(k)
            left -= k[1]
    chosen += sorted(set(rest) - set(chosen), key=lambda k: (k[1], k[0]))[: max(0, LEAST - len(chosen))]
    found = rows.filter(F.col("hash").isin([h for h, _ in chosen])).groupBy(*key).agg(F.min("html").alias("html")).collect() if chosen else []
    texts = {(r.hash, r.size): r.html for r in found}
    return [texts[k] for k in sorted(chosen)]


def learn(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Labeller:
    """Fits on ``sample_of`` the pages. Every page is labelled, whatever the bounds."""
    return fit(sample_of(pages, html_col, sample, sample_bytes))


def main_text(page: list[Block], p: np.ndarray) -> str:
    """The blocks labelled as main text, in page order."""
    return "\n".join(b.text for b, k in zip(page, p, strict=True) if k >= 0.5)


def _extractor(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Labeller = model.value
        for b in batches:
            texts = [""] * b.num_rows
            waiting: list[tuple[int, list[Block]]] = []
            held = 0

            def label() -> None:
                nonlocal held
                waiting.sort(key=lambda w: len(w[1]))
                for k in range(0, len(waiting), 64):  # pages of similar length side by side
                    part = waiting[k : k + 64]
                    for (r, page), p in zip(part, m.probabilities([vectors(page) for _, page in part]), strict=True):
                        texts[r] = main_text(page, p)
                waiting.clear()
                held = 0

            for r, body in enumerate(utf8_bodies(b.column("html"))):
                if page := blocks(body.decode()):
                    waiting.append((r, page))
                    held += len(page)
                    if held >= AT_A_TIME:
                        label()
            label()
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "main_text", "n_chars"])

    return run


def extract(pages: DataFrame, html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """(row, main_text, n_chars) of every page: the struct ``row`` has its other columns, whatever their names.

    Null and empty pages, and pages without text, give an empty text; repeated rows give the same; a page is never cut; bytes that are
    not UTF-8 count as U+FFFD; without a model one is fitted first; an empty table gives an empty result."""
    share = pages.sparkSession.sparkContext.broadcast(model or learn(pages, html_col))
    rest = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("none"))
    rows = pages.select(row.alias("row"), F.make_valid_utf8(F.col(html_col)).alias("html"))
    return arrow(rows, _extractor(share), T.StructType([rows.schema["row"], T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())]))
