"""Main-text extraction with a recurrent block labeller.

A page is a sequence of leaf blocks.  A bidirectional LSTM in numpy reads each block's tag-path and hashed-word vector
and says for every block, with the whole page as context, whether it belongs to the article.

The labeller is trained here, on pages that ``training_pages`` makes up: templates with menus, notices, adverts,
sidebars, comments, forms and footers around an article, under many spellings of class names, so that each block's
label is known.  No table is read for it.  ``python -m citeloom.llm.html_lstm`` trains (seeded, PAGES pages, EPOCHS
passes, about half a minute) and writes the weights beside this module, a few hundred kilobytes; a query only loads
them on the driver and broadcasts them.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.html_blocks import FEATURES, Block, blocks, features

HIDDEN_UNITS = 24
PAGES = 1_500
EPOCHS = 6
RATE = 0.02
SEED = 11
#: Blocks whose features are in memory at a time, and padded blocks that go through the network together.
STEP = 4_096
BATCH = 8_192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction.  Gates stand in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator, n_in: int, n: int) -> None:
        self.n = n
        self.w = (rng.standard_normal((n_in, 4 * n)) / np.sqrt(32)).astype(np.float32)
        self.u = (rng.standard_normal((n, 4 * n)) / np.sqrt(n)).astype(np.float32)
        self.b = np.zeros(4 * n, np.float32)
        self.b[n : 2 * n] = 1.0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        n, steps = self.n, len(x)
        pre = x @ self.w + self.b
        h, c = np.zeros((steps + 1, n), np.float32), np.zeros((steps + 1, n), np.float32)
        gates = np.empty((steps, 4 * n), np.float32)
        for t in range(steps):
            z = pre[t] + h[t] @ self.u
            g = gates[t]
            g[: 3 * n] = _sigmoid(z[: 3 * n])
            g[3 * n :] = np.tanh(z[3 * n :])
            c[t + 1] = g[n : 2 * n] * c[t] + g[:n] * g[3 * n :]
            h[t + 1] = g[2 * n : 3 * n] * np.tanh(c[t + 1])
        return h[1:], (x, h, c, gates)

    def backward(self, grad: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, h, c, gates = kept
        n = self.n
        dz = np.empty_like(gates)
        dh, dc = np.zeros(n, np.float32), np.zeros(n, np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g = (gates[t, k * n : (k + 1) * n] for k in range(4))
            tc = np.tanh(c[t + 1])
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t, :n] = dc * g * i * (1 - i)
            dz[t, n : 2 * n] = dc * c[t] * f * (1 - f)
            dz[t, 2 * n : 3 * n] = dh * tc * o * (1 - o)
            dz[t, 3 * n :] = dc * i * (1 - g * g)
            dh = dz[t] @ self.u.T
            dc = dc * f
        return x.T @ dz, h[:-1].T @ dz, dz.sum(axis=0)

    def run(self, pre: list[np.ndarray]) -> list[np.ndarray]:
        """Hidden states of several sequences, longest first, from their ``x @ w + b``; all take a step together."""
        n, lengths = self.n, np.array([len(p) for p in pre])
        steps = np.zeros((lengths[0], len(pre), 4 * n), np.float32)
        for i, p in enumerate(pre):
            steps[: len(p), i] = p
        out = np.zeros((lengths[0], len(pre), n), np.float32)
        h, c = np.zeros((len(pre), n), np.float32), np.zeros((len(pre), n), np.float32)
        for t in range(lengths[0]):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            z = steps[t, :live] + h[:live] @ self.u
            s = _sigmoid(z[:, : 3 * n])
            c = s[:, n : 2 * n] * c[:live] + s[:, :n] * np.tanh(z[:, 3 * n :])
            h = s[:, 2 * n :] * np.tanh(c)
            out[t, :live] = h
        return [out[: len(p), i] for i, p in enumerate(pre)]


class Labeller:
    """Both directions and a logistic output."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, FEATURES, HIDDEN_UNITS), Lstm(rng, FEATURES, HIDDEN_UNITS)
        self.v = np.zeros(2 * HIDDEN_UNITS + 1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = HIDDEN_UNITS
        a, kept_a = self.ahead.forward(x)
        b, kept_b = self.back.forward(x[::-1])
        both = np.concatenate((a, b[::-1]), axis=1)
        err = ((_sigmoid(both @ self.v[:-1] + self.v[-1]) - y) / len(y)).astype(np.float32)
        dv = np.concatenate((both.T @ err, [err.sum()])).astype(np.float32)
        d = np.outer(err, self.v[:-1])
        return [*self.ahead.backward(d[:, :n], kept_a), *self.back.backward(d[::-1, n:], kept_b), dv]

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of each block of each page that it belongs to the article.

        Pages of like length go through together, at most BATCH padded blocks at a time (a longer page by itself).
        Features are made and projected STEP blocks at a time, so a huge page never has them all in memory.
        """
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
        out = [np.zeros(0, np.float32) for _ in pages]
        while order:
            take = max(1, BATCH // len(pages[order[0]]))
            some, order = order[:take], order[take:]
            ahead, back = [], []
            for i in some:
                made = ((x @ self.ahead.w + self.ahead.b, x @ self.back.w + self.back.b) for x in (features(pages[i], a, a + STEP) for a in range(0, len(pages[i]), STEP)))
                one, two = zip(*made, strict=True)
                ahead.append(np.concatenate(one))
                back.append(np.concatenate(two)[::-1])
            n = HIDDEN_UNITS
            for i, a, b in zip(some, self.ahead.run(ahead), self.back.run(back), strict=True):
                out[i] = _sigmoid(a @ self.v[:n] + b[::-1] @ self.v[n:-1] + self.v[-1])
        return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam on one page at a time, in a seeded order."""
    model = Labeller(seed)
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        rate = RATE * 0.6**epoch
        for i in rng.permutation(len(pages)):
            step += 1
            for p, m, s, g in zip(params, first, second, model.gradient(*pages[i]), strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return model


# --- made-up training pages -------------------------------------------------------------------------------------

_WRAPS = {
    "menu": ["nav", "div.nav", "div.menu", "ul.menu", "div.navbar", "div.navigation", "ul.nav", "nav.main", "div.breadcrumb", "div.breadcrumbs", "nav.breadcrumb", "div.topbar", "div.pagination", "div.pager", "div.toc", "nav.toc", "ul.links", "div.tabs"],
    "header": ["header", "div.header", "div.masthead", "div#header", "header.site", "div.banner", "div.top", "div.logo", "div.branding"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site", "div.bottom", "div.copyright", "div.legal", "div.colophon"],
    "side": ["aside", "div.sidebar", "aside.sidebar", "div.side", "div.widget", "div.related", "aside.related", "section.related", "div.recommended", "div.trending", "div.popular", "ul.related", "div.more", "div.tags", "div.share", "div.social", "div.author-box", "div.newsletter", "div.subscribe"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "div.banner-ad", "section.promo", "p.ad", "div.sponsor", "ins.ad"],
    "notice": ["div.cookie", "div.cookies", "div.cookie-banner", "div.notice", "div.consent", "div.gdpr", "div.alert", "div.popup", "div.modal", "p.notice", "div.disclaimer", "dialog", "div.paywall", "section.notice", "div.privacy", "div.warning"],
    "form": ["form", "form.search", "form.login", "div.search", "form.subscribe", "form.comment-form", "fieldset"],
    "comments": ["div.comments", "section.comments", "div#comments", "ol.comments", "ul.comments", "div.comment", "section.discussion", "div.replies", "div.responses", "article.comment", "div.reader-comments", "div.comment-list", "div.user-comments"],
}
_MAIN = ["article", "main", "div.content", "div.article", "div.post", "div.entry", "div#content", "section.article", "div.story", "main.content", "div.article-body", "div.main", "article.post", "div.text", "section.content", "div.body", "div.post-content", "div.entry-content", "div.page"]
_SHELL = ["div.wrapper", "div.container", "div.page", "div", "section", "div#main", "div.row", "div.col", "main", "div.layout"]
_LEAF = {"menu": ["li", "li", "a", "span", "div"], "header": ["h1", "div", "p", "span", "h2"], "footer": ["p", "div", "span", "li", "small", ""], "side": ["li", "p", "h3", "h4", "div", "a", "h2"], "advert": ["p", "div", "span", "h3", "", "", ""], "notice": ["p", "div", "", "span"], "form": ["label", "p", "div", "legend", ""], "comments": ["p", "p", "div", "li", "span", "h3", "h2", "blockquote"]}


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.html, self.labels = rng, [], []
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzéèüñ", 14)
        self.syllables = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(30)]
        self.noise = rng.choice(["", "", "", "***", "&amp;&amp;", "$$", " |", " ·", "©", " »", "#"])

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() + (self.noise if self.rng.random() < 0.5 else "") for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            s = self.words(1, 16)
            if self.rng.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            out.append(s[:1].upper() + s[1:] + ".")
        return " ".join(out)

    def open(self, spec: str) -> str:
        tag, _, rest = spec.partition("#" if "#" in spec else ".")
        if rest:
            name = "id" if "#" in spec else "class"
            if self.rng.random() < 0.15:
                rest += " " + self.word()
            self.html.append(f'<{tag} {name}="{rest}">')
        else:
            self.html.append(f"<{tag}>")
        return tag

    def leaf(self, tag: str, text: str, label: int) -> None:
        self.html.append(f"<{tag}>{text}</{tag}>" if tag else text)
        self.labels.append((text, label))

    def noise_block(self, kind: str) -> None:
        r = self.rng
        tag = self.open(r.choice(_WRAPS[kind]))
        inner = self.open("ul") if kind == "menu" and tag != "ul" and r.random() < 0.7 else ""
        long = kind in ("comments", "notice", "side", "advert")
        n = {"menu": r.randint(2, 9), "comments": r.randint(1, 7), "side": r.randint(1, 6)}.get(kind, r.randint(1, 3))
        leaf = r.choice(_LEAF[kind])
        for _ in range(n):
            text = self.sentences(1, 6) if long and r.random() < 0.7 else self.sentences(1, 2) if r.random() < 0.5 else self.words(1, 6)
            if kind == "footer" and r.random() < 0.5:
                text = r.choice(["&copy; ", "Copyright "]) + text
            if kind in ("menu", "side") and r.random() < 0.8:
                text = f'<a href="/{self.word()}">{text}</a>'
            self.leaf(leaf or ("" if n == 1 else "p"), text, 0)
        self.html.append((f"</{inner}>" if inner else "") + f"</{tag}>")

    def article(self, inside: list[str]) -> None:
        r = self.rng
        depth = [self.open(r.choice(_MAIN))]
        if r.random() < 0.3:
            depth.append(self.open(r.choice(_MAIN + ["div", "section"])))
        if r.random() < 0.85:
            self.leaf(r.choice(["h1", "h1", "h1", "h2"]), self.words(1, 12) if r.random() < 0.5 else self.sentences(1, 1), 1)
        n = r.choice([1, 2, 3, 5, 8, 12, 18])
        spots = {r.randrange(n): kind for kind in inside}
        for i in range(n):
            kind = r.random()
            if kind < 0.62:
                self.leaf("p", self.sentences(1, 9), 1)
            elif kind < 0.72:
                self.html.append("<p><b>")
                self.leaf("", self.sentences(1, 1), 1)
                self.html.append("<br>")
            elif kind < 0.8:
                self.leaf(r.choice(["h2", "h3"]), self.words(1, 7), 1)
            elif kind < 0.88:
                tag = self.open(r.choice(["ul", "ol"]))
                for _ in range(r.randint(1, 5)):
                    self.leaf("li", self.words(1, 12), 1)
                self.html.append(f"</{tag}>")
            elif kind < 0.92:
                self.html.append("<table>")
                for _ in range(r.randint(1, 3)):
                    self.html.append("<tr>")
                    for _ in range(r.randint(1, 3)):
                        self.leaf("td", self.words(1, 4), 1)
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif kind < 0.96:
                self.leaf(r.choice(["pre", "blockquote", "div", "figcaption"]), self.sentences(1, 3), 1)
            else:
                self.leaf("p", f'{self.words(2, 9)} <a href="/x">{self.words(1, 3)}</a> {self.sentences(1, 2)}', 1)
            if i in spots:
                self.noise_block(spots[i])
        for tag in reversed(depth):
            self.html.append(f"</{tag}>")


def training_pages(count: int = PAGES, seed: int = SEED) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Made-up pages as blocks with labels; each block finds its label by its place in the page."""
    rng = random.Random(seed)
    while count:
        w = _Writer(rng)
        w.html.append(f"<html><head><title>{w.words(1, 8)}</title><style>p{{}}</style><script>var t;</script></head><body>")
        shell = w.open(rng.choice(_SHELL)) if rng.random() < 0.4 else ""
        for kind in ("notice", "header", "menu", "advert", "form", "side"):
            if rng.random() < (0.8 if kind == "menu" else 0.35):
                w.noise_block(kind)
        w.article([k for k in ("advert", "side", "notice", "form") if rng.random() < 0.15])
        for kind in ("comments", "side", "advert", "form", "menu", "notice", "footer"):
            if rng.random() < (0.8 if kind == "footer" else 0.35):
                w.noise_block(kind)
        w.html.append((f"</{shell}>" if shell else "") + "</body></html>")
        page = blocks("".join(w.html))
        labels = [label for text, label in w.labels if blocks(text)]
        if page and len(page) == len(labels):
            count -= 1
            yield page, np.array(labels, np.float32)


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    return train([(features(p), y) for p, y in training_pages(pages, seed)], epochs, seed)


WEIGHTS = Path(__file__).with_name("html_lstm.npz")


@functools.cache
def labeller() -> Labeller:
    """The labeller with the weights that ``trained()`` has left in WEIGHTS."""
    model = Labeller()
    with np.load(WEIGHTS) as kept:
        for i, p in enumerate(model.parameters()):
            p[...] = kept[f"p{i}"]
    return model


def write_weights() -> None:
    """Train and round to half precision, which is what WEIGHTS holds."""
    np.savez_compressed(WEIGHTS, **{f"p{i}": p.astype(np.float16) for i, p in enumerate(trained().parameters())})


def main_texts(htmls: list[str | None], model: Labeller) -> list[str]:
    pages = [blocks(h) for h in htmls]
    keep = [p >= 0.5 for p in model.label(pages)]
    return ["\n\n".join(b.text for b, k in zip(page, ks.tolist(), strict=True) if k) for page, ks in zip(pages, keep, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    Defined cases: null and empty pages, and pages without article blocks, have an empty text of 0 characters; broken
    markup is read as far as it goes; repeated rows give repeated rows; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    held = pages.sparkSession.sparkContext.broadcast(model or labeller())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts(b.column(2).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


if __name__ == "__main__":
    write_weights()
