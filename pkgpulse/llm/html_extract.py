"""Main text of web pages: a bidirectional LSTM labels every leaf block.

Each page is a sequence of leaf blocks. A block's input is a hashed vector of
its tag path (tags, class, id and role words, the last element apart), a
hashed vector of its words, and a few numbers (length, share of links,
place). A forward and a backward LSTM read the whole sequence, and a logistic
layer on both labels the block main text or not, so every decision sees the
whole document.

The network is trained here with numpy, on pages laid out by a generator in
many styles (what is main text is known there) and on a bounded sample of the
given pages that mark their article; the sample and all seeds are fixed
parameters, so a run can be repeated.

Nulls and special cases: a null or empty page, or one without main text, has
the empty text; rows with null or repeated ids are labelled like any other;
other columns are ignored; an empty table gives an empty result (training then
uses generated pages only).
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.html_blocks import Block, blocks
from pkgpulse.llm.shared import blocks as runs

#: pages of the table that training may see, and generated pages
SAMPLE_PAGES, GENERATED = 150, 700
#: longest page (blocks) that is trained on; pages of any length are labelled
TRAIN_BLOCKS = 120
PATH_DIM, WORD_DIM, N_NUMBERS = 256, 64, 8
HIDDEN, PASSES, BATCH, RATE, SEED = 16, 14, 32, 0.01, 7
N_INPUT = PATH_DIM + WORD_DIM + N_NUMBERS

# Names that pages use for what is not, and what is, the main text.
OTHER = (
    "ad ads advert banner sponsor promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget related recommended "
    "footer foot copyright legal header masthead topbar logo cookie consent notice alert popup modal overlay newsletter subscribe signup "
    "login form search share social toolbar pagination pager tags comments comment reply respond discussion disqus"
).split()
MAIN = "article content main post entry story body text page prose markdown articlebody maincontent".split()


@cache
def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


@cache
def _path_vector(path: tuple[str, ...]) -> tuple[int, ...]:
    """Buckets of the elements and names above a block, the nearest apart."""
    tags = [i for i, x in enumerate(path) if not x.startswith(".")]
    near = path[tags[-1] :] if tags else path
    return tuple({_bucket(x, PATH_DIM) for x in path} | {_bucket(f"last {x}", PATH_DIM) for x in near})


def vectors(page: list[Block]) -> np.ndarray:
    """One input row per block."""
    out = np.zeros((len(page), N_INPUT), np.float32)
    for i, block in enumerate(page):
        out[i, list(_path_vector(block.path))] = 1
        words = block.text.lower().split()
        found = np.bincount([_bucket(w, WORD_DIM) if len(w) < 24 else 0 for w in words], minlength=WORD_DIM)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(found / max(len(words), 1)) * 0.5
        n = len(block.text)
        out[i, -N_NUMBERS:] = (
            np.log1p(n) / 6,
            np.log1p(len(words)) / 4,
            block.linked / n,
            (block.text[-1] in ".!?") * 1.0,
            min(len(block.path), 20) / 10,
            i / len(page),
            1 / (1 + i),
            1 / (len(page) - i),
        )
    _bucket.cache_clear() if _bucket.cache_info().currsize > 300_000 else None
    _path_vector.cache_clear() if _path_vector.cache_info().currsize > 100_000 else None
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Forward and backward LSTM over blocks and a logistic layer on both."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p[f"w{side}"] = (rng.normal(size=(N_INPUT, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p[f"u{side}"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # keep at first
            self.p[f"c{side}"] = bias
        self.p["v"] = (rng.normal(size=(2 * HIDDEN,)) * 0.2).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """States (pages, steps, HIDDEN); a masked step leaves the state."""
        n, steps, _ = x.shape
        w, u, bias = self.p[f"w{side}"], self.p[f"u{side}"], self.p[f"c{side}"]
        drive = x @ w + bias
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, memory = np.zeros((n, steps, HIDDEN), np.float32), {}
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = drive[:, t] + h @ u
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c_new = np.where(m, f * c + i * g, c)
            squashed = np.tanh(c_new)
            h_new = np.where(m, o * squashed, h)
            if keep:
                memory[t] = (h, c, i, f, o, g, squashed)
            h, c = h_new, c_new
            out[:, t] = h
        return out, memory

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        forward, fm = self._lstm(x, mask, "f", keep)
        backward, bm = self._lstm(x, mask, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["v"] + self.p["d"][0], (both, fm, bm)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Back-propagation of the mean logistic loss through time."""
        z, (both, fm, bm) = self.logits(x, mask, keep=True)
        dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / max(int(mask.sum()), 1)
        out = {"v": np.einsum("nt,nth->h", dz, both), "d": np.array([dz.sum()], np.float32)}
        top = dz[:, :, None] * self.p["v"]
        for side, memory, part in (("f", fm, top[:, :, :HIDDEN]), ("b", bm, top[:, :, HIDDEN:])):
            u = self.p[f"u{side}"]
            n, steps, _ = x.shape
            dw = np.zeros((n, steps, 4 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                h, c, i, f, o, g, squashed = memory[t]
                m = mask[:, t : t + 1]
                dh = dh + part[:, t]
                live = np.where(m, dh, 0)
                inner = np.where(m, dc + live * o * (1 - squashed**2), 0)
                step = np.concatenate(
                    [inner * g * i * (1 - i), inner * c * f * (1 - f), live * squashed * o * (1 - o), inner * i * (1 - g**2)], axis=1
                )
                dw[:, t] = step
                du += h.T @ step
                dh = np.where(m, step @ u.T, dh)
                dc = np.where(m, inner * f, dc)
            out[f"w{side}"] = x.reshape(-1, N_INPUT).T @ dw.reshape(-1, 4 * HIDDEN)
            out[f"u{side}"], out[f"c{side}"] = du, dw.sum((0, 1))
        return out

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, rate: float = RATE) -> Network:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, step = sorted(range(len(pages)), key=lambda i: len(pages[i][0])), 0
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for turn in range(passes):
            for g in rng.permutation(len(groups)):
                x, mask, y = _padded([pages[i] for i in groups[g]])
                step += 1
                for k, grad in self.gradients(x, mask, y).items():
                    grad = np.clip(grad, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.99 * second[k] + 0.01 * grad * grad
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                    self.p[k] = (self.p[k] - rate / (1 + 0.2 * turn) * move).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length run together."""
        out = [np.zeros(len(p), bool) for p in pages]
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        while order:
            part = []
            while order and (not part or (len(part) + 1) * len(pages[order[0]]) <= 8192):
                part.append(order.pop(0))
            x, mask, _ = _padded([(vectors(pages[i]), np.zeros(len(pages[i]))) for i in part])
            z = self.logits(x, mask)[0]
            for row, i in enumerate(part):
                out[i] = z[row, : len(pages[i])] > 0
        return out


def _padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest = max(len(v) for v, _ in pages)
    x = np.zeros((len(pages), longest, N_INPUT), np.float32)
    mask, y = np.zeros((len(pages), longest), bool), np.zeros((len(pages), longest), np.float32)
    for i, (v, label) in enumerate(pages):
        x[i, : len(v)], mask[i, : len(v)], y[i, : len(v)] = v, True, label
    return x, mask, y


# ------------------------------------------------------------------ training pages


def generated_page(rng: random.Random, words: list[str]) -> tuple[str, list[bool]]:
    """A page in a random style and, block by block, whether it is main text."""
    labels: list[bool] = []

    def text(low: int, high: int, main: bool) -> str:
        labels.append(main)
        return " ".join(rng.choices(words, k=rng.randint(low, high))).capitalize() + rng.choice([".", ".", "", "!"] if main else ["", "", "."])

    def attributes(names: list[str]) -> str:
        name = rng.choice(names)
        if rng.random() < 0.4:
            name += rng.choice(["-", "_", " "]) + rng.choice(["box", "wrap", "inner", "top", "1", "area", "list", "item"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def links(main: bool, tag: str) -> str:
        rows = "".join(f'<li><a href="/x">{text(1, 3, main)}</a></li>' for _ in range(rng.randint(2, 8)))
        return f"<{tag}{attributes(['nav', 'menu', 'navigation']) if rng.random() < 0.5 else ''}><ul>{rows}</ul></{tag}>"

    def paragraph(main: bool, low: int = 1, high: int = 70) -> str:
        body = text(low, high, main)
        if rng.random() < 0.2:
            body = f"<{(t := rng.choice(['b', 'em', 'span', 'i', 'a href=/y']))}>{body}</{t.split()[0]}>"
        return f"<p>{body}" + ("</p>" if rng.random() < 0.9 else "")

    def other(names: list[str], tags: list[str], low: int = 1, high: int = 30) -> str:
        tag, inner = rng.choice(tags), ""
        for _ in range(rng.randint(1, 4)):
            shape = rng.random()
            if shape < 0.5:
                inner += paragraph(False, low, high)
            elif shape < 0.65:
                inner += f"<h3>{text(1, 4, False)}</h3>"
            elif shape < 0.8:
                inner += f"<div>{text(low, high, False)}</div>"
            else:
                inner += f"<ul><li><a href='#'>{text(1, 6, False)}</a></li></ul>"
        return f"<{tag}{attributes(names) if tag in ('div', 'section', 'aside') or rng.random() < 0.5 else ''}>{inner}</{tag}>"

    def bare(names: list[str]) -> str:
        return f"<div{attributes(names)}>{text(1, 40, False)}</div>"

    def form() -> str:
        return f"<form><label>{text(1, 3, False)}</label><input><button>{text(1, 2, False)}</button></form>"

    named = lambda *keys: [w for w in OTHER if any(w.startswith(k) for k in keys)]
    out = ""
    if rng.random() < 0.6:
        inner = f"<h1>{text(1, 4, False)}</h1>" if rng.random() < 0.5 else f"<div>{text(1, 5, False)}</div>"
        out += rng.choice(["<header>{}</header>", "<div class='header'>{}</div>", "<div id='masthead'>{}</div>"]).format(inner)
    if rng.random() < 0.85:
        out += links(False, rng.choice(["nav", "div", "nav"])) if rng.random() < 0.7 else other(named("nav", "menu", "bread"), ["nav", "div"], 1, 4)
    for _ in range(rng.randint(0, 2)):
        out += bare(named("ad", "banner", "spons", "promo", "cookie", "consent", "notice", "alert", "popup"))
    if rng.random() < 0.3:
        out += other(named("side", "aside", "widget", "related"), ["aside", "div"])
    if rng.random() < 0.2:
        out += form()
    outer, inner = rng.choice([("main", "article"), ("article", None), ("article", None), ("div", None), ("main", None), ("div", "article"), ("section", None)])
    mark = attributes(MAIN) if outer in ("div", "section") and inner is None or rng.random() < 0.4 else ""
    body = f"<{outer}{mark}>" + (f"<{inner}>" if inner else "")
    if rng.random() < 0.8:
        title = f"<h1>{text(2, 12, True)}</h1>"
        body += f"<header>{title}</header>" if rng.random() < 0.15 else title
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.72:
            body += paragraph(True)
        elif kind < 0.8:
            body += f"<h2>{text(1, 8, True)}</h2>"
        elif kind < 0.85:
            body += "<ul>" + "".join(f"<li>{text(1, 14, True)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        elif kind < 0.88:
            body += f"<blockquote>{text(3, 40, True)}</blockquote>"
        elif kind < 0.9:
            body += f"<pre>{text(3, 40, True)}</pre>"
        elif kind < 0.92:
            body += f"<table><tr><td>{text(1, 4, True)}</td><td>{text(1, 4, True)}</td></tr></table>"
        elif kind < 0.95:
            body += bare(named("ad", "promo", "share", "social", "newsletter", "related", "subscribe"))
        elif kind < 0.97:
            body += f"<aside>{text(1, 30, False)}</aside>"
        else:
            body += form()
    if rng.random() < 0.25:
        body += other(named("comment", "reply", "respond", "discussion", "disqus"), ["section", "div"])
    out += body + (f"</{inner}>" if inner else "") + f"</{outer}>"
    if rng.random() < 0.3:
        out += other(named("comment", "reply", "respond", "discussion", "disqus"), ["section", "div", "section"])
    if rng.random() < 0.3:
        out += other(named("side", "aside", "widget", "related", "recomm", "tags", "newsletter"), ["aside", "div", "section"])
    if rng.random() < 0.85:
        tag = rng.choice(["footer", "footer", "div class='footer'", "div id='copyright'"])
        out += f"<{tag}>{text(1, 20, False)}" + (paragraph(False, 1, 12) if rng.random() < 0.3 else "") + f"</{tag.split()[0]}>"
    if rng.random() < 0.1:
        out = out[: out.rfind("<", 0, rng.randint(len(out) // 2, len(out)))]
    return f"<!DOCTYPE html><html><body>{out}</body></html>", labels


def marked_labels(page: list[Block]) -> np.ndarray | None:
    """For a page that marks one article: inside it and under none of the
    names that pages use for other things. None if it marks none."""
    inside = np.array(["article" in b.path for b in page], bool)
    names = {f".{w}" for w in OTHER}
    tags = {"nav", "aside", "footer", "form", "button"}
    other = np.array([bool(names.intersection(b.path)) or bool(tags.intersection(b.path)) for b in page], bool)
    return inside & ~other if inside.any() and not inside.all() else None


def train(sample: list[str], generated: int = GENERATED, seed: int = SEED) -> Network:
    """Train on generated pages and on those of ``sample`` that mark an article."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    words = ["".join(rng.choices(letters, weights=range(26, 0, -1), k=rng.randint(1, 9))) for _ in range(2000)]
    pages = []
    for page in sample:
        found = blocks(page)
        words += [w for b in found[:4] for w in b.text.split()[:20]]
        label = marked_labels(found)
        if label is not None and len(found) <= TRAIN_BLOCKS:
            pages.append((vectors(found), label.astype(np.float32)))
    words = [w for w in words if "<" not in w and "&" not in w]
    for _ in range(generated):
        page, labels = generated_page(rng, words)
        found = blocks(page)
        if found and len(found) <= len(labels):  # a cut page holds the first of them
            pages.append((vectors(found), np.array(labels[: len(found)], np.float32)))
    return Network(seed).fit(pages)


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, generated: int = GENERATED) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) per row of ``pages`` (page_id, url, html)."""
    ids = pages.where("page_id is not null and html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    sample = pages.join(F.broadcast(ids.distinct()), "page_id").select("page_id", F.substring("html", 1, 100_000).alias("html"))
    rows = sorted((r.page_id, r.html) for r in sample.collect() if r.html)
    weights = pages.sparkSession.sparkContext.broadcast(train([h for _, h in rows[:sample_pages]], generated).p)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = Network()
        network.p = weights.value
        for frame in runs(frames, "html"):
            found = [blocks(h if isinstance(h, str) else None) for h in frame["html"]]
            kept = network.label(found)
            texts = ["\n".join(b.text for b, k in zip(page, keep, strict=True) if k) for page, keep in zip(found, kept, strict=True)]
            yield pd.DataFrame(
                {
                    "page_id": frame["page_id"].astype("Int64").to_numpy(),
                    "url": frame["url"].to_numpy(),
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                    "n_blocks": [len(p) for p in found],
                }
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long, n_blocks long")
