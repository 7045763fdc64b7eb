"""Quality rules by gradient-boosted trees over document statistics.

Statistics come from whole texts (numpy, a run of texts at a time). Trees of
fixed depth are boosted on a bounded sample of labelled rows with histogram
splits and logistic loss; chosen features are monotonic (a split that would
break the direction is not taken, and child values are kept on their side of
the split's midpoint). The model is flattened into arrays of nodes; scoring
walks all rows down all trees by array indexing.

A text is kept if the base rules pass and the model's probability of good
quality is at least ``threshold``.

Nulls and special cases: a null text has no words and no characters (all
statistics 0, base failed, not kept), like an empty one; rows with null or
repeated ids are scored like any other; other columns are ignored; an empty
table gives an empty result; with no labelled rows, or labels of one value
only, the model is constant and the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.shared import blocks
from pkgpulse.llm.text_kernel import Words, hash_spans, windows

#: labelled rows the model is fitted on at most (those of the smallest hash of the id)
SAMPLE_ROWS = 20_000
#: base rules
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: feature -> direction in which quality may only rise (+1), fall (-1), or either (0)
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "repeat_share": -1,
    "dup_line_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "stop_share": 0,
    "distinct_share": 0,
    "bang_per_word": -1,
    "comma_per_word": 0,
    "run_share": -1,
    "top_word_share": 0,
    "lines_per_word": 0,
}

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def statistics(texts: list[str | None]) -> pd.DataFrame:
    """The base counts and the model's features of each text."""
    w = Words(texts)
    n = len(texts)
    counts = np.diff(w.bounds)
    hashes = w.hashes()
    lead = (w.buf & 0xC0) != 0x80  # first bytes of code points
    before = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    length = before[w.ends] - before[w.starts]
    owner = w.text_of_word()
    per_word = lambda x: np.bincount(owner, weights=x, minlength=n)

    # words covered by windows found twice or more in their text
    values, bounds = windows(w, hashes, REPEAT_WINDOW)
    sizes = np.diff(bounds)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    lines = np.flatnonzero(w.buf == 0x0A)
    line_starts = np.unique(np.concatenate([w.text_starts, lines[lines + 1 < len(w.buf)] + 1]))
    line_ends = np.append(line_starts[1:], len(w.buf)) - 1
    with_word = np.searchsorted(w.starts, line_ends) > np.searchsorted(w.starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_hash = hash_spans(w.buf, line_starts, line_ends)
    line_bounds = np.searchsorted(line_starts, np.append(w.text_starts, len(w.buf)))
    dup = np.zeros(n, np.int64)
    distinct, top = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(counts):
        a, b = line_bounds[i], line_bounds[i + 1]
        dup[i] = b - a - len(np.unique(line_hash[a:b]))
        seen = np.unique(hashes[w.bounds[i] : w.bounds[i + 1]], return_counts=True)[1]
        distinct[i], top[i] = len(seen), seen.max()
        if counts[i] > REPEAT_WINDOW:
            x = values[bounds[i] : bounds[i + 1]]
            _, inverse, times = np.unique(x, return_inverse=True, return_counts=True)
            at = w.bounds[i] + np.flatnonzero(times[inverse] > 1)
            repeated[at] += 1
            repeated[at + REPEAT_WINDOW] -= 1
    covered = (np.cumsum(repeated[:-1]) > 0).astype(np.int64)
    same = np.zeros(len(hashes))
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    del values, sizes

    chars = per_word(length)
    out = pd.DataFrame(
        {
            "n_words": counts.astype(np.int64),
            "word_chars": chars.astype(np.int64),
            "n_symbols": _per_text(_SYMBOL[w.buf], w.text_starts, w.text_ends),
            "n_dup_lines": dup,
            "n_repeat_words": per_word(covered).astype(np.int64),
        }
    )
    words, letters = np.maximum(counts, 1), np.maximum(chars, 1)
    out["log_words"] = np.log1p(counts)
    out["mean_word"] = chars / words
    out["symbols_per_word"] = out["n_symbols"] / words
    out["repeat_share"] = out["n_repeat_words"] / words
    out["dup_line_share"] = dup / np.maximum(np.diff(line_bounds), 1)
    out["upper_share"] = _per_text(_UPPER[w.buf], w.text_starts, w.text_ends) / letters
    out["digit_share"] = _per_text(_DIGIT[w.buf], w.text_starts, w.text_ends) / letters
    out["stop_share"] = _per_text(w.buf == 0x2E, w.text_starts, w.text_ends) / words
    out["distinct_share"] = distinct / words
    out["bang_per_word"] = _per_text(w.buf == 0x21, w.text_starts, w.text_ends) / words
    out["comma_per_word"] = _per_text(w.buf == 0x2C, w.text_starts, w.text_ends) / words
    out["run_share"] = per_word(same) / words
    out["top_word_share"] = top / words
    out["lines_per_word"] = np.diff(line_bounds) / words
    return out


def base_failed(stats: pd.DataFrame) -> np.ndarray:
    few = stats["n_words"] < MIN_WORDS
    return (few | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])).to_numpy()


@dataclass
class Trees:
    """Flattened trees: node i tests feature[i] <= split[i] and goes to left[i]
    or right[i]; a leaf points at itself and holds value[i]."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of good quality; all rows and trees step together."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            down = x[rows, self.feature[node]] <= self.split[node]
            node = np.where(down, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(1))))


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 4.0
) -> Trees:
    """Boost trees on rows ``x`` with labels ``y`` in {0, 1}."""
    good = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(good / (1 - good)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), bias)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)

            def grow(rows: np.ndarray, level: int, low: float, high: float, g=gradient, h=weight) -> int:
                here = len(nodes)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                value = float(np.clip(total_g / (total_h + ridge), low, high))
                nodes.append([0, 0.0, here, here, rate * value])
                best = (1e-6, None)
                if level and len(rows) >= 20:
                    for f, cut in enumerate(cuts):
                        if not len(cut):
                            continue
                        b = binned[rows, f]
                        gs = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
                        hs = np.cumsum(np.bincount(b, h[rows], len(cut) + 1))[:-1]
                        left, right = gs / (hs + ridge), (total_g - gs) / (total_h - hs + ridge)
                        gain = gs * left + (total_g - gs) * right - total_g * total_g / (total_h + ridge)
                        gain[(hs < 1e-3) | (total_h - hs < 1e-3) | (directions[f] * (right - left) < 0)] = 0
                        if gain.max() > best[0]:
                            k = int(gain.argmax())
                            best = (gain[k], (f, k, left[k], right[k]))
                if best[1] is None:
                    score[rows] += rate * value
                    return here
                f, k, left, right = best[1]
                middle = float(np.clip((left + right) / 2, low, high))
                at_left, at_right = (low, middle), (middle, high)
                if directions[f] < 0:
                    at_left, at_right = (middle, high), (low, middle)
                elif not directions[f]:
                    at_left = at_right = (low, high)
                goes = binned[rows, f] <= k
                a = grow(rows[goes], level - 1, *at_left)
                b = grow(rows[~goes], level - 1, *at_right)
                nodes[here] = [f, float(cuts[f][k]), a, b, 0.0]
                return here

            roots.append(grow(np.arange(len(y)), depth, -np.inf, np.inf))
    feature, split, left, right, value = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(1),) * 5
    ints = [np.asarray(a, np.int64) for a in (feature, left, right)]
    return Trees(ints[0], split.astype(float), ints[1], ints[2], value.astype(float), np.array(roots, np.int64), depth, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """Labelled rows of ``docs``: the ids of at most ``rows`` labels (smallest
    hash of the id) are sent to the documents, never the texts to the labels."""
    bound = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).alias("label"))
    bound = bound.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return docs.join(F.broadcast(bound), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS, **options) -> Trees:
    """Fit on the statistics of a bounded sample of labelled documents."""
    names = list(FEATURES)

    def features(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text"):
            stats = statistics(frame["text"].tolist())[names]
            stats["doc_id"], stats["label"] = frame["doc_id"].to_numpy(), frame["label"].to_numpy()
            yield stats

    sample = labelled_sample(docs.select("doc_id", "text"), labels, target, rows)
    schema = ", ".join(f"{c} double" for c in names) + ", doc_id long, label int"
    found = sample.mapInPandas(features, schema).toPandas().sort_values(["doc_id", "label", *names], kind="stable")
    return fit_trees(found[names].to_numpy(float), found["label"].to_numpy(float), list(FEATURES.values()), **options)


def judge(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """(doc_id, the base counts, base_failed, score, kept) per row of ``docs``."""
    names = list(FEATURES)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text"):
            stats = statistics(frame["text"].tolist())
            out = stats[BASE].copy()
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            out["base_failed"] = base_failed(stats)
            out["score"] = np.concatenate(
                [model.score(part) for part in np.array_split(stats[names].to_numpy(float), len(stats) // 2000 + 1)]
            )
            out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
            yield out

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
