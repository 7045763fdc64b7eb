"""Periodic run detection by internal pattern matching.

A run is a maximal stretch of words with smallest period ``q`` and a length
of at least ``max(6, 4 * q)``. Periods are found block by block: blocks of
dyadic length B = 1, 2, 4, ... start at every multiple of B / 2. A run with
B / 2 < q <= B covers such a block and the same words q places further on, so
each block asks for its own occurrences in the neighbouring window, B / 2 + 1
to B places ahead. The suffix array of the texts holds the occurrences of a
block as one interval; a wavelet matrix over the suffix array answers the
query (range successor). There the occurrences of a block are either one,
whose distance is the candidate, or an arithmetic progression whose difference
p is the block's own period: then the candidate is the distance between the
ends of the two p-periodic stretches, that of the block and that of the
progression. Candidates are extended word by word to both sides, so what is
returned is exact (words are told apart by 64-bit hashes).

Before the index is built, blocks go that cannot lie in a run: all words of
such a block come again within B places. Texts without a block left have no
run and are not indexed.

Texts are independent of each other: one pass without a shuffle, in runs of
texts of about 4 MB (or the longest text), with memory in proportion.

Nulls and special cases: a null or empty text has no words and no runs; a text
of fewer than six words has no runs; repeated rows are answered each; a null id
is kept as it is; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.shared import blocks
from pkgpulse.llm.text_kernel import U64, Words, mix

#: a run has at least this many words, and this many times its period
LENGTH, EXPONENT = 6, 4

RUNS = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
    "best struct<start: long, length: long, period: long>, collapsed string"
)

_FAR = np.int64(1) << 60
_CELLS = 1 << 21  # cells compared at once while stretches are extended


class WaveletMatrix:
    """Range successor over a permutation of ``0 .. n - 1``: one bit vector
    per binary digit, packed, with the ones counted before each packed word."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.digits = range(max(1, (self.n - 1).bit_length()) - 1, -1, -1)
        self.packed, self.ones, self.zeros = [], [], []
        for d in self.digits:
            bit = (values >> d) & 1
            cells = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            cells[: self.n] = bit
            packed = np.packbits(cells, bitorder="little").view(U64)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.packed.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(counts)[:-1]]))
            self.zeros.append(self.n - int(counts.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _zeros_before(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        part = self.packed[level][word] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return at - self.ones[level][word] - np.bitwise_count(part)

    def _descend(self, level: int, lo: np.ndarray, hi: np.ndarray, low_ends: tuple, right: np.ndarray):
        lo0, hi0 = low_ends
        z = self.zeros[level]
        return np.where(right, z + lo - lo0, lo0), np.where(right, z + hi - hi0, hi0)

    def _less(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each interval are below x."""
        total = np.zeros(len(lo), np.int64)
        for level, d in enumerate(self.digits):
            ends = self._zeros_before(level, lo), self._zeros_before(level, hi)
            right = ((x >> d) & 1).astype(bool)
            total += np.where(right, ends[1] - ends[0], 0)
            lo, hi = self._descend(level, lo, hi, ends, right)
        return total

    def _smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each interval."""
        value = np.zeros(len(lo), np.int64)
        for level, d in enumerate(self.digits):
            ends = self._zeros_before(level, lo), self._zeros_before(level, hi)
            right = k >= ends[1] - ends[0]
            k = np.where(right, k - (ends[1] - ends[0]), k)
            value |= right.astype(np.int64) << d
            lo, hi = self._descend(level, lo, hi, ends, right)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of ``[lo, hi)`` that is x or more; -1 if none."""
        below = self._less(lo, hi, np.minimum(x, self.n - 1))
        there = (below < hi - lo) & (x < self.n)
        found = self._smallest(lo, hi, np.where(there, below, 0))
        return np.where(there, found, -1)


def suffix_array(ids: np.ndarray, starts: dict[int, np.ndarray]):
    """The suffix array of ``ids`` by prefix doubling, and for each level k the
    intervals (lo, hi) of the suffixes that begin with the block of 2**k words
    at the positions ``starts[k]``; levels at which all blocks differ are left out."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    new = np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]])
    intervals = {}
    for level in range(n.bit_length() + 1):
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        lows = np.repeat(first, size)
        rank = np.empty(n, np.int64)
        rank[order] = lows
        if level in starts:
            lo = rank[starts[level]]
            intervals[level] = lo, lo + np.repeat(size, size)[lo]
        shared = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(shared):
            break
        at = order[shared]
        ahead = at + (1 << level)
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        turn = np.lexsort((second, lows[shared]))
        order[shared] = at[turn]
        low, second = lows[shared], second[turn]
        new[shared[1:]] |= (low[1:] == low[:-1]) & (second[1:] != second[:-1]) & (shared[1:] == shared[:-1] + 1)
    return order, intervals


def _extent(ids: np.ndarray, i: np.ndarray, j: np.ndarray, sign: int, cap: np.ndarray) -> np.ndarray:
    """How many words are equal from i and j on (``sign`` 1) or back from them
    (-1), at most ``cap``; a separator, never equal, ends every text."""
    out, live, width = np.zeros(len(i), np.int64), np.arange(len(i)), 16
    while len(live):
        onward = []
        for part in np.array_split(live, -(-len(live) * width // _CELLS)):
            step = sign * (out[part, None] + np.arange(width))
            a, b = (np.clip(x[part, None] + step, 0, len(ids) - 1) for x in (i, j))
            differ = ids[a] != ids[b]
            hit = differ.any(axis=1)
            out[part] += np.where(hit, differ.argmax(axis=1), width)
            onward.append(part[~hit & (out[part] < cap[part])])
        live, width = np.concatenate(onward), min(2 * width, 1 << 16)
    return np.minimum(out, cap)


def _live_blocks(codes: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
    """Per level the starts of the blocks whose words all come again within
    the block's length, in the same text."""
    n = len(codes)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(codes, kind="stable")
    again = (codes[order[1:]] == codes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    gap = np.full(n, _FAR)
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    longest = int(np.diff(bounds).max(initial=0))
    live, level = {}, 0
    while (1 << level) < max(2, longest // 2 + 1) and (1 << level) < n:
        size = 1 << level
        far = np.concatenate([[0], np.cumsum(gap > size)])
        at = np.arange(0, n - size, max(1, size // 2))
        at = at[(far[at + size] == far[at]) & (text[at] == text[at + size])]
        if len(at):
            live[level] = at
        level += 1
    return live


def _candidates(ids: np.ndarray, index: WaveletMatrix, lo, hi, at: np.ndarray, size: int):
    """(start, period) pairs that the blocks of one level give rise to."""
    x1 = index.successor(lo, hi, at + size // 2 + 1)
    there = (x1 >= 0) & (x1 <= at + size)
    lo, hi, at, x1 = lo[there], hi[there], at[there], x1[there]
    x2 = index.successor(lo, hi, x1 + 1)
    several = (x2 >= 0) & (x2 <= at + size)
    period = x1 - at
    if several.any():
        s, x, p = at[several], x1[several], (x2 - x1)[several]
        # the stretches differ: that of the block ends before p words of the progression
        end = s + p + _extent(ids, s, s + p, 1, np.full(len(s), 2 * size))
        later = x + p + _extent(ids, x, x + p, 1, np.full(len(s), 3 * size))
        period[several] = np.where(end < x + size, later - end, 0)
    keep = (period > size // 2) & (period <= size)
    return at[keep], period[keep]


def find_runs(codes: np.ndarray, bounds: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT):
    """(text, start, length, period) arrays, ordered by text, start, period:
    the runs of the texts whose words are ``codes[bounds[i] : bounds[i + 1]]``."""
    assert exponent >= 4, "blocks are dealt for runs of four periods or more"
    empty = tuple(np.zeros((4, 0), np.int64))
    if not len(codes):
        return empty
    live = _live_blocks(codes, bounds)
    if not live:
        return empty
    text_of = lambda at: np.searchsorted(bounds, at, side="right") - 1
    texts = np.unique(text_of(np.concatenate(list(live.values()))))
    # the texts concerned, a separator of its own around each
    sizes = bounds[texts + 1] - bounds[texts]
    shift = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1  # where each text begins
    ids = np.arange(int(sizes.sum()) + len(texts) + 1)
    inside = np.ones(len(ids), bool)
    inside[np.append(shift - 1, len(ids) - 1)] = False
    words = np.concatenate([codes[bounds[t] : bounds[t + 1]] for t in texts])
    ids[inside] = np.unique(words, return_inverse=True)[1]
    ids[~inside] = len(words) + np.arange(len(texts) + 1)
    starts = {}
    for level, at in live.items():
        t = text_of(at)
        starts[level] = at - bounds[t] + shift[np.searchsorted(texts, t)]
    order, intervals = suffix_array(ids, starts)
    index = WaveletMatrix(order)
    found = [(level, *_candidates(ids, index, lo, hi, starts[level], 1 << level)) for level, (lo, hi) in intervals.items()]
    at = np.concatenate([s for _, s, _ in found] or [np.zeros(0, np.int64)])
    period = np.concatenate([q for _, _, q in found] or [np.zeros(0, np.int64)])
    size = np.concatenate([np.full(len(s), 1 << level) for level, s, _ in found] or [np.zeros(0, np.int64)])
    if not len(at):
        return empty
    # blocks of one period that overlap lie in one stretch: extend the first of each chain
    turn = np.lexsort((at, period))
    at, period, size = at[turn], period[turn], size[turn]
    lead = np.concatenate([[True], (period[1:] != period[:-1]) | (at[1:] - at[:-1] > size[1:])])
    at, period = at[lead], period[lead]
    whole = np.full(len(at), len(ids))
    begin = at - _extent(ids, at - 1, at + period - 1, -1, whole)
    end = at + period + _extent(ids, at, at + period, 1, whole)
    long = end - begin >= np.maximum(length, exponent * period)
    begin, end, period = begin[long], end[long], period[long]
    # a stretch that also has a divisor of the period as its period is that one's run
    turn = np.lexsort((period, end, begin))
    begin, end, period = begin[turn], end[turn], period[turn]
    once = np.ones(len(begin), bool)
    once[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[once], end[once], period[once]
    place = np.searchsorted(shift, begin, side="right") - 1
    turn = np.lexsort((period, begin))
    return texts[place][turn], (begin - shift[place])[turn], (end - begin)[turn], period[turn]


def _detect(length: int, exponent: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "text"):
            words = Words(frame["text"].tolist())
            text, start, size, period = find_runs(words.hashes(), words.bounds, length, exponent)
            edges = np.searchsorted(text, np.arange(len(frame) + 1))
            runs, best, kept = [], [], []
            raw = words.buf.tobytes()
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                cut = raw[words.text_starts[i] : words.text_ends[i]].split()
                here = list(zip(start[a:b].tolist(), size[a:b].tolist(), period[a:b].tolist(), strict=True))
                if here:
                    gone = np.zeros(len(cut) + 1, np.int64)
                    for s, n, q in here:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    cut = [w for w, g in zip(cut, np.cumsum(gone).tolist(), strict=False) if not g]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                top = min(here, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                best.append(top and {"start": top[0], "length": top[1], "period": top[2]})
                kept.append(b" ".join(cut).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "n_words": np.diff(words.bounds),
                    "runs": runs,
                    "best": best,
                    "collapsed": kept,
                }
            )

    return run


def detect(
    docs: DataFrame,
    id_col: str | Column = "doc_id",
    text_col: str | Column = "text",
    length: int = LENGTH,
    exponent: int = EXPONENT,
) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, runs, best, collapsed): all runs
    by start and period, the one of the greatest exact length / period (ties:
    smallest start, then period; null without runs), and the words left, joined
    by a space, when of each run only the first period stays."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(as_column(id_col).cast("long").alias("doc_id"), as_column(text_col).alias("text"))
    return rows.mapInPandas(_detect(length, exponent), RUNS)


def with_periodic_tail(doc_id: str, text: str) -> Column:
    """The text whose tail is made periodic for one document in ten: with h =
    crc32 of the id's decimal text, g = h div 10 and h % 10 = 0, each word i >=
    a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 +
    g % 8). All other texts, and those of a null id, stay as they are."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def tail(words: Column) -> Column:
        n = F.size(words)
        # the null is never used: a text without words stays as it is
        g = F.floor(h / 10)
        a = (g % F.nullif(n, F.lit(0))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        moved = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
        return F.array_join(moved, " ")

    # a one-element array binds the words once, however often they are read
    bound = F.transform(F.array(words), tail)[0]
    return F.when(h % 10 == 0, F.when(F.rlike(text, F.lit("[^\\x20\\x09-\\x0D]")), bound).otherwise(F.col(text))).otherwise(F.col(text))
