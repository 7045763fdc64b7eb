"""Vectorised word spans and hashes over a run of texts (numpy).

Texts are joined into one byte buffer, a line break between them, and words
are found and hashed for the whole run at once. A word is a maximal run of
characters outside space and U+0009..U+000D.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

U64 = np.uint64
_LONG_WORD = 48  # bytes hashed in lock step; the rest of a longer word goes through xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE_VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the result."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of a run of texts.

    ``bounds[i]:bounds[i + 1]`` are the words of text ``i``; ``starts`` and
    ``ends`` are byte positions in ``buf``. Null texts hold no words.
    """

    def __init__(self, texts: Sequence[str | None], lower: bool = False):
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.text_ends = self.text_starts + lengths
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = ~WHITE[self.buf]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, np.append(self.text_starts, len(self.buf)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_spans(self.buf, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_starts)), np.diff(self.bounds))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values in
    lock step for all spans, xxhash for what exceeds ``_LONG_WORD`` bytes."""
    lengths = ends - starts
    out = lengths.astype(U64) * U64(0xD6E8FEB86659FD93)
    # longest first; one byte a span, which numpy sorts by radix
    clipped = np.minimum(lengths, _LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(np.uint8(_LONG_WORD + 1) - clipped, kind="stable")
    longer = len(lengths) - np.cumsum(np.bincount(clipped, minlength=_LONG_WORD + 2))  # spans longer than k
    at, left = starts[order], lengths[order]
    acc = out[order]
    for k in range(_LONG_WORD):
        live = int(longer[k])
        if not live:
            break
        acc[:live] = acc[:live] * _MULTIPLIER + _BYTE_VALUES[buf[at[:live] + k]]
    for i in range(int(longer[_LONG_WORD])):
        rest = buf[at[i] + _LONG_WORD : at[i] + left[i]].tobytes()
        acc[i] ^= U64(xxhash.xxh3_64_intdigest(rest))
    out[order] = acc
    return mix(out)


def windows(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds) of all windows of ``k`` consecutive words within a text;
    a text of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(words.bounds)
    n = len(hashes)
    acc = np.full(n, U64(k), U64)
    for j in range(min(k, n)):
        acc[: n - j] = acc[: n - j] * _MULTIPLIER + hashes[j:]
    position = np.arange(n) - np.repeat(words.bounds[:-1], counts)
    keep = position + k <= np.repeat(counts, counts)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = words.bounds[i], words.bounds[i + 1]
        value = U64(b - a)
        with np.errstate(over="ignore"):
            for h in hashes[a:b]:
                value = value * _MULTIPLIER + h
        acc[a], keep[a] = value, True
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    return mix(acc[keep]), np.concatenate([[0], np.cumsum(sizes)])
