import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pkgpulse.llm import periodic_runs as R
from pkgpulse.llm.queries import op12_periodic_runs

SCHEMA = "doc_id long, text string, start long, runs string"


def brute(words):
    """Every run by its definition: stretches of each period, smallest first."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of(texts):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.array([x for t in texts for x in t], np.uint64)
    text, start, length, period = (x.tolist() for x in R.find_runs(codes, bounds))
    out = [[] for _ in texts]
    for t, *run in zip(text, start, length, period, strict=True):
        out[t].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=5), min_size=1, max_size=4))
def test_runs_of_repeated_pieces(texts):
    texts = [[w for piece, times in t for w in piece * times] for t in texts]
    assert runs_of(texts) == [brute(t) for t in texts]


def test_progressions_inside_longer_periods():
    # blocks that are periodic themselves: a^k b, (ab)^k c, with several powers
    rng = random.Random(4)
    for _ in range(60):
        unit = [0] * rng.randint(1, 20) + [1, 2] * rng.randint(0, 9) + [3] * rng.randint(0, 2)
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 9))] + unit * rng.randint(3, 7) + unit[: rng.randint(0, 9)]
        assert runs_of([text]) == [brute(text)]


def test_range_successor():
    values = np.random.default_rng(3).permutation(200)
    index = R.WaveletMatrix(values)
    lo = np.random.default_rng(4).integers(0, 200, 500)
    hi = lo + np.random.default_rng(5).integers(0, 201 - lo)
    x = np.random.default_rng(6).integers(0, 205, 500)
    got = index.successor(lo, hi, x)
    for a, b, y, g in zip(lo, hi, x, got, strict=True):
        assert g == min((v for v in values[a:b] if v >= y), default=-1)


def test_detect_special_cases(spark):
    long = "na " * 50_000 + "ba bu " * 40_000
    rows = [
        (1, None, 7, "x"),
        (2, "", 7, "x"),
        (3, "a a a a a", 7, "x"),
        (4, "A a A\ta\na A a a a a a a b", 7, "x"),
        (4, "A a A\ta\na A a a a a a a b", 7, "x"),
        (None, "x y x y x y x y z z z z z z", 7, "x"),
        (6, long, 7, "x"),
    ]
    got = R.detect(spark.createDataFrame(rows, SCHEMA)).collect()
    runs = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got]
    assert runs == [
        (1, 0, []),
        (2, 0, []),
        (3, 5, []),
        (4, 13, [(6, 6, 1)]),
        (4, 13, [(6, 6, 1)]),
        (None, 14, [(0, 8, 2), (8, 6, 1)]),
        (6, 130_000, [(0, 50_000, 1), (50_000, 80_000, 2)]),
    ]
    assert [r.collapsed for r in got] == ["", "", "a a a a a", "A a A a a A a b", "A a A a a A a b", "x y z", "na ba bu"]
    assert tuple(got[5].best) == (8, 6, 1) and got[0].best is None
    assert R.detect(spark.createDataFrame([], SCHEMA)).collect() == []


def test_separators_are_ascii_white_space_only(spark):
    text = "            a\x1cb"
    (row,) = R.detect(spark.createDataFrame([(1, text, 0, "")], SCHEMA)).collect()
    assert [tuple(r) for r in row.runs] == [(0, 6, 1)] and row.collapsed == "  a\x1cb"


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_against_brute_force(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    seen = 0
    for r in op12_periodic_runs(spark, folder).collect():
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a, n = g % len(words), len(words)
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        seen += len(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert seen > 10
