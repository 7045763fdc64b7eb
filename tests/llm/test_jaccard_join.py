"""Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pkgpulse.llm import jaccard_join as J
from pkgpulse.llm.components import connected_components
from pkgpulse.llm.jaccard_join import _scheme, jaccard_components, parity_sketch

SCHEMA = "doc_id long, text string, key long"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, p, q):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, n, lengths, edits):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    while len(texts) < n:
        words = [rng.choice(vocab) for _ in range(rng.choice(lengths))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 3, 8])):
            copy = list(words)
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - rng.randrange(4))]
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
            words = copy if rng.random() < 0.5 else words
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in jaccard_components(df, **kw).collect())


@pytest.mark.parametrize(
    "k,p,q,lengths,edits",
    [(3, 9, 10, [4, 9, 30, 120], [0, 1, 2]), (5, 4, 5, [5, 12, 40, 90], [0, 1, 2, 3]), (2, 1, 2, [3, 8, 20], [0, 2, 5])],
)
def test_matches_brute_force(spark, k, p, q, lengths, edits):
    rows = corpus(k, 160, lengths, edits)
    assert run(spark, rows, shingle=k, p=p, q=q) == brute(rows, k, p, q)


def test_nulls_empties_ties_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, "x"), (7, "x"), (8, "x"), (9, "é É")]
    assert run(spark, rows) == brute(rows, 3, 9, 10)
    df = spark.createDataFrame([(None, "a b c d", 0), (3, "a b c d", 0)], SCHEMA)
    assert {tuple(r) for r in jaccard_components(df).collect()} == {(None, 2, None), (3, 2, 3)}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_very_long_text_and_its_near_copy(spark):
    words = [f"t{i * i % 7919}" for i in range(30000)]
    near = list(words)
    near[10] = "changed"
    rows = [(5, " ".join(words)), (2, " ".join(near)), (9, "z" * 100_000), (1, "other text here now")]
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert got == {5: 2, 2: 2, 9: 9, 1: 1}


def test_chain_of_near_copies_is_one_component(spark):
    # neighbours link, the ends do not: no hub links with all
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[5 * i] = f"new{i}"
    assert run(spark, rows) == brute(rows, 3, 9, 10)


@pytest.mark.parametrize("p,q", [(9, 10), (4, 5), (1, 2)])
def test_units_cover_every_partner(p, q):
    """The prober's units exceed the largest possible difference, and a
    larger set posts at least the segments that its prober uses."""
    scheme = _scheme(p, q)
    for x in range(1, 400):
        for y in range(x, x * q // p + 1):
            common = -(-p * (x + y) // (p + q))
            assert scheme.units(x) > x + y - 2 * common
            assert scheme.band(x) in scheme.bands(y)
            assert scheme.used(y, scheme.band(x)) >= scheme.used(x, scheme.band(x)) >= scheme.units(x)


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(1)
    for n, edits in [(5, 1), (60, 9), (500, 40), (500, 400)]:
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[edits:], rng.integers(0, 2**63, edits).astype(np.uint64)])
        for bits in (64, 128, 1024):
            a, b = (np.array(parity_sketch(v, bits), np.int64).view(np.uint64) for v in (x, y))
            assert sum(int(v).bit_count() for v in a ^ b) <= 2 * edits


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert roots == {i: find(i) for i in list(parent)}
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none.select("a", F.col("b"))).collect() == []


def test_a_row_without_an_id_links_the_rows_beside_it(spark):
    base = [f"w{i}" for i in range(80)]
    bridge = [*base[:-2], "x1", "x2"]
    far = [*bridge[2:], "y1", "y2"]
    rows = [(1, " ".join(base)), (None, " ".join(bridge)), (3, " ".join(far)), (None, None)]
    got = jaccard_components(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), shingle=3, p=9, q=10)
    assert sorted((r.doc_id, r.component_id) for r in got.collect() if r.doc_id) == [(1, 1), (3, 1)]
    assert [r.component_id for r in got.collect() if r.doc_id is None] == [None, None]


def test_unrelated_texts_need_not_look_up_small_segments(spark, monkeypatch):
    """Texts of one size meet in segments of no or one shingle: second units
    there are left out first, as far as the others suffice."""
    seen = {}
    keep = J.written
    monkeypatch.setattr(J, "written", lambda df, name: seen.setdefault(name, []).append(keep(df, name)) or seen[name][-1])
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(124)), None) for i in range(400)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), 5, 4, 5).collect()
    assert all(r.doc_id == r.component_id for r in got)
    assert seen["probes"][0].count() < 400  # 1,972 when only as many units were left out as there are spare segments
    assert len(seen["postings"]) == 2  # one part's shuffle goes before the next begins


@pytest.mark.parametrize("p,q,n", [(4, 5, 3), (4, 5, 150), (9, 10, 700), (1, 2, 40)])
def test_spare_units_leave_as_many_as_a_set_needs(p, q, n):
    scheme, rng = _scheme(p, q), np.random.default_rng(n)
    values = np.unique(rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64))
    band = scheme.band(n)
    segments, used = scheme.shape(band)[0], scheme.used(n, band)
    held = [sum((int(v) >> 20) % segments == s for v in values) for s in range(used)]
    allowances = sum(2 if x <= J.SMALL else 1 for x in held)
    assert allowances - J.spare_units(scheme, values) == scheme.units(n)


def test_parts_of_the_postings_are_all_of_them():
    frame = lambda: iter([pd.DataFrame({"text": [t for _, t in corpus(5, 30, [4, 30, 200], [1, 4])]})])
    rows = lambda nth, slices: [tuple(r) for f in J._postings(2, 4, 5, nth, slices)(frame()) for r in f.itertuples(index=False)]
    parts = [rows(i, 3) for i in range(3)]
    assert sorted(sum(parts, [])) == sorted(rows(0, 1)) and all(parts)
    assert not {r[0] for r in parts[0]} & {r[0] for r in parts[1]}
