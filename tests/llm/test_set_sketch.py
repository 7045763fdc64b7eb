import random

import numpy as np
import pytest

from pkgpulse.llm import set_sketch as S
from pkgpulse.llm.queries import op13_set_sketch

SCHEMA = "doc_id long, text string, fp long, n long, key string, root long"


def shingles(text, k):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k, p, q):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and min(len(a), len(b)) * q >= max(len(a), len(b)) * p:
                common = len(a & b)
                if q * common >= p * (len(a) + len(b) - common):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        component = None if doc is None else least[find(i)]
        out.append((doc, len(sets[i]), component, None if doc is None else doc == component))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hashes(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64)


def sketch(*sets):
    return S.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))


def test_a_register_is_the_minimum_over_the_set():
    values = hashes(400)
    singles = sketch(*(values[i : i + 1] for i in range(400)))
    assert (sketch(values)[0] == singles.max(axis=0)).all()
    assert (S.merged(sketch(values[:250])[0], sketch(values[150:])[0]) == sketch(values)[0]).all()
    assert (sketch(values, values[:0])[1] == 0).all()


@pytest.mark.parametrize("n", [1, 7, 100, 30_000])
def test_cardinality(n):
    estimates = [S.cardinality(sketch(hashes(n, seed)))[0] for seed in range(12)]
    assert np.mean(estimates) == pytest.approx(n, rel=0.07)


@pytest.mark.parametrize("similarity", [0.1, 0.5, 0.8, 0.95])
def test_likelihood_estimate(similarity):
    got = []
    for seed in range(20):
        values = hashes(4000, seed)
        common = round(2 * 1500 * similarity / (1 + similarity))
        a, b = values[:1500], values[1500 - common : 3000 - common]
        both = sketch(a, b)
        j, doubt = S.estimate(both[:1], both[1:], np.array([1500.0]), np.array([1500.0]), 0.8)
        got.append(j[0])
        assert (doubt[0] <= S.DOUBT) if similarity >= 0.8 else True
        assert (doubt[0] > S.DOUBT) if similarity <= 0.5 else True
    assert np.mean(got) == pytest.approx(similarity, abs=0.03)


def test_sizes_that_exclude_a_link():
    values = hashes(200)
    both = sketch(values[:100], values[:79])
    assert np.isinf(S.estimate(both[:1], both[1:], np.array([100.0]), np.array([79.0]), 0.8)[1][0])
    edge = sketch(values[:100], values[:80])
    assert S.estimate(edge[:1], edge[1:], np.array([100.0]), np.array([80.0]), 0.8)[1][0] <= S.DOUBT


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("k", "p", "q"), [(2, 4, 5), (5, 4, 5)])
def test_groups_of_copies_against_brute_force(spark, k, p, q):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 12, 90]))]
        for _ in range(25):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 0, 1, 2, 4, 7]))))
        chain = base  # a chain: each text links with its neighbours only
        for _ in range(12):
            chain = edited(rng, chain, 3).split()
            rows.append((len(rows), " ".join(chain)))
        rows.append((len(rows), f"single {g} " + " ".join(base[:2])))
    df = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], SCHEMA).repartition(5)
    assert found(S.near_duplicates(df, k, p, q)) == brute(rows, k, p, q)


def test_special_cases(spark):
    base = [f"w{i}" for i in range(60)]
    bridge = [*base[:-4], "x1", "x2", "x3", "x4"]
    far = [*bridge[4:], "y1", "y2", "y3", "y4"]
    long = " ".join(f"l{i % 30_011}" for i in range(60_000))
    rows = [
        (1, " ".join(base)),
        (None, " ".join(bridge)),  # a row without an id still links the rows beside it
        (3, " ".join(far)),
        (4, None),
        (5, ""),
        (6, "\t \n"),
        (7, "One"),
        (8, "oNE"),
        (9, "one "),
        (10, "same words"),
        (10, "same words"),
        (11, "SAME  words"),
        (12, long),
        (13, long + " tail"),
        (None, None),
    ]
    df = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], SCHEMA)
    got = found(S.near_duplicates(df, 2))
    assert got == brute(rows, 2, 4, 5)
    assert (3, 59, 1, False) in got and (13, 30_012, 12, False) in got
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op13_set_sketch(spark, folder)) == brute(rows, 2, 4, 5)


def test_a_round_that_joins_hardly_anything_is_the_last(spark, monkeypatch):
    """Sets that meet in keys but do not link: the components are found once
    after the hubs and once after all open pairs."""
    rng, rows = random.Random(8), []
    base = [f"w{i}" for i in range(200)]
    for i in range(40):  # pairs differ in about 40 of 200 words, copies link
        text = [f"x{i}_{j}" if rng.random() < 0.12 else w for j, w in enumerate(base)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text, "end"]))]
    calls, true = [], S.connected_components
    monkeypatch.setattr(S, "connected_components", lambda links: calls.append(1) or true(links))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs, 2, 4, 5).collect()}
    assert got == {i: i - i % 2 for i in range(80)}
    assert len(calls) <= 2
