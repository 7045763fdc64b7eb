"""Decontamination against brute force."""

import hashlib
import random
import re

from pkgpulse.llm import decontaminate as D

FOLD = {c: c + 32 for c in range(65, 91)}
NO_PYTHON = ("Python", "Pandas", "Arrow")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        ids = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, row int, window string"),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, n int"),
    )


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "Été", "É", "é", "a1", "x", "rare"] + [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(w))
            cut = w[a : a + rng.randrange(1, 25)]
            parts.append(rng.choice([" ", ", ", "--", "\n"]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in cut))
            parts.append(" ".join(rng.choices(vocab, k=rng.randrange(5))))
        docs.append((i, rng.choice(["", " ", "!"]) + " ".join(parts)))
    return docs, items


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        got = D.contamination(*frames(spark, docs, items)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_special_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(1, passage), (2, None), (3, ""), (None, "lonely phrase"), (4, passage), (5, "ΣΑΣ İ K long")]
    docs = [
        (1, None), (2, ""), (3, "..."), (4, passage.upper()), (4, passage.upper()), (4, "other text"), (None, "x " + passage),
        (6, "a lonely PHRASE lonely phrase"), (7, "σασ i̇ k long"), (8, "ΣΑΣ İ K LONG"), (9, (passage + " ") * 3000),
    ]
    got = D.contamination(*frames(spark, docs, items)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)
    docs_df, items_df = frames(spark, docs, items)
    assert {r.contaminated for r in D.contamination(docs_df, items_df.limit(0)).collect()} == {False}
    assert D.contamination(docs_df.limit(0), items_df).collect() == []


def test_proximity_finds_shifted_words_that_the_phrase_does_not(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    near = "alpha beta and gamma delta epsilon zeta eta theta iota kappa"
    far = "alpha one two three four five six beta seven eight nine ten gamma delta"
    docs = [(1, near), (2, far), (3, items[0][1])]
    frames_ = frames(spark, docs, items)
    assert {r.doc_id for r in D.phrase_matches(*frames_).collect()} == {3}
    assert {r.doc_id for r in D.proximity_matches(*frames_, slack=2).collect()} == {1, 3}


def test_capital_sigma_before_marks_is_found(spark):
    items = [(1, "ΟΔΟΣ.ΑΒΓ"), (2, "ΛΟΓΟΣ:Α ΤΕΛΟΣ'Β")]
    docs = [(1, "x ΟΔΟΣ.ΑΒΓ y"), (2, "ΛΟΓΟΣ:Α ΤΕΛΟΣ'Β"), (3, "ΟΔΟΣ ΑΒΓ"), (4, "ΟΔΟΣ")]
    got = sorted((tuple(r) for r in D.contamination(*frames(spark, docs, items)).collect()), key=str)
    assert got == brute(docs, items) and [r[-1] for r in got] == [True, True, True, False]


def test_no_python_in_the_plans(spark):
    plan = D.contamination(*frames(spark, [(1, "a")], [(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in NO_PYTHON)


def test_every_separator_ends_a_word(spark):
    marks = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
    text = "".join(f"{c}aZ{i}" for i, c in enumerate(marks)) + marks
    docs, items = frames(spark, [(1, text), (2, marks), (3, "Ünd x")], [(7, "AZ3 az4 az5")])
    got = D.contamination(docs, items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got) == [(1, len(marks), 3), (2, 0, 0), (3, 1, 0)]
