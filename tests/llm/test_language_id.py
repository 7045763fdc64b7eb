"""Language identification: held-out accuracy, and a brute-force scorer."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import regex

from pkgpulse.llm import language_id as L

SF01 = "/root/testdata/sf0.01"
ROWS = [
    (1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "le chat et le chien", "fr"),
    (4, "the house", "en"), (5, "das Haus", "de"), (6, None, "en"), (7, "ignored words", None),
]
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, text):
    """Word log frequency, else the mean over the longest n-grams known."""
    find = lambda t: regex.findall(r"\p{L}+", t.lower())
    train = [(find(t), lang) for _, t, lang in rows if t is not None and lang is not None]
    langs = sorted({lang for _, lang in train})
    counts = {lang: Counter(w for ws, x in train if x == lang for w in ws) for lang in langs}
    vocab = set().union(*counts.values())
    pieces = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    total = dict.fromkeys(langs, 0.0)
    for word in find(text):
        for lang in langs:
            if word in vocab:
                total[lang] += math.log((counts[lang][word] + 0.5) / (sum(counts[lang].values()) + 0.5 * (len(vocab) + 1)))
                continue
            for n in range(5, 0, -1):
                by = {x: Counter(g for w in counts[x] for g in pieces(w, n)) for x in langs}
                known = set().union(*by.values())
                hit = [g for g in pieces(word, n) if g in known]
                if hit:
                    size = sum(by[lang].values()) + 0.5 * (len(known) + 1)
                    total[lang] += sum(math.log((by[lang][g] + 0.5) / size) for g in hit) / len(hit)
                    break
    top = max(total.values())
    best = min(x for x in langs if total[x] == top)
    return best, 1 / sum(math.exp(v - top) for v in total.values())


def test_matches_brute_force(spark):
    model = L.learn(spark.createDataFrame(ROWS, SCHEMA))
    scorer = L.Scorer(model)
    for text in ["the dog", "Katzen", "chats chiens", "xyz cat", "häuser und dogs", "THE the", "q", "Hundehaus 12"]:
        lang, score, _, _ = scorer.score(text)
        want, p = brute(ROWS, text)
        assert (lang, score) == (want, pytest.approx(p)), text


def test_special_rows(spark):
    model = L.learn(spark.createDataFrame(ROWS, SCHEMA))
    docs = [(1, None, None), (2, "½ ² ① Ⅷ", None), (3, "12 !! _ 3", "en"), (3, "das Haus", "en"), (None, "le chat", "x"), (9, "中文", "z")]
    docs.append((10, "the " * 300_000 + " ".join(f"w{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 17)}" for i in range(9000)), None))
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = sorted(((r.doc_id or 0, r.lang_pred, round(r.score, 3)) for r in L.predict(df, model).collect()))
    assert got[0][:2] == (0, "fr") and got[1:3] == [(1, "und", 0.0), (2, "und", 0.0)]
    assert got[3][:2] == (3, "de") and got[4] == (3, "und", 0.0)
    assert got[5][:2] == (9, "de") and got[5][2] == pytest.approx(1 / 3, abs=0.01) and got[6][:2] == (10, "en")
    assert L.predict(df.limit(0), model).collect() == []


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = L.predict(spark.createDataFrame(ROWS, SCHEMA), L.learn(none)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)} and len(got) == len(ROWS)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = L.learn(docs.where("doc_id % 3 <> 0"))
    rows = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    # a memo too small for the words changes nothing
    small = L.Scorer(L.learn(docs.where("doc_id % 3 <> 0"), n_words=50, n_grams=200))
    assert small.score("the of and") == L.Scorer(small.model).score("the of and")


def test_entries_outside_the_broadcast_are_joined(spark):
    """However few entries go to the tasks, every learned one counts."""
    texts = ["the dog", "Katzen", "chats chiens", "xyz cat", "häuser und dogs", "THE the", "q", "Hundehaus 12", "Katze chat chat", "中文", "12", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for n_words, n_grams in ((0, 0), (2, 3), (2, 1000), (1000, 3)):
        model = L.learn(spark.createDataFrame(ROWS, SCHEMA), n_words=n_words, n_grams=n_grams)
        assert len(model.word_row) <= n_words and model.rest
        got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, model).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            want = brute(ROWS, text) if text and L.words(text) else ("und", 0)
            assert got[i] == (want[0], pytest.approx(want[1])), (n_words, n_grams, text)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(300)
    few, all_ = ({r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, L.learn(docs.where("doc_id % 3 <> 0"), *n)).collect()} for n in ((500, 300), (10**6, 10**6)))
    assert few.keys() == all_.keys() and all(few[i] == (all_[i][0], pytest.approx(all_[i][1])) for i in few)


def test_known_words_are_those_of_other_texts(spark):
    """By brute force, with all entries at hand and with all of them joined."""
    rows = [*ROWS, (8, "the zog zog", "en"), (9, "kjsdhf ksjdhf kjsdhf", "de")]
    df = spark.createDataFrame(rows, SCHEMA)
    find = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    by_lang = {}
    for _, text, lang in rows:
        if lang:
            by_lang.setdefault(lang, Counter()).update(find(text))
    for kwargs in ({}, {"n_words": 0, "n_grams": 0}):
        got = L.predict(df, L.learn(df, **kwargs), df.lang.isNotNull()).collect()
        assert len(got) == len(rows)
        for r in got:
            _, text, lang = rows[r.doc_id - 1]
            own = Counter(find(text))
            known = sum(n for w, n in own.items() if by_lang.get(r.lang_pred, {}).get(w, 0) > (n if lang else 0))
            assert (r.n_words, r.n_known) == (own.total(), known), (kwargs, r)
        assert {r.doc_id: r.n_known for r in got}[9] == 0


def test_grams_are_counted_per_language_and_handed_on(monkeypatch):
    """Whatever is held: the same counts, and no more held than allowed by one run of words."""
    rows = [(f"wort{i % 7}x{i}é", lang) for i in range(60) for lang in ("de", "fr")] + [("é", "fr"), ("", "de")]
    frames = lambda: iter([pd.DataFrame(rows[:50], columns=["word", "lang"]), pd.DataFrame(rows[50:], columns=["word", "lang"])])
    want = Counter((n, g, lang) for w, lang in rows for n in range(1, L.GRAM + 1) for g in L.grams(w, n))
    for held, run in ((10**6, 500), (100, 3)):
        monkeypatch.setattr(L, "HELD", held)
        monkeypatch.setattr(L, "GRAM_WORDS", run)
        got, parts = Counter(), [p for p in L._count_grams(frames()) if len(p)]
        for r in (r for p in parts for r in p.itertuples(index=False)):
            got[(r.size, r.gram, r.lang)] += r.n
        assert got == want and max(map(len, parts)) <= held + 3 * 60 and (held > 100 or len(parts) > 5)


def test_entries_reach_the_driver_packed(spark, monkeypatch):
    """One row a batch and length, not one an entry and language, and no table of objects."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    want = L.learn(docs)

    def rows_of_objects(*_):
        raise AssertionError("rows come to the driver one by one")

    monkeypatch.setattr(type(docs), "toPandas", rows_of_objects)
    got = L.learn(docs)
    assert got.word_row == want.word_row and got.gram_row == want.gram_row and (got.table == want.table).all()
    frame = pd.DataFrame({"size": [0, 1, 0], "entry": ["ab", "a", "c"], "n": [[1, 2], [3, 4], [5, 0]]})
    packed = {r["size"]: (r["entries"], np.frombuffer(r["n"], np.int64).tolist()) for part in L._pack([frame]) for r in part.to_dict("records")}
    assert packed == {0: ("ab\nc", [1, 2, 5, 0]), 1: ("a", [3, 4])}
