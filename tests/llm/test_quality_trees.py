"""Statistics against plain Python, trees against their definition, held-out accuracy."""

import random
import re

import numpy as np
import pytest

from pkgpulse.llm import quality_trees as Q

SF01 = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def texts():
    rng = random.Random(2)
    vocab = ["a", "b", "Été", "##", "x|y", "中", "word", "<>", "long" * 30, "…"]
    out = [None, "", " ", "\n\n", "a", "a\na", "a \na", "a\r\na\r\na", " a\n a", "a " * 8, "a " * 9, "a " * 30, "\x0b\x0c a\tb"]
    for _ in range(150):
        line = lambda: " ".join(rng.choices(vocab, k=rng.randrange(9)))
        pool = [line() for _ in range(4)]
        out.append("\n".join(rng.choice(pool) if rng.random() < 0.6 else line() for _ in range(rng.randrange(1, 12))))
    return out


def test_base_counts_match_plain_python():
    got = Q.statistics(texts())[Q.BASE].to_numpy().tolist()
    assert [tuple(r) for r in got] == [plain(t) for t in texts()]


def test_counts_do_not_depend_on_the_run():
    alone = [tuple(Q.statistics([t]).iloc[0]) for t in texts()]
    assert [tuple(r) for r in Q.statistics(texts()).to_numpy()] == alone


def test_flattened_trees_are_monotonic_and_fit():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.random(3000) > 0.6) & (x[:, 1] < 0.8)).astype(float)
    model = Q.fit_trees(x, y, [1, -1, 0])
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    for feature, sign in ((0, 1), (1, -1)):
        line = rng.random((50, 3)).repeat(40, axis=0)
        line[:, feature] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
        steps = np.diff(model.score(line).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
    # one row at a time, node by node
    for row in x[:20]:
        total = model.bias
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.split[node] else model.right[node]
            total += model.value[node]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_constant_without_labels(spark):
    docs = spark.createDataFrame([(1, "word " * 30 + "x y z", 5), (2, None, 5)], "doc_id long, text string, n_words long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: r for r in Q.judge(docs, Q.fit(docs, labels)).collect()}
    assert rows[2].base_failed and not rows[2].kept and rows[2].n_words == 0
    assert rows[1].base_failed  # repeats
    assert Q.judge(docs.limit(0), Q.fit(docs.limit(0), labels)).collect() == []


def test_held_out_accuracy_and_determinism(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    assert len(got) == 1000
    held = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    right = [(row.score >= 0.5) == bool(q) for row, q in held]
    assert sum(right) / len(right) > 0.95
    assert {i: r.score for i, r in got.items()} == {
        r.doc_id: r.score for r in Q.judge(docs, Q.fit(docs.repartition(7), labels.where("doc_id % 2 = 0"))).collect()
    }
