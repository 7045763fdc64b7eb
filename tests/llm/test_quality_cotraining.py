"""Co-training: held-out accuracy, exchange between views, special rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgpulse.llm import quality_cotraining as C

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, score string"


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = C.fit(docs, labels.where("doc_id % 2 = 0"))
    assert model.exchanged > 0
    got = {r.doc_id: r for r in C.judge(docs, model).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())
    held = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([got[r.doc_id].kept == bool(r.quality) for r in held]) > 0.94
    assert np.mean([got[r.doc_id].kept for r in held if r.quality]) > 0.97
    again = C.judge(docs.repartition(5), C.fit(docs.repartition(3), labels.where("doc_id % 2 = 0"))).collect()
    assert max(abs(got[r.doc_id].score - r.score) for r in again) < 1e-6


def test_fit_without_arrow_conversion(spark):
    """A session with Spark's default settings fits the same model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = C.fit(docs, labels)
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = C.fit(docs, labels)
    finally:
        spark.conf.set(key, before)
    assert got.share == want.share and got.exchanged == want.exchanged
    for a, b in zip(got.views, want.views, strict=True):
        assert np.allclose(a.weights, b.weights)


def test_each_view_teaches_the_other():
    """With few labels, the pool makes the weak view better than labels alone."""
    rng = np.random.default_rng(4)
    y = (rng.random(6000) < 0.5).astype(float)
    strong = np.stack([y * 4 - 2 + rng.normal(size=6000) * 0.5], axis=1)
    weak = np.hstack([(y * 2 - 1)[:, None] + rng.normal(size=(6000, 1)) * 1.2, rng.normal(size=(6000, 30))])
    held = np.arange(80) % 2 == 0
    part = lambda a, b: [strong[a:b], weak[a:b]]
    with_pool = C.cotrain(part(0, 80), y[:80], held, lambda now: now.sums(part(80, 3000)))
    alone = C.cotrain(part(0, 80), y[:80], held, lambda now: now.sums([x[:0] for x in part(0, 1)]))
    right = lambda m: ((m.views[1].logit(weak[3000:]) > 0) == y[3000:].astype(bool)).mean()
    assert with_pool.exchanged > 0 and alone.exchanged == 0
    assert right(with_pool) > right(alone)


def test_sums_over_all_rows_by_brute_force(spark):
    """Rows of repeated and null ids take part, in any partitions: the model is
    that of all rows in one matrix."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet").where("doc_id % 3 <> 1")
    more = docs.where("doc_id % 3 = 1").unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(more)
    got = C.fit(docs.repartition(4), labels)
    given = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    seen = C.views(docs).toPandas()
    views = C._matrices(seen)
    ids = [None if i != i or i is None else int(i) for i in seen["doc_id"]]
    first = sorted((zlib.crc32(str(i).encode()), i, n) for n, i in enumerate(ids) if i in given)
    at = np.array([n for _, _, n in first])
    label = np.array([given[i] for _, i, _ in first], float)
    held = np.array([c % C.FOLD == 0 for c, _, _ in first])
    others = [x[[n for n, i in enumerate(ids) if i not in given]] for x in views]
    assert len(others[0]) > 80
    want = C.cotrain([x[at] for x in views], label, held, lambda now: now.sums(others))
    assert got.exchanged == want.exchanged > 0
    assert np.allclose(got.score(*views), want.score(*views), atol=1e-7)


def test_special_rows(spark):
    rows = [(1, None, "en", "s", 3, "x", "x"), (2, "", None, None, None, "x", "x"), (None, "some words here", "en", "s", 5, "x", "x")]
    docs = spark.createDataFrame([*rows, rows[2]], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = C.judge(docs, C.fit(docs, none)).collect()
    assert sorted((r.doc_id or 0, r.score, r.kept) for r in got) == [(0, 1.0, True), (0, 1.0, True), (1, 0.0, False), (2, 0.0, False)]
    one = spark.createDataFrame([(1, 0), (2, 0), (2, None)], "doc_id long, quality int")
    assert {r.kept for r in C.judge(docs, C.fit(docs, one)).collect()} == {False}
    assert C.judge(docs.limit(0), C.fit(docs.limit(0), one)).collect() == []
    long = spark.createDataFrame([(7, "many words " * 500_000, "en", "s", 5_500_000, None, None)], SCHEMA)
    assert [r.doc_id for r in C.judge(long, C.fit(long.unionByName(docs), none)).collect()] == [7]


def test_calibrated_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20000, 1))
    y = (rng.random(20000) < C._sigmoid(2 * x[:, 0] - 1)).astype(float)
    m = C.Logistic(1e-6).fit(x, y)
    assert m.logit(np.array([[0.0], [1.0]])) == pytest.approx([-1, 1], abs=0.15)
