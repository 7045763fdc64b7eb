"""The pipeline's stages against brute force on a small table."""

import corpus_pipeline as C
import public_tokenizers
from pyspark.sql import functions as F
from test_decontaminate import words
from test_jaccard_join import brute
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in C.STAGES:
        out = C.written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in out.collect()}
        if name == "bpe":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert after.keys() == before.keys()
            for i, r in after.items():
                assert r.n_tokens == len(library.encode(before[i].text, add_special_tokens=False).ids)
            texts = {r.doc_id: r.sha for r in docs.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
            assert {i: r.decoded_sha256 for i, r in after.items()} == texts
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(before[i] == r for i, r in after.items())
        if name == "quality_classifier":
            known = [(labels[i], i in after) for i in before if i in labels]
            assert sum(bool(q) == kept for q, kept in known) / len(known) > 0.93
        elif name == "language_id":
            assert after.keys() == before.keys()
        elif name == "jaccard_join":
            groups = brute([(i, r.text) for i, r in before.items()], C.SHINGLE, C.P, C.Q)
            assert after.keys() == {i for i, _, root in groups if i == root}
        elif name == "decontamination":
            hit = {
                i for i, r in before.items() for w in [words(r.text)]
                if any(tuple(w[a : a + n]) in windows for n in {len(x) for x in windows} for a in range(len(w) - n + 1))
            }
            assert after.keys() == before.keys() - hit
        docs, before = out, after


def test_special_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words of a text " * 9, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF), "stage")
    assert [r.doc_id for r in docs.collect()] in ([3], [])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        empty = C.written(stage(spark, empty, SF), "stage")
    assert empty.collect() == []


def test_null_and_repeated_ids_go_by_their_own_row(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    clean = "plain words of a text that nobody has asked for in a test " * 3
    rows = lambda *x: spark.createDataFrame([(i, t, "en", "s", 9) for i, t in x], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda stage, *x: sorted(((r.doc_id, r.text) for r in stage(spark, rows(*x), SF).collect()), key=str)
    assert kept(C.decontamination, (None, passage), (5, passage), (5, clean), (None, clean)) == [(5, clean), (None, clean)]
    assert kept(C.language, (None, "12 34"), (3, "12"), (3, clean), (1, clean)) == [(1, clean), (3, clean)]
    gibberish = ["kjsdhf ksjdhf skdjfh sdkfjh", "zxq vbn qwrt plmk jhgfd wqx " * 5]
    other = "kaikki ihmiset syntyvät vapaina tasavertaisina arvoltaan oikeuksiltaan heille annettu järki omatunto " * 2
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    strange = [(9000 + i, t) for i, t in enumerate([*gibberish, other])]
    mixed = spark.read.parquet(f"{SF}/documents.parquet").unionByName(rows(*strange))
    stays = sorted((r.doc_id, r.text) for r in C.language(spark, mixed, SF).collect())
    assert stays == sorted(given)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))
    near = text + " more"
    groups = [(7, text), (7, text), (7, near), (None, text), (None, near), (None, clean), (None, clean), (8, "quite another text of some words")]
    got = kept(C.near_duplicates, *groups)
    assert [i for i, _ in got] == [7, 8, None] and got[0][1] in (text, near) and got[2][1] == clean
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = docs.unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("")))
    assert C.quality_classifier(spark, mixed, SF).where("doc_id is null").count() == 0
