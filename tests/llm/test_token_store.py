"""The token store against the library and an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from pkgpulse.llm import token_store as S

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, end=2):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def read(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    folder = S.write_store(df, PATH, **kw)
    out = S.read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    return folder, sorted((tuple(r) for r in out), key=lambda r: (r[1], r[2]))


def corpus(n):
    rng = random.Random(n)
    vocab = ["The", "quick", "É́", "naïve", "don't", "3.14", "a b", "x\ty", "<|endoftext|>", "中文", "...", "I'LL", "Á"]
    rows = [(i * 3, rng.choice([" ", "\n", "  "]).join(rng.choices(vocab, k=rng.randrange(60)))) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_round_trip(spark):
    rows = corpus(400) + [(None, "no id"), (7, None), (8, ""), (10, "tie"), (10, "tie"), (10, "other"), (9, "word " * 40000)]
    folder, got = read(spark, rows)
    assert got == expected(rows)
    assert len(spark.read.parquet(f"{folder}/dictionary").first().dictionary) > 0
    want = Tokenizer.from_file(PATH).encode(dict(rows)[30], add_special_tokens=False).ids
    assert [x.tolist() for x in S.read_text(spark, folder, 30)] == [[*want, 2]]
    assert len(S.read_text(spark, folder, 10)) == 3


def test_few_rows_and_empty_table(spark):
    rows = [(2, "b"), (1, "a")]
    assert read(spark, rows, end=7)[1] == expected(rows, 7)
    assert read(spark, [])[1] == []


def test_several_shards_in_a_part(spark):
    rows = corpus(60)
    folder, got = read(spark, rows, shard_bytes=200)
    assert got == expected(rows)
    assert spark.read.parquet(f"{folder}/shards").count() > 10


def test_another_dictionary_is_refused(spark):
    folder, _ = read(spark, [(1, "a")])
    shards = spark.read.parquet(f"{folder}/shards").withColumn("dict_sha256", F.lit("0"))
    other = f"{folder}-other"
    shards.write.parquet(f"{other}/shards")
    spark.read.parquet(f"{folder}/dictionary").write.parquet(f"{other}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        S.read_store(spark, other).collect()


def test_joined_words_are_cut_where_they_were(spark):
    words = ["plain", "Ünïcode", "don't", "a1b2", "x" * 300, "'s", "--", "\x7f", "\x00", "\x1c", "a\tb", "한글", "é", "é", "İ", "ǅ", "ﬁ", "①", " ", "a b", "하", "🙂", "ß", "ſ", ""]
    text = " ".join(words * 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = S.WordEncoder(path)
    (got,) = encoder.encode([text], 2)
    want = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert np.frombuffer(got, "<u4").tolist() == want
    for word in words:
        assert np.frombuffer(encoder[word], "<u4").tolist() == encoder.tokenizer.encode(word, add_special_tokens=False).ids


def test_a_pretoken_is_encoded_once_in_whatever_words_it_stands(tmp_path):
    rng = random.Random(4)
    marks = "aZ'sStTrReEvVlLmMdD09.,-<|>~\"`_ \n\tÀÉßéÿÞ×÷²ªµ\x85\xa0ʼnſİıσς́​中🙂"
    texts = ["".join(rng.choices(marks, k=rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["It's I'LL", "a<|endoftext|>b <|startoftext|>", "", " "]
    library = Tokenizer.from_file(PATH)
    want = [[*t.ids, 2] for t in library.encode_batch(texts, add_special_tokens=False)]

    def ids(encoder, texts):
        return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts, 2)]

    encoder = S.WordEncoder(PATH)
    assert ids(encoder, texts) == want == ids(encoder, texts)
    encoder = S.WordEncoder(PATH)
    encoder.encode(["Été, été. (ÉTÉ) ended ENDED; 'Ended'"], 2)
    assert sorted(encoder.pretokens) == ["'", "(", ")", ",", ".", ";", "ended", "été"]
    # a file with another pre-tokenizer goes through the whole tokenizer
    other = str(tmp_path / "other.json")
    library.pre_tokenizer = pre_tokenizers.Whitespace()
    library.save(other)
    words = [" ".join(rng.choices(["it's", "Ended.", "2001", "a_b"], k=20)) for _ in range(30)]
    encoder = S.WordEncoder(other)
    assert ids(encoder, words) == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in words]
    assert not encoder.pretokens
