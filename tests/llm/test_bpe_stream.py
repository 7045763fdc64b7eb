"""Streaming BPE against the tokenizers library."""

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pkgpulse.llm import bpe_stream as B
from pkgpulse.llm.shared import written

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　​"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def transducer():
    return B.Transducer(PATH)


def cases():
    rng = random.Random(1)
    alphabets = ["ab ", "the and's 'll \n", "aeiou  \n\t", SPACES + "ab1.", "= -_.", "中文字 ñéß٣½Ⅷ²", "aaaaA", "etaoin shrdlu"]
    for _ in range(600):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 40)))
        yield text + ("<|endoftext|>" + text[:5] if rng.random() < 0.1 else "")
    yield from ["", " ", "\n", "a ", " a", "a  b", "x\n y", "x \n", "<|endoftext|>", " <|endoftext|> ", "\U0001f600\U0001f468‍"]
    for unit, n in [("a", 3000), ("ab", 1500), ("=", 2000), (" ", 700), ("\n", 500), ("ha", 1001), ("é", 999)]:
        yield unit * n
    yield "".join(rng.choice("abcdefgh") for _ in range(8000))


def test_same_ids_and_text_as_the_library(library, transducer):
    encoder = B.Encoder(transducer)
    for text in cases():
        ids = encoder.encode(text)
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, repr(text[:60])
        assert B.decode_ids(transducer, ids, step=3) == library.decode(expected, skip_special_tokens=False) == text


def test_tokens_of_short_pretokens_come_out_before_the_end(transducer):
    """Every pretoken goes through the same states, whatever its length."""
    for text in [" internationalization", "antidisestablishmentarianism", " Donaudampfschifffahrtsgesellschaft"]:
        data, given, early = text.encode(), 0, 0

        def pieces(data=data):
            nonlocal given
            for given in range(1, len(data) + 1):
                yield data[given - 1 : given]

        ids = []
        for token in transducer.stream(pieces()):
            ids.append(token)
            early += given < len(data)
        assert b"".join(transducer.bytes_of[i] for i in ids) == data
        assert ids == transducer.merge(data) and early > 0, text


def test_pieces_of_any_size_give_the_same_tokens(transducer):
    rng = random.Random(5)
    data = "".join(rng.choice("etaoin") for _ in range(3000)).encode()
    whole = list(transducer.stream([data]))
    for step in (1, 7, 300):
        assert list(transducer.stream(data[i : i + step] for i in range(0, len(data), step))) == whole


def test_tokens_come_out_before_the_end_and_memory_stays_bounded(transducer):
    given = 0

    def pieces():
        nonlocal given
        for _ in range(4000):
            given += 6
            yield b"thethe"

    stream = transducer.stream(pieces())
    next(stream)
    assert given <= 4 * transducer.longest + 6  # the first token needs the window only
    assert transducer.lookahead >= 2 * transducer.longest
    emitted, late = 1, 0
    for token in stream:
        emitted += 1
        late = max(late, given - 3 * emitted)
    assert late < 8 * transducer.longest


def test_malformed_and_unfinished_bytes(library, transducer):
    # single-byte tokens of a cut character
    ids = [transducer.byte_ids[b] for b in b"a\xe4\xb8 \xff\xe4"]
    assert B.decode_ids(transducer, B.packed(ids), step=1) == library.decode(ids, skip_special_tokens=False)


def test_table_with_nulls_repeats_and_extra_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (2, "two rows", "z"), (None, "no id", None), (5, "long " * 30000, "ids")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in B.round_trip(df, PATH).collect()), key=str)
    want = sorted(
        ((i, B.packed(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in rows), key=str
    )
    assert got == want
    encoded = B.encode(df, PATH)
    assert sorted(r.decoded for r in B.decode(encoded, PATH).collect()) == sorted(t or "" for _, t, _ in rows)
    assert B.round_trip(df.limit(0), PATH).collect() == []


def test_what_a_worker_holds_is_small(transducer):
    """Ends of tokens are made as they are met, tokens that begin no longer one
    share one node, and the memos are emptied when full."""
    fresh = B.Transducer(PATH)
    assert not fresh.right and not fresh.left
    met = list(fresh.stream([b" internationalization"]))
    assert met == list(transducer.stream([b" internationalization"])) and len(fresh.right) < 1000 > len(fresh.left)

    def leaves(nodes):
        return [follow for _, follow in nodes.values() if not follow] + [x for _, follow in nodes.values() for x in leaves(follow)]

    assert all(x is B._LEAF for x in leaves(fresh.trie)) and not B._LEAF
    assert B.CHUNKS + B.MEMO + B.PAIRS <= 500_000


def test_a_worker_gets_so_many_rows_at_once(spark):
    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    got = written(spark.range(100).coalesce(1).mapInPandas(sizes, "n long"), "sizes", batch=7).collect()
    assert max(r.n for r in got) == 7 and sum(r.n for r in got) == 100
    assert spark.conf.get(key, None) == before


def test_pretokens_in_use_are_encoded_once_though_the_memo_is_full(transducer, monkeypatch):
    monkeypatch.setattr(B, "MEMO", 8)
    monkeypatch.setattr(B, "CHUNKS", 8)
    asked = []

    class Counting:
        special, added = transducer.special, transducer.added

        def stream(self, pieces):
            data = b"".join(pieces)
            asked.append(data)
            return transducer.stream([data])

    encoder = B.Encoder(Counting())
    text = "".join(f" common w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26))
    assert encoder.encode(text) == B.packed(transducer.merge(b" common")).join(
        [b"", *(B.packed(transducer.merge(w.encode())) for w in text.replace(" common", "|").split("|")[1:])]
    )
    assert asked.count(b" common") == 1 and len(asked) == 677


def test_automaton_makes_the_states_it_meets(transducer):
    fresh = B.Suffixes(transducer.trie)
    state = 0
    for byte in b" theatre":
        state = fresh[state << 8 | byte]
    assert len(fresh.size) < 60 and fresh.size[state] == max(fresh.going(state) + [n for n, _ in fresh.ends[state]])
    for (size, token), (less, _) in zip(fresh.ends[state], [*fresh.ends[state][1:], (0, None)], strict=True):
        assert size > less and transducer.bytes_of[token] == b" theatre"[-size:]


def test_ascii_texts_are_cut_by_the_same_pattern(transducer):
    encoder = B.Encoder(transducer)
    rng = random.Random(9)
    signs = [chr(i) for i in range(128)]
    texts = ["".join(a + b for a in signs for b in signs), "it's 'tis we'll ''s 'd\n\n 'x  '"]
    texts += ["".join(rng.choice(signs[:70] if i % 2 else signs) for _ in range(60)) for i in range(2000)]
    for text in texts:
        assert encoder.pattern(text) is encoder.ascii_pretokens
        assert encoder.pattern(text).findall(text) == encoder.pretokens.findall(text), repr(text)
    assert encoder.pattern("é") is encoder.pretokens


def test_texts_encoded_together_are_the_same_as_one_by_one(library, transducer, monkeypatch):
    texts = [None, *cases(), None, "lone \ud800 surrogate"]
    want = [B.Encoder(transducer).encode(t) for t in texts]
    assert want[1:-2] == [B.packed(library.encode(t, add_special_tokens=False).ids) for t in texts[1:-2]]
    for run, memo, pairs in [(B.RUN, B.MEMO, B.PAIRS), (300, 8, 5), (1, 40, 50)]:
        monkeypatch.setattr(B, "RUN", run)
        monkeypatch.setattr(B, "MEMO", memo)
        monkeypatch.setattr(B, "PAIRS", pairs)
        fresh = B.Transducer(PATH)
        assert B.Encoder(fresh).encode_all(texts) == want
        assert sum(map(len, fresh.fits.values())) == fresh.fits.held <= pairs
    assert B.Encoder(transducer).encode_all([]) == []


def test_new_pretokens_go_on_from_what_they_share(transducer, monkeypatch):
    """Each byte of a beginning that the one before has too is read once."""
    words = sorted(f" inter{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    read = []
    advance = B.Transducer._advance
    monkeypatch.setattr(B.Transducer, "_advance", lambda self, piece, *rest: (read.append(len(piece)), advance(self, piece, *rest))[1])
    B.Encoder(transducer).encode_all(["".join(words[::-1])] * 3)
    assert sum(read) == 6 + 10 + 100
    assert list(transducer.streams(w.encode() for w in words)) == [transducer.merge(w.encode()) for w in words]
