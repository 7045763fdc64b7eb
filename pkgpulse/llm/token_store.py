"""Token-id store: one zstandard dictionary, one compressed frame per text.

Texts are encoded, and each text's ids (little-endian unsigned 32-bit) are
compressed on their own with a dictionary trained on a bounded sample of
serialized id arrays, so that a short text can be read alone.

File format. A store is a folder with two Parquet tables, written by Spark so
that any file system Spark knows will do:

* ``dictionary``: one row (dict_sha256, dictionary);
* ``shards``: rows (part, shard, dict_sha256, n_docs, index, payload) in
  ascending id order by (part, shard). ``payload`` holds the frames of
  consecutive texts; ``index`` holds per text 8 bytes each of: id, null flag,
  byte offset of the frame, byte length, number of ids, and the ids before it
  in the part. ``index`` and ``payload`` are little-endian.

A reader checks the dictionary's hash before it uses it, seeks a text through
the index alone, and decompresses that one frame.

Nulls and special cases: a null or empty text holds the end id only; rows
with a null id come first; rows with equal ids keep a defined place by their
text; an empty table makes a store of no shards with an empty dictionary (as
does a sample too small to train on; frames then use no dictionary). Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pkgpulse.llm.bpe_stream import byte_alphabet
from pkgpulse.llm.shared import blocks
from pkgpulse.session import shared_dir

INDEX = np.dtype([("id", "<i8"), ("null", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("n", "<i8"), ("before", "<i8")])
SHARDS = "part int, shard int, dict_sha256 string, n_docs long, n_tokens long, index binary, payload binary"

#: rows whose ids the dictionary is trained on, and their greatest length in ids
SAMPLE_ROWS, SAMPLE_IDS = 2000, 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: a shard is closed once its payload reaches this size
SHARD_BYTES = 4 << 20
#: words and pretokens remembered by a task; new words that are encoded as one text
MEMO, PRETOKENS, JOINED = 400_000, 400_000, 256
#: text that one task encodes
PART_BYTES = 16 << 20

# The normalizer and the pre-tokenizer by which words of ``_SIMPLE`` characters are cut here.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PRETOKEN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# printable ASCII and the letters of Latin-1 from U+00C0 on: NFC leaves them alone, and str.lower does as the library
_SIMPLE, _NEVER = re.compile("[!-~À-ÖØ-öø-ÿ]*"), re.compile("(?!)")
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# a character's bytes by the byte-level alphabet, in which each byte of these letters is a character
_STANDS_FOR = {byte: char for char, byte in byte_alphabet().items()}
_BYTE_LEVEL = {i: "".join(_STANDS_FOR[b] for b in chr(i).encode()) for i in range(0xC0, 0x100)}


class Pretokens(dict):
    """Ids of pretokens by the file's merges; a memo."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= PRETOKENS:
            self.clear()
        found = self.model.tokenize(pretoken if pretoken.isascii() else pretoken.translate(_BYTE_LEVEL))
        ids = self[pretoken] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return ids


class WordEncoder(dict):
    """Ids of texts by the tokenizer of the file, a memo of words between
    single spaces or line breaks: the file's pre-tokenizer drops white space,
    so what lies between is encoded alike on its own.

    A word of ``_SIMPLE`` characters is cut into pretokens here, if the file
    has the normalizer and pre-tokenizer that this is written for; the file's
    model encodes each. All other words go through the whole tokenizer, those
    of a run of texts at once."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["model"]["type"] == "BPE"
        self.simple = _SIMPLE.fullmatch if known else _NEVER.fullmatch
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, added)) if added else "(?!)").search
        self.pretokens = Pretokens(self.tokenizer.model)
        self.later: list[str] = []  # words seen that have to go through the whole tokenizer

    def __missing__(self, word: str) -> bytes:
        if not self.simple(word) or self.special(word):
            self.later.append(word)
            return b""
        ids = self[word] = b"".join(map(self.pretokens.__getitem__, _PRETOKEN.findall(word.lower())))
        return ids

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Ids of each text, then the end id."""
        if len(self) > MEMO:
            self.clear()
        last, out, again = np.array([end], "<u4").tobytes(), [], []
        for i, text in enumerate(texts):
            words, seen = text.replace("\n", " ").split(" "), len(self.later)
            out.append(b"".join([*map(self.__getitem__, words), last]))
            if len(self.later) > seen:
                again.append(i)
        self._add(list(dict.fromkeys(self.later)))
        self.later.clear()
        for i in again:
            out[i] = b"".join([*map(self.__getitem__, texts[i].replace("\n", " ").split(" ")), last])
        return out

    def _add(self, words: list[str]) -> None:
        # letters and ASCII keep their places under the file's normalizers
        plain = [w for w in words if w.isascii() or w.isalpha()]
        for i in range(0, len(plain), JOINED):
            self._add_joined(plain[i : i + JOINED])
        other = [w for w in words if not (w.isascii() or w.isalpha())]
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True))

    def _add_joined(self, words: list[str]) -> None:
        """Encode the words as one text, which costs half of encoding each, and
        cut the ids where the tokens' places in the text reach the next word."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.array([at for at, _ in found.offsets], np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        ids, low = np.array(found.ids, "<u4").tobytes(), 0
        for word, high in zip(words, (4 * np.searchsorted(starts, ends)).tolist(), strict=True):
            self[word], low = ids[low:high], high


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column.tolist()]


def train_dictionary(docs: DataFrame, path: str, end: int) -> bytes:
    """A zstandard dictionary from the ids of ``SAMPLE_ROWS`` rows, those with
    the smallest hash of the id (a bounded sample, at every size the same)."""

    def ids(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"ids": [x[: 4 * SAMPLE_IDS] for x in _encoder(path).encode(_texts(frame["text"]), end)]})

    # keys are ordered and limited without their texts; at most SAMPLE_ROWS of them are broadcast
    placed = docs.withColumn("place", F.xxhash64("doc_id", "text"))
    keys = placed.select("doc_id", "place").orderBy(F.xxhash64("doc_id"), "doc_id", "place").limit(SAMPLE_ROWS)
    starts = placed.join(F.broadcast(keys.select("place").distinct()), "place", "left_semi").dropDuplicates(["place"])
    rows = starts.select(F.substring("text", 1, 2 * SAMPLE_IDS).alias("text"))
    samples = [bytes(r.ids) for r in rows.mapInPandas(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""  # too few samples


def _codec(kind, dictionary: bytes, **options):
    return kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **options) if dictionary else kind(**options)


def write_store(
    docs: DataFrame,
    path: str,
    end: int = 2,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> str:
    """Encode every text and write the store; returns its folder.

    Rows are dealt by ranges of the id, so that parts, and shards in them,
    follow the id order without one task seeing all rows; their number follows
    the size of the texts."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    folder = folder or f"{shared_dir(spark)}/llm/tokens-{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, path, end)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(
        f"{folder}/dictionary"
    )

    def shards(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, press = _encoder(path), _codec(zstandard.ZstdCompressor, dictionary, level=LEVEL, write_checksum=True)
        rows, frames_out, offset, before, shard, part = [], [], 0, 0, 0, 0

        def close() -> pd.DataFrame:
            index = np.array(rows, INDEX)
            row = (part, shard, digest, len(rows), int(index["n"].sum()), index.tobytes(), b"".join(frames_out))
            return pd.DataFrame([row], columns=["part", "shard", "dict_sha256", "n_docs", "n_tokens", "index", "payload"])

        for frame in blocks(frames, "text"):
            part = int(frame["part"].iloc[0])
            missing = frame["doc_id"].isna().to_numpy()
            numbers = frame["doc_id"].fillna(0).astype("int64").tolist()
            for number, null, ids in zip(numbers, missing, encoder.encode(_texts(frame["text"]), end), strict=True):
                data = press.compress(ids)
                rows.append((number, int(null), offset, len(data), len(ids) // 4, before))
                frames_out.append(data)
                offset += len(data)
                before += len(ids) // 4
                if offset >= shard_bytes:
                    yield close()
                    rows, frames_out, offset, shard = [], [], 0, shard + 1
        if rows:
            yield close()

    # by the size of the texts, whatever the shuffle's setting; equal ids are split by how their texts begin
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = docs.repartitionByRange(size // PART_BYTES + 1, "doc_id", F.substring("text", 1, 32))
    dealt = ranged.sortWithinPartitions("doc_id", "text")
    dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInPandas(shards, SHARDS).write.parquet(f"{folder}/shards")
    return folder


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.dict_sha256:
        raise ValueError("the dictionary does not match its hash")
    return row.dict_sha256, dictionary


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per text from the files: ``start`` is
    the number of ids of all texts before it."""
    digest, dictionary = _dictionary(spark, folder)
    shards = spark.read.parquet(f"{folder}/shards")
    # one row per part, as many as the store was dealt into
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))

    def texts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = _codec(zstandard.ZstdDecompressor, dictionary)
        for frame in frames:
            for _, row in frame.iterrows():
                if row["dict_sha256"] != digest:
                    raise ValueError("the shard was written with another dictionary")
                index, payload = np.frombuffer(row["index"], INDEX), row["payload"]
                ids = [press.decompress(payload[o : o + n]) for o, n in zip(index["offset"], index["length"], strict=True)]
                number = pd.array(index["id"], "Int64")
                number[index["null"] == 1] = pd.NA
                yield pd.DataFrame(
                    {"doc_id": number, "start": index["before"] + row["part_start"], "n_tokens": index["n"], "ids": ids}
                )

    return shards.join(starts, "part").mapInPandas(texts, "doc_id long, start long, n_tokens long, ids binary")


def read_text(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row with that id): looks the id up in
    the offset indexes and decompresses its frames only."""
    digest, dictionary = _dictionary(spark, folder)
    press = _codec(zstandard.ZstdDecompressor, dictionary)

    def find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                index = np.frombuffer(row["index"], INDEX)
                hit = index[(index["id"] == doc_id) & (index["null"] == 0)]
                yield pd.DataFrame({"frame": [row["payload"][x["offset"] : x["offset"] + x["length"]] for x in hit]})

    shards = spark.read.parquet(f"{folder}/shards").where(F.col("dict_sha256") == digest)
    return [np.frombuffer(press.decompress(bytes(r.frame)), "<u4") for r in shards.mapInPandas(find, "frame binary").collect()]
