"""Byte-level BPE as a streaming transducer, and the way back.

Encoding. A token sequence is the BPE result of its bytes exactly if every
two neighbours are (the pair is what BPE makes of its joined bytes). So the
result for a prefix ends with the longest token that is a suffix of it and
fits the last token of what precedes, and one pass from left to right keeps,
for each position, the last token of the prefix that ends there. A boundary
is stable once the results of all prefixes that may go on agree on it: whatever
follows, the final result passes through the head, or through a place from
which the bytes up to the head are the beginning of a longer token. Stable
tokens are emitted and forgotten; the merge list bounds
how far back the prefixes may disagree (``lookahead``), so memory is constant
however long the text is. New short pretokens (``SHORT``) of a run of texts take
the same steps in order, so that each goes on from the beginning it shares with
the one before; their tokens come out when they end.

Decoding. Token bytes are fed to a byte-to-text state machine one token at a
time; bytes of an unfinished character wait for the next token, malformed
bytes become U+FFFD as in the reference decoder of the vocabulary.

The vocabulary file is the JSON of a byte-level BPE tokenizer (vocabulary,
merges, added tokens); its path is a parameter. Text is cut into pretokens
by the file's pattern first, and strings of added tokens are single ids.

Nulls and special cases: a null or empty text has no ids and decodes to the
empty text; rows with null or repeated ids are encoded like any other; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.shared import blocks

# The byte-level pretoken pattern, and the printable bytes that stand for themselves.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for ASCII texts, in the classes of the faster ``re``.
ASCII_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: entries of the memo of encoded pretokens, whose half not used for longest goes when full, and of neighbours that fit;
#: characters of a text whose pretokens are cut at once; steps of the automaton held besides those along a token
MEMO, PAIRS, CHUNKS, STEPS = 260_000, 220_000, 16_384, 100_000
#: characters of the texts whose new pretokens are met together
RUN = 1 << 21
#: characters of the pretokens that are remembered, below
SHORT = 64
#: bytes between two looks for a stable boundary
STEP = 16
_LEAF: dict = {}  # what may follow a token that begins no longer one


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file."""
    rest = (b for b in range(256) if b not in set(PRINTABLE))
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Vocabulary, merges and the streaming encoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if t not in self.added}
        self.decoded = {**self.bytes_of, **{i: t.encode() for t, i in self.added.items()}}
        ids = {b: i for i, b in self.bytes_of.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = model["vocab"][left], model["vocab"][right]
            self.merges.setdefault((a, b), (rank, model["vocab"][left + right]))
        self.ranks: dict[int, dict[int, int]] = {}  # left token -> right token -> rank of their merge
        for (a, b), (rank, _) in self.merges.items():
            self.ranks.setdefault(a, {})[b] = rank
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.fits = Fits(self)
        # a token can stand in a result only if BPE makes it of its own bytes
        self.ids = {b: i for b, i in ids.items() if self.merge(b) == [i]}
        self.longest = max(map(len, self.ids))
        self.trie: dict = {}  # byte -> (token that ends here or None, the bytes that may follow)
        for b, i in sorted(self.ids.items()):  # a token comes before those it begins
            nodes = self.trie
            for byte in b[:-1]:
                ends, follow = nodes.get(byte, (None, _LEAF))
                if follow is _LEAF:
                    follow = {}
                    nodes[byte] = (ends, follow)
                nodes = follow
            nodes[b[-1]] = (i, _LEAF)
        self.suffixes = Suffixes(self.trie, self.fits)
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self._spines()
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merge(self, data: bytes) -> list[int]:
        """The merge rules as they are defined: lowest rank first, leftmost
        first. Only for single tokens and pairs of them, which are short."""
        out, merges = [self.byte_ids[b] for b in data], self.merges
        while True:
            ranked = [(merges[pair][0], i) for i, pair in enumerate(zip(out, out[1:], strict=False)) if pair in merges]
            if not ranked:
                return out
            i = min(ranked)[1]
            out[i : i + 2] = [merges[out[i], out[i + 1]][1]]

    def _spines(self) -> None:
        """For each token the tokens that stand at its right and left end while
        it is being merged, each with the rank of the merge that ends it."""
        never = len(self.merges)
        made = {token: (rank, pair) for pair, (rank, token) in self.merges.items()}
        # every token comes from one merge, and every merge after those of its parts
        self.simple = len(made) == len(self.merges) and all(
            rank > max(made[part][0] if part in made else -1 for part in pair) for rank, pair in made.values()
        )

        self.right, self.left = Spines(made, 1, never), Spines(made, 0, never)

    def border_holds(self, a: int, b: int) -> bool:
        """Whether BPE leaves the two tokens side by side: no merge across
        their border comes before the merges that take its parts away. Of
        equal merges the left one comes first."""
        if not self.simple:
            return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        left = self.left[b]
        for x, x_dies in self.right[a]:
            if ranks := self.ranks.get(x):
                for y, y_dies in left:
                    if y in ranks and ranks[y] < x_dies and ranks[y] <= y_dies:
                        return False
        return True

    @property
    def lookahead(self) -> int:
        """Bytes after a boundary that always suffice to settle it: a later
        byte moves a boundary only through a chain of different merges, each
        at most one longest token further to the left."""
        return (len(self.merges) + 1) * self.longest

    def stream(self, pieces: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one pretoken whose bytes come in pieces, each id as
        soon as it is stable. Kept are the last token of each prefix since the
        last stable boundary, and the longest beginning of a token at the head."""
        states, last = [0], [-1]  # last[i]: last token of the result of the first i bytes
        check = STEP
        for piece in pieces:
            for at in range(0, len(piece), STEP):
                self._advance(piece[at : at + STEP], states, last)
                del states[:-1]
                if len(last) > check:
                    if cut := self._stable(last, self.suffixes.going(states[0])):
                        yield from self._path(last, cut)
                        last = last[cut:]
                    check = len(last) + STEP - 1
        yield from self._path(last, len(last) - 1)

    def streams(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Token ids of many short pretokens, best given in order: the stream of
        each goes on from what it has in common with the one before it."""
        states, last, before = [0], [-1], b""
        for data in words:
            same = 0
            for x, y in zip(before, data, strict=False):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], last[same + 1 :]
            self._advance(data[same:], states, last)
            yield self._path(last, len(data))
            before = data

    def _advance(self, piece: bytes, states: list[int], last: list[int]) -> None:
        """One step of the automaton a byte, and the last token of each prefix."""
        suffixes, checks, state = self.suffixes, self.suffixes.checks, states[-1]
        for byte in piece:
            state = suffixes[state << 8 | byte]
            for back, token, fits in checks[state]:  # the longest first
                if fits[last[back]]:
                    break
            last.append(token)  # the byte itself, where no longer token fits
            states.append(state)

    def _stable(self, last: list[int], going: list[int]) -> int:
        """The last boundary on which all results that may go on agree. The
        token over the head begins at the head or where a longer token may
        still go on, and what precedes it is the result of that prefix."""
        end = len(last) - 1
        heads = {end, *(end - size for size in going)}
        while len(heads) > 1:
            head = max(heads)
            heads.remove(head)
            heads.add(head - self.size[last[head]])
        return heads.pop()

    def _path(self, last: list, end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= self.size[last[end]]
        return out[::-1]


def utf8_pieces(text: str, step: int = 1024) -> Iterator[bytes]:
    """The bytes of a text, some characters at a time."""
    return (text[i : i + step].encode("utf-8", "surrogatepass") for i in range(0, len(text), step))


def packed(ids: Iterable[int]) -> bytes:
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


class Suffixes(dict):
    """An automaton over the beginnings of tokens: its state is the longest one
    that the bytes so far end with. State << 8 | byte -> next state; states are
    made from the trie when first met, one for each beginning at most."""

    def __init__(self, trie: dict, fits: dict | None = None):
        super().__init__()
        # of each state: its bytes, the state of its longest proper end, the bytes that may follow, and (size, token)
        # of the tokens that it ends with, the longest first
        self.size, self.shorter, self.follow, self.ends = [0], [0], [trie], [()]
        # the same tokens, each with where what it must fit stands, from the head, and with its row of ``fits``
        self.checks, self.fits = [()], fits
        self.others = 0

    def __missing__(self, at: int) -> int:
        state, byte = at >> 8, at & 0xFF
        found = self.follow[state].get(byte)
        # every byte is a token, so the empty beginning has a step for each
        shorter = self[self.shorter[state] << 8 | byte] if state else 0
        if found is None:
            if self.others < STEPS:
                self.others += 1
                self[at] = shorter
            return shorter
        token, follow = found
        size, to = self.size[state] + 1, len(self.size)
        self[at] = to
        self.size.append(size)
        self.shorter.append(shorter)
        self.follow.append(follow)
        self.ends.append(self.ends[shorter] if token is None else ((size, token), *self.ends[shorter]))
        if self.fits is not None:
            checks = self.checks[shorter]
            self.checks.append(checks if token is None else ((-size, token, self.fits[token]), *checks))
        return to

    def going(self, state: int) -> list[int]:
        """How many bytes back the tokens begin that may still go on."""
        out = []
        while state:
            if self.follow[state]:
                out.append(self.size[state])
            state = self.shorter[state]
        return out


class Spines(dict):
    """The tokens at one end of a token, made when the token is first met."""

    def __init__(self, made: dict[int, tuple[int, tuple[int, int]]], side: int, never: int):
        super().__init__()
        self.made, self.side, self.never = made, side, never

    def __missing__(self, token: int) -> tuple[tuple[int, int], ...]:
        out, at = [(token, self.never)], token
        while at in self.made:
            dies, pair = self.made[at]
            at = pair[self.side]
            out.append((at, dies))
        spine = self[token] = tuple(out)
        return spine


class Memo(dict):
    """A bounded memo of ``make``. Half of its entries, once there, are set
    aside for the next half; what is used again meanwhile stays."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.aside = most // 2, {}

    def __missing__(self, key):
        value = self.aside.get(key)
        if value is None:
            value = self.make(key)
        self.enter(key, value)
        return value

    def enter(self, key, value) -> None:
        if len(self) >= self.half:
            self.aside = dict(self)
            self.clear()
        self[key] = value


class Fits(dict):
    """``border_holds``: right token -> left token -> whether they fit. All rows
    share one bound; when it is reached, they are emptied one after another."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.held, self.turn = transducer, 0, iter(())

    def __missing__(self, token: int) -> Row:
        row = self[token] = Row(self, token)
        return row

    def make_room(self) -> None:
        """For one entry more."""
        while self.held >= PAIRS:
            row = next(self.turn, None)
            if row is None:
                self.turn = iter(list(self.values()))
            else:
                self.held -= len(row)
                row.clear()
        self.held += 1


class Row(dict):
    """Of one right token: left token -> whether they fit; at the start (-1) it does."""

    def __init__(self, fits: Fits, token: int):
        super().__init__()
        self.fits, self.token = fits, token

    def __missing__(self, left: int) -> bool:
        self.fits.make_room()
        value = self[left] = left < 0 or self.fits.transducer.border_holds(left, self.token)
        return value


class Words(Memo):
    """Ids (little-endian unsigned 32-bit) of pretokens; long ones are not remembered."""

    def __init__(self, transducer: Transducer):
        super().__init__(MEMO)
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        return super().__missing__(word) if len(word) < SHORT else packed(self.transducer.stream(utf8_pieces(word)))

    def make(self, word: str) -> bytes:
        return packed(self.transducer.stream((word.encode("utf-8", "surrogatepass"),)))

    def meet(self, words: Iterable[str]) -> None:
        """Makes what is missing of the words, in their order."""
        new = []
        for word in words:
            if word not in self and len(word) < SHORT:
                value = self.aside.get(word)
                if value is None:
                    new.append(word)
                else:
                    self.enter(word, value)
        new.sort()
        streams = self.transducer.streams(word.encode("utf-8", "surrogatepass") for word in new)
        for word, ids in zip(new, streams, strict=True):
            self.enter(word, packed(ids))


class Encoder:
    """Ids (little-endian unsigned 32-bit) of texts, cut into pretokens."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.pretokens, self.ascii_pretokens = regex.compile(PRETOKEN), re.compile(ASCII_PRETOKEN)
        self.words = Words(transducer)

    def plain(self, text: str) -> bytes:
        words = self.words
        if len(text) <= CHUNKS:
            return b"".join([words[x] for x in self.pattern(text).findall(text)])
        return b"".join(words[m[0]] for m in self.pattern(text).finditer(text))

    def pattern(self, text: str):
        return self.ascii_pretokens if text.isascii() else self.pretokens

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        special = self.transducer.special
        if special is None or not special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in special.finditer(text):
            if m.start() > at:
                out.append(self.plain(text[at : m.start()]))
            out.append(packed([self.transducer.added[m[0]]]))
            at = m.end()
        return b"".join([*out, self.plain(text[at:]) if at < len(text) else b""])

    def encode_all(self, texts: list) -> list[bytes]:
        """``encode`` of each text, some at a time."""
        out, at, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= RUN or end == len(texts):
                out += self._together(texts[at:end])
                at, size = end, 0
        return out

    def _together(self, texts: list) -> list[bytes]:
        """What the texts bring of new pretokens is met at once; long texts and
        those with added tokens go by themselves."""
        special, words = self.transducer.special, self.words
        plain = (text and len(text) <= CHUNKS and (special is None or not special.search(text)) for text in texts)
        cut = [self.pattern(text).findall(text) if x else None for text, x in zip(texts, plain, strict=True)]
        words.meet(set().union(*(x for x in cut if x)))
        return [self.encode(text) if x is None else b"".join([words[w] for w in x]) for text, x in zip(texts, cut, strict=True)]


def decode_ids(transducer: Transducer, ids: bytes, step: int = 4096) -> str:
    """The text of ids: token bytes go through the incremental byte-to-text
    machine a step of ids at a time."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    table, values, out = transducer.decoded, np.frombuffer(ids, "<u4"), []
    for i in range(0, len(values), step):
        out.append(machine.decode(b"".join([table[x] for x in values[i : i + step].tolist()])))
    return "".join([*out, machine.decode(b"", final=True)])


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(Transducer(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row; ids are little-endian unsigned 32-bit integers."""
    return _run(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path, "text", "ids binary", _encode)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) per row of ids as ``encode`` returns them."""
    return _run(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), path, "ids", "decoded string", _decode)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row: ``encode`` and ``decode`` in one pass."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _run(docs, path, "text", "ids binary, decoded string", _both)


def _encode(encoder: Encoder, texts: list) -> dict:
    return {"ids": encoder.encode_all(texts)}


def _decode(encoder: Encoder, ids: list) -> dict:
    return {"decoded": [decode_ids(encoder.transducer, x or b"") for x in ids]}


def _both(encoder: Encoder, texts: list) -> dict:
    ids = encoder.encode_all(texts)
    return {"ids": ids, "decoded": [decode_ids(encoder.transducer, x) for x in ids]}


def _run(rows: DataFrame, path: str, column: str, out: str, work) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for frame in blocks(frames, column):
            values = [x if isinstance(x, (str, bytes, bytearray)) else None for x in frame[column].tolist()]
            yield pd.DataFrame({"doc_id": _ids(frame["doc_id"]), **work(encoder, values)})

    return rows.mapInPandas(run, f"doc_id {kind}, {out}")


def _ids(column: pd.Series) -> pd.Series:
    """Integer ids with nulls come as floats from Arrow; keep them whole."""
    return column.astype("Int64") if column.dtype.kind == "f" else column
