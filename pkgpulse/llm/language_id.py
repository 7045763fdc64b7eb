"""Word-first language identification with back-off to character n-grams.

Learning counts every word of every training text per language, and character
n-grams over all distinct words; all of them keep their counts. A known word
scores its log frequency in each language; an unseen word falls back to the
mean of its known n-grams of the greatest length that has any, from ``GRAM``
down to 1. A text's score is the posterior of the languages under equal priors.

The commonest words and n-grams go to the tasks. Where they are not all there
are, a text's other words are left open: each distinct open word is joined to
the table of the other words or, when it is not there, its n-grams to that of
the other n-grams, and the log frequencies are added to the texts by a join.

The posterior is near 1 after a few words, whatever they are. So ``predict``
also counts the known words: those learned from other texts of the predicted
language. Gibberish and languages that were not learned have few.

Words are maximal runs of letters of the lower-cased text.

Nulls and special cases: a null text, or one without a letter, is ``und``
with score 0; rows with null text or null language are not learned from; ties
go to the language that sorts first; with nothing learned every text is
``und`` with score 0. Rows with null or repeated ids are judged like any
other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import compress, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgpulse.llm.shared import blocks, written

#: words and n-grams of each length sent to every task (all others are joined); greatest length
WORDS, GRAMS, GRAM = 60_000, 20_000, 5
#: distinct entries a task counts before it hands them on; words whose n-grams it counts at once; scored words it remembers
HELD, GRAM_WORDS, MEMO = 300_000, 500, 400_000
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + n] for i in range(len(edged) - n + 1)] if n > 1 else list(word)


def _count_words(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = [(w, lang, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["word", "lang", "n"])

    for frame in blocks(frames, "text"):
        for text, lang in zip(frame["text"], frame["lang"], strict=True):
            held.setdefault(lang, Counter()).update(words(text))
        if sum(map(len, held.values())) > HELD:
            yield flush()
    yield flush()


def _count_grams(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = [(len(g), g, lang, n) for lang, c in held.items() for g, n in c.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["size", "gram", "lang", "n"])

    for frame in frames:
        for lang, own in frame.groupby("lang", sort=False)["word"]:
            counter, of_words = held.setdefault(lang, Counter()), own.tolist()
            for i in range(0, len(of_words), GRAM_WORDS):
                counter.update([g for word in of_words[i : i + GRAM_WORDS] for n in range(1, GRAM + 1) for g in grams(word, n)])
                if sum(map(len, held.values())) > HELD:
                    yield flush()
                    counter = held.setdefault(lang, Counter())
    yield flush()


def _pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each length the entries, none of which holds a line break, as one
    string, and their counts per language as 64-bit integers."""
    for frame in frames:
        for size, own in frame.groupby("size", sort=False):
            counts = np.stack(own["n"].to_list()).astype(np.int64)
            yield pd.DataFrame({"size": [size], "entries": ["\n".join(own["entry"])], "n": [counts.tobytes()]})


@dataclass
class Model:
    """Log frequencies per language: one row of ``table`` per common entry;
    ``rest`` has the others as (entry, logs) by length, words under 0."""

    langs: list[str]
    word_row: dict[str, int]
    gram_row: dict[str, int]
    table: np.ndarray
    unseen: np.ndarray  # a word none of whose characters was learned
    totals: np.ndarray = field(default_factory=lambda: np.zeros(0))  # what the counts of words are divided by
    rest: dict[int, DataFrame] = field(default_factory=dict)


def _known(logs: np.ndarray, times: np.ndarray, own: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Per language, how many of a text's learned words were counted more
    often than in the text itself (``own``, if it was learned from)."""
    return times @ (logs > np.log((own[:, None] + 0.75) / totals))


def _backed_off(model: Model, word: str, longest: int = GRAM) -> np.ndarray:
    for n in range(longest, 0, -1):
        known = [model.gram_row[g] for g in grams(word, n) if g in model.gram_row]
        if known:
            return model.table[known].mean(0)
    return model.unseen


class Scorer(dict):
    """word -> row of ``rows``; unseen words are scored once and remembered.
    For models without ``rest``, which hold all there is to look up."""

    def __init__(self, model: Model):
        super().__init__(model.word_row)
        self.model = model
        self.rows = np.zeros((len(model.table) + MEMO, len(model.langs)))
        self.rows[: len(model.table)] = model.table
        self.used = len(model.table)

    def __missing__(self, word: str) -> int:
        at = self.used
        self.rows[at] = self.backed_off(word)
        self.used += 1
        self[word] = at
        return at

    def backed_off(self, word: str) -> np.ndarray:
        return _backed_off(self.model, word)

    def score(self, text: str | None, learned: bool = False) -> tuple[str, float, int, int]:
        """Language, posterior, number of words, number of known ones."""
        found = list(Counter(words(text)).items()) if isinstance(text, str) else []
        langs = self.model.langs
        if not found or not langs:
            return UNKNOWN, 0.0, sum(n for _, n in found), 0
        total, known = np.zeros(len(langs)), np.zeros(len(langs), np.int64)
        for i in range(0, len(found), MEMO // 2):
            part = found[i : i + MEMO // 2]
            if self.used + len(part) > len(self.rows):  # forget the unseen words
                self.clear()
                self.update(self.model.word_row)
                self.used = len(self.model.table)
            at, times = np.array([(self[w], n) for w, n in part], np.int64).T
            total += times @ self.rows[at]
            word = at < len(self.model.word_row)
            at, times = at[word], times[word]
            known += _known(self.rows[at], times, times * learned, self.model.totals)
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return langs[best], float(odds[best] / odds.sum()), sum(n for _, n in found), int(known[best])


def learn(docs: DataFrame, n_words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """Learn from columns ``text`` and ``lang``. Counts cover all rows; of the
    entries, at most ``n_words`` words and ``n_grams`` n-grams of each length
    reach the driver, the others stay in a table."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInPandas(_count_words, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    by_gram = counts.select("word", "lang").mapInPandas(_count_grams, "size int, gram string, lang string, n long")
    by_gram = by_gram.groupBy("size", F.col("gram").alias("entry"), "lang").agg(F.sum("n").alias("n"))
    both = counts.select(F.lit(0).alias("size"), F.col("word").alias("entry"), "lang", "n").unionByName(by_gram)
    entries = both.groupBy("size", "entry").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by"))
    entries = written(entries, "entries")
    by_lang = entries.select("size", F.explode("by").alias("by")).groupBy("size", "by.lang").agg(F.sum("by.n").alias("n"))
    sums = {(r["size"], r.lang): r.n for r in by_lang.collect()}
    langs = sorted(lang for size, lang in sums if size == 0)
    if not langs:
        return Model(langs, {}, {}, np.zeros((0, 0)), np.zeros(0))

    # the least count of the common entries of each length, and the number of all
    least, distinct, common = {}, Counter(), Counter()
    for r in entries.groupBy("size", "n").agg(F.count("*").alias("types")).orderBy("size", F.desc("n")).collect():
        distinct[r["size"]] += r.types
        if distinct[r["size"]] <= (n_grams if r["size"] else n_words):
            least[r["size"]], common[r["size"]] = r.n, distinct[r["size"]]
    size = F.col("size")
    is_common = F.lit(False)
    for length, n in least.items():
        is_common |= (size == length) & (F.col("n") >= n)
    counted = F.map_from_entries("by")
    top = entries.where(is_common).select("size", "entry", F.array(*(F.coalesce(counted[x], F.lit(0)) for x in langs)).alias("n"))
    packed = {}  # entries and counts of each length
    for r in top.mapInPandas(_pack, "size int, entries string, n binary").collect():
        packed.setdefault(r["size"], []).append((r.entries, r.n))

    tables, word_row, gram_row, rest, used, totals = [], {}, {}, {}, 0, np.zeros(0)
    for length in sorted(distinct):
        found = packed.pop(length, [])
        total = np.array([sums.get((length, x), 0) for x in langs], float) + 0.5 * (distinct[length] + 1)
        totals = total if length == 0 else totals
        values = [v for text, _ in found for v in text.split("\n")]
        order = sorted(range(len(values)), key=values.__getitem__)
        table = np.frombuffer(b"".join(n for _, n in found), np.int64).reshape(-1, len(langs))[order] + 0.5
        (gram_row if length else word_row).update((values[at], used + i) for i, at in enumerate(order))
        tables.append(np.log(table / total))
        used += len(values)
        if common[length] < distinct[length]:
            others = entries.where(size == length).where(~is_common).select("entry", F.map_from_entries("by").alias("by"))
            log = [F.log((F.coalesce(F.col("by")[x], F.lit(0)) + 0.5) / float(t)) for x, t in zip(langs, total, strict=True)]
            rest[length] = others.select("entry", F.array(*log).alias("logs"))
    return Model(langs, word_row, gram_row, np.concatenate(tables), np.zeros(len(langs)), totals, rest)


def _sums(logs: str, n: int, times: Column | None = None) -> Column:
    """Element by element, the sum of an array column of ``n`` numbers."""
    return F.array(*(F.sum(F.col(logs)[i] * times if times is not None else F.col(logs)[i]) for i in range(n)))


def _open_words(frames: Iterable[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """Of each text the number of words, the sum of the logs of the common
    ones, per language how many of these are known, and the others with their
    counts."""
    for frame in blocks(frames, "text"):
        rows = []
        for text, learned in zip(frame["text"], frame["learned"], strict=True):
            found = Counter(words(text) if isinstance(text, str) else [])
            every = np.fromiter(map(model.word_row.get, found, repeat(-1)), np.int64, len(found))
            counts, open_ = np.fromiter(found.values(), np.int64, len(found)), every < 0
            at, times = every[~open_], counts[~open_]
            logs = model.table[at]
            n_known = _known(logs, times, times * bool(learned), model.totals)
            rows.append((bool(learned), int(counts.sum()), times @ logs, n_known, list(compress(found, open_)), counts[open_]))
        out = pd.DataFrame(rows, columns=["learned", "n_words", "logs", "known", "open", "times"])
        out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
        yield out


def _unseen_logs(unseen: DataFrame, model: Model, shared) -> DataFrame:
    """(word, logs) of words that were not learned, by their n-grams."""
    n_langs, done = len(model.langs), []
    for n in range(GRAM, 0, -1):
        if not any(size in model.rest for size in range(1, n + 1)):  # the tasks have all of these

            def finish(frames: Iterable[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    logs = [_backed_off(shared.value, w, n) for w in frame["word"]]
                    yield pd.DataFrame({"word": frame["word"], "logs": logs})

            done.append(unseen.mapInPandas(finish, "word string, logs array<double>"))
            break

        def cut(frames: Iterable[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
            model = shared.value
            for frame in frames:
                rows = []
                for word in frame["word"]:
                    found = grams(word, n)
                    known = [model.gram_row[g] for g in found if g in model.gram_row]
                    rows.append((word, len(known), model.table[known].sum(0), [g for g in found if g not in model.gram_row]))
                yield pd.DataFrame(rows, columns=["word", "known", "logs", "open"])

        parts = written(unseen.mapInPandas(cut, "word string, known long, logs array<double>, open array<string>"), "grams")
        if n in model.rest:
            found = parts.select("word", F.explode("open").alias("entry")).join(model.rest[n].hint("merge"), "entry").groupBy("word")
            found = found.agg(F.count("*").alias("more"), _sums("logs", n_langs).alias("added"))
            parts = parts.join(found, "word", "left")
        else:
            parts = parts.withColumns({"more": F.lit(0), "added": F.lit(None).cast("array<double>")})
        n_known = F.col("known") + F.coalesce("more", F.lit(0))
        mean = F.array(*((F.col("logs")[i] + F.coalesce(F.col("added")[i], F.lit(0.0))) / F.col("n_known") for i in range(n_langs)))
        parts = written(parts.withColumn("n_known", n_known).select("word", "n_known", F.when(F.col("n_known") > 0, mean).alias("logs")), "backed")
        done.append(parts.where("n_known > 0").select("word", "logs"))
        unseen = parts.where("n_known = 0").select("word")
    else:
        none = F.array(*(F.lit(float(x)) for x in model.unseen))
        done.append(unseen.select("word", none.alias("logs")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _joined(docs: DataFrame, model: Model, shared) -> DataFrame:
    """``predict`` where not all entries are with the tasks."""
    n_langs = len(model.langs)
    cut = docs.mapInPandas(
        lambda frames: _open_words(frames, shared.value),
        "doc_id long, learned boolean, n_words long, logs array<double>, known array<long>, open array<string>, times array<long>",
    )
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "scored")
    pairs = cut.select("row", "learned", F.explode(F.arrays_zip("open", "times")).alias("x"))
    pairs = pairs.select("row", "learned", F.col("x.open").alias("word"), "x.times")
    distinct = pairs.select("word").distinct()
    if 0 in model.rest:
        looked = written(distinct.join(model.rest[0].withColumnRenamed("entry", "word").hint("merge"), "word", "left"), "looked")
        unseen = _unseen_logs(looked.where("logs is null").select("word"), model, shared)
        logs = looked.where("logs is not null").withColumn("is_word", F.lit(True))
        logs = logs.unionByName(unseen.withColumn("is_word", F.lit(False)))
    else:
        logs = _unseen_logs(written(distinct, "open"), model, shared).withColumn("is_word", F.lit(False))
    own = F.when(F.col("learned"), F.col("times")).otherwise(0) + 0.75
    more = [F.when(F.col("is_word") & (F.col("logs")[i] > F.log(own / float(t))), F.col("times")) for i, t in enumerate(model.totals)]
    added = pairs.join(logs, "word").groupBy("row").agg(
        _sums("logs", n_langs, F.col("times")).alias("added"), F.array(*(F.coalesce(F.sum(x), F.lit(0)) for x in more)).alias("more")
    )
    total = F.array(*(F.col("logs")[i] + F.coalesce(F.col("added")[i], F.lit(0.0)) for i in range(n_langs)))
    known = F.array(*(F.col("known")[i] + F.coalesce(F.col("more")[i], F.lit(0)) for i in range(n_langs)))
    summed = cut.select("row", "doc_id", "n_words", "logs", "known").join(added, "row", "left")
    summed = summed.select("doc_id", "n_words", total.alias("total"), known.alias("known")).withColumn("best", F.array_max("total"))
    odds = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    place = F.array_position("total", F.col("best")).cast("int")
    some = F.col("n_words") > 0
    return summed.select(
        "doc_id",
        F.when(some, F.element_at(F.array(*map(F.lit, model.langs)), place)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, 1 / odds).otherwise(0.0).alias("score"),
        "n_words",
        F.when(some, F.element_at("known", place)).otherwise(0).cast("long").alias("n_known"),
    )


def predict(docs: DataFrame, model: Model, learned: Column | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_known) per row, from the text
    alone. ``learned`` marks rows that the model was learned from: their own
    words do not make them known."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, rest={}))
    own = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("learned"))
    if model.rest:
        return _joined(docs, model, shared)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in blocks(frames, "text"):
            rows = list(map(scorer.score, frame["text"], frame["learned"]))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "n_words", "n_known"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.mapInPandas(run, "doc_id long, lang_pred string, score double, n_words long, n_known long")
