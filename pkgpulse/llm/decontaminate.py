"""Benchmark decontamination with a distributed positional inverted index.

A test window is ``size`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. Words are counted in the corpus
first; the index then stores the postings (document, position) of the rarest
terms of each window only. A window's rarest list gives candidate places; the
offset-adjusted lists of its next rarest terms are intersected with them, and
what is left is compared with the whole text word by word.

Index, windows and the final comparison lower-case A-Z only, as words are
defined: maximal runs of characters outside U+0000..U+007F except digits and
a-z after that step. So a word gives one term whatever stands around it.

Only DataFrame operations are used. No text is moved but those that hold a
candidate; rows of a document are told apart by id and a hash of the text.

Nulls and special cases: a null text or item has no words; a document without
hits returns 0, no items and ``contaminated`` false; a null item id belongs to
no list of items, but its windows count as hits; repeated rows get equal
results each; other columns are ignored; with no items nothing is hit; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pkgpulse.llm.shared import written

#: words of a window; lists that are intersected before texts are compared
SIZE, LISTS = 10, 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what ends a word, upper-case letters aside
BREAKS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


def folded(text: Column) -> Column:
    """A-Z lower-cased and everything between words turned into spaces."""
    return F.translate(text, UPPER + BREAKS, LOWER + " " * len(BREAKS))


def exact_words(text: Column) -> Column:
    """The words of a text as an array."""
    # one character, not a pattern: it is split without the regular expression engine
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), " "), "")


def _tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., term, pos): the folded words of each text and their places."""
    return docs.where("text is not null").select(*keep, F.posexplode(exact_words(F.col("text"))).alias("pos", "term"))


def test_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, n, items): each distinct window as its words joined by a space."""
    words = items.select("item_id", exact_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at"))
    cut = starts.select("item_id", F.slice("w", F.col("at"), size).alias("w"))
    return cut.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("n")).agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.withColumn("row", F.xxhash64("text"))


def rare_terms(docs: DataFrame, windows: DataFrame, lists: int = LISTS) -> DataFrame:
    """(window, n, t0, o0, t1, o1, ...): the rarest terms of each window in the
    corpus and their offsets. A window with a term that the corpus lacks goes."""
    terms = windows.select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "term"))
    terms = written(terms, "terms")
    vocabulary = written(terms.select("term").distinct(), "vocabulary")
    counts = _tokens(docs).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(written(counts, "df"), "term", "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("window").orderBy(F.col("df").asc_nulls_first(), "offset")) - 1
    )
    picked = [
        F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c[0]}{i}") for i in range(lists) for c in ("term", "offset")
    ]
    wide = ranked.groupBy("window", "n").agg(F.bool_and(F.col("df").isNotNull()).alias("there"), *picked).where("there")
    for i in range(1, lists):  # a window of fewer terms repeats its rarest
        wide = wide.withColumns({f"t{i}": F.coalesce(f"t{i}", "t0"), f"o{i}": F.coalesce(f"o{i}", "o0")})
    return written(wide.drop("there"), "rare")


def postings(docs: DataFrame, rare: DataFrame, lists: int = LISTS) -> DataFrame:
    """The stored index: (term, doc_id, row, pos) of every term picked."""
    wanted = rare.select(F.explode(F.array_distinct(F.array(*(f"t{i}" for i in range(lists))))).alias("term")).distinct()
    return written(_tokens(docs, "doc_id", "row").join(written(wanted, "wanted"), "term").distinct(), "postings")


def _same_place(index: DataFrame, term: str, pos: Column) -> list[Column]:
    return [
        F.col("c.doc_id").eqNullSafe(F.col("p.doc_id")),
        F.col("c.row") == F.col("p.row"),
        F.col(f"c.{term}") == F.col("p.term"),
        pos == F.col("p.pos"),
    ]


def phrase_matches(
    docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, row, start, n, window, items) for every exact occurrence of a
    test window; ``start`` counts words from 0."""
    docs = _keyed(docs, id_col, text_col)
    windows = written(test_windows(items, size), "windows")
    rare = rare_terms(docs, windows)
    index = postings(docs, rare)
    found = index.join(rare, index.term == rare.t0).withColumn("start", F.col("pos") - F.col("o0")).where("start >= 0")
    found = found.drop("term", "pos")
    for i in range(1, LISTS):
        place = F.col("c.start") + F.col(f"c.o{i}")
        found = found.alias("c").join(index.alias("p"), _same_place(index, f"t{i}", place), "left_semi")
    found = written(found.select("doc_id", "row", "start", "n", "window"), "candidates")
    holders = written(found.select("doc_id", "row").distinct(), "holders")
    texts = docs.alias("d").join(
        holders.alias("h"), [F.col("d.row") == F.col("h.row"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))], "left_semi"
    )
    texts = texts.dropDuplicates(["doc_id", "row"]).select("doc_id", "row", exact_words(F.col("text")).alias("w"))
    places = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n", "window")).alias("places"))
    both = texts.alias("d").join(
        places.alias("h"), [F.col("d.row") == F.col("h.row"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))]
    )
    same = F.filter("places", lambda p: F.array_join(F.slice("w", p["start"] + 1, p["n"]), " ") == p["window"])
    exact = both.select("d.doc_id", "d.row", F.explode(same).alias("p")).select("doc_id", "row", "p.*")
    return written(exact.join(windows.select("window", "items"), "window"), "matches")


def proximity_matches(
    docs: DataFrame, items: DataFrame, slack: int = 3, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, row, window, near): places where all listed rare terms of a
    window stand at most ``slack`` words off their offsets from the rarest."""
    docs = _keyed(docs, id_col, text_col)
    rare = rare_terms(docs, written(test_windows(items, size), "windows"))
    index = postings(docs, rare)
    found = index.join(rare, index.term == rare.t0).withColumn("near", F.col("pos") - F.col("o0")).drop("term", "pos")
    width = slack + 1
    cells = index.withColumn("cell", F.floor(F.col("pos") / width))
    for i in range(1, LISTS):
        aim = F.col("near") + F.col(f"o{i}")
        wide = found.withColumn("aim", aim).withColumn("cell", F.explode(F.array(*(F.floor(F.col("aim") / width) + d for d in (-1, 0, 1)))))
        on = [
            F.col("c.doc_id").eqNullSafe(F.col("p.doc_id")),
            F.col("c.row") == F.col("p.row"),
            F.col(f"c.t{i}") == F.col("p.term"),
            F.col("c.cell") == F.col("p.cell"),
            F.abs(F.col("p.pos") - F.col("c.aim")) <= slack,
        ]
        found = wide.alias("c").join(cells.alias("p"), on, "left_semi").drop("aim", "cell").distinct()
    return found.select("doc_id", "row", "window", "near")


def contamination(
    docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    matches = phrase_matches(docs, items, size, id_col, text_col)
    # words covered: each occurrence adds what lies beyond all that start before it
    earlier = Window.partitionBy("doc_id", "row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = matches.select("doc_id", "row", "start", "n").distinct()
    reach = spans.withColumn("reached", F.coalesce(F.max(F.col("start") + F.col("n")).over(earlier), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "reached"))
    hits = reach.groupBy("doc_id", "row").agg(F.sum(fresh).cast("long").alias("n_hit"))
    listed = matches.select("doc_id", "row", F.explode("items").alias("item")).distinct()
    lists = listed.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("item")).alias("found"))
    both = hits.alias("x").join(
        lists.alias("y"), [F.col("x.row") == F.col("y.row"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id"))], "left"
    )
    result = written(both.select("x.doc_id", "x.row", "n_hit", "found"), "hits")
    n_words = F.size(exact_words(F.col("text"))).cast("long")
    all_docs = _keyed(docs, id_col, text_col).select("doc_id", "row", n_words.alias("n_words"))
    joined = all_docs.alias("d").join(
        result.alias("r"), [F.col("d.row") == F.col("r.row"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))], "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
