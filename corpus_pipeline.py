"""The training-data pipeline: documents -> clean, single, encoded documents.

Stages, in order: quality classifier and language ID (rejected documents go),
n-gram Jaccard join (of each group of near copies one row stays, that of the
smallest id; a null id comes last),
benchmark decontamination (documents that hold a benchmark passage go), BPE
encoding and decoding (adds the ids; every document stays).

Each stage gets all that its predecessor kept, written as Parquet in the
shared folder. All stages but the last return the columns of ``documents``.
Rows are judged and dropped by a key, a 64-bit hash of all their columns, so
that null or repeated ids do not matter: each row goes by its own judgement,
and only rows that are equal in every column are judged as one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgpulse.llm import bpe_stream, decontaminate, language_id, quality_cotraining
from pkgpulse.llm.jaccard_join import jaccard_components
from pkgpulse.llm.shared import remainder, ship, table, written

#: near copies: shingles of this many words, similarity of p / q or more
SHINGLE, P, Q = 5, 4, 5
#: a language is accepted from this score on, and, in texts of so many words or more, from this share of known words on
LANGUAGE_SCORE, LANGUAGE_WORDS, KNOWN_SHARE = 0.5, 4, 0.2
#: texts that go to an encoding worker at once
BPE_ROWS = 1000


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of the row in place of its id, to be judged."""
    return docs.withColumn("doc_id", _key(docs))


def _keep(docs: DataFrame, judged: DataFrame, drop: Column) -> DataFrame:
    """``docs`` without the rows whose key ``drop`` marks in ``judged``."""
    gone = written(judged.where(drop).select(F.col("doc_id").alias("key")).distinct(), "gone")
    return docs.withColumn("key", _key(docs)).join(gone, "key", "left_anti").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents of low quality go."""
    ship(spark)
    seen = written(quality_cotraining.views(docs, key=_key(docs)), "views")
    model = quality_cotraining.fit_views(seen, table(spark, sf_dir, "labels"))
    judged = quality_cotraining.judge_views(seen.withColumn("doc_id", F.col("key")), model)
    return _keep(docs, judged, ~F.col("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a language, or of an unsure one, go, and
    those that share few words with other documents of the language."""
    ship(spark)
    learned = remainder("doc_id", 5) != 0
    model = language_id.learn(docs.where(learned))
    keyed = docs.withColumn("learned", learned & F.col("lang").isNotNull()).withColumn("doc_id", _key(docs))
    unsure = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LANGUAGE_SCORE)
    strange = (F.col("n_words") >= LANGUAGE_WORDS) & (F.col("n_known") < KNOWN_SHARE * F.col("n_words"))
    return _keep(docs, language_id.predict(keyed, model, F.col("learned")), unsure | strange)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near copies one row of the smallest id stays."""
    ship(spark)
    groups = jaccard_components(_keyed(docs), shingle=SHINGLE, p=P, q=Q)
    groups = groups.groupBy("doc_id", "component_id").agg(F.max("n_shingles").alias("n_shingles"), F.count("*").alias("times"))
    groups = written(groups, "groups")
    ids = docs.select(_key(docs).alias("key"), F.col("doc_id").alias("id")).distinct()
    first = groups.join(ids, F.col("doc_id") == F.col("key")).groupBy("component_id")
    first = first.agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "key"))["key"].alias("doc_id"))
    kept = _keep(docs, groups.join(first, ["component_id", "doc_id"], "left_anti"), F.lit(True)).withColumn("key", _key(docs))
    equal = written(groups.where("times > 1 and n_shingles > 0").select(F.col("doc_id").alias("key")).distinct(), "equal")
    once = kept.join(equal, "key", "left_semi").dropDuplicates(["key"])
    return kept.join(equal, "key", "left_anti").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a passage of the benchmark go."""
    ship(spark)
    judged = decontaminate.contamination(_keyed(docs), table(spark, sf_dir, "benchmark"))
    return _keep(docs, judged, F.col("contaminated"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ids and their count, and whether they decode to the text."""
    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_stream.round_trip(docs, path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    return written(coded, "coded", batch=BPE_ROWS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: SQL cannot express the classifiers or the tokenizer; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
