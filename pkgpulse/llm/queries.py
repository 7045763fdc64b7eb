"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgpulse.llm import (
    bpe_stream,
    decontaminate,
    host_reputation,
    html_extract,
    language_id,
    lm_mixing,
    oracles,
    periodic_runs,
    prefix_trie,
    quality_cotraining,
    quality_trees,
    set_sketch,
    token_store,
)
from pkgpulse.llm.jaccard_join import jaccard_components
from pkgpulse.llm.shared import remainder, ship, table, written


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, p=9, q=10)


def op3_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose crc32(doc_id) mod 7 is not 2; all are scored."""
    return lm_mixing.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)


#: rules of the URL filter: host/path prefix -> verdict
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by rules, else by the reputation of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = host_reputation.page_outcomes(pages, table(spark, sf_dir, "labels"))
    return host_reputation.judge(pages, outcomes, URL_RULES)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of every benchmark item in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined score of both views for every document."""
    seen = written(quality_cotraining.views(table(spark, sf_dir, "documents")), "views")
    return quality_cotraining.judge_views(seen, quality_cotraining.fit_views(seen, table(spark, sf_dir, "labels")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the documents whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(remainder("doc_id", 5) != 0))
    return language_id.predict(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_trees.judge(docs, quality_trees.fit(docs, table(spark, sf_dir, "labels")))


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_stream.round_trip(table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of all documents, written and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = token_store.write_store(table(spark, sf_dir, "documents"), path, end=2)
    return token_store.read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the first turns of another."""
    convs = prefix_trie.paths(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.entries(prefix_trie.rebuilt(convs)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, one in ten of them with a periodic tail."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.detect(docs, text_col=periodic_runs.with_periodic_tail("doc_id", "text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-word shingles, Jaccard similarity of 0.8 or more."""
    return set_sketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, p=4, q=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = [op1_html_extract, op2_jaccard_join, op3_lm_mixing, op4_host_reputation, op5_decontaminate, op6_quality_cotraining, op7_language_id, op8_quality_trees, op9_bpe_stream, op10_token_store, op11_prefix_trie, op12_periodic_runs, op13_set_sketch, pipeline]


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipping(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
