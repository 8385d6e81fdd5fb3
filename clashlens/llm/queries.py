"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clashlens.llm import (conversation_repair, decontaminate, fingerprint, jaccard_join, language_id, lexical_search,
                           line_dedup, mixing, quality, simhash, token_codes, token_count, warc)
from clashlens.llm.common import bounded_batches, held_out
from clashlens.llm.common import table as read

#: Shares of all tokens that the mixture aims at.
MIXTURE = {"good": 0.90, "poor": 0.08, "toxic": 0.02}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return read(spark, sf_dir, name)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, mixing.domains_of(table(spark, sf_dir, "labels")))
    return mixing.mix(docs, model, MIXTURE).documents


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "proportions")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(), limit=1024)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.round_trip(table(spark, sf_dir, "documents"), tokenizer_file(), end=2)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=0.7).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=20)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_target_mixing, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_language_id, op5_token_counts,
        op6_warc_derivatives, op7_token_id_output, op8_quality_classifier, op9_document_fingerprints, op10_line_dedup,
        op11_conversation_repair, op12_ranked_lexical_search, op13_simhash_near_dedup)
}
