"""Sentences and their term vectors (T-1, T-2, E-1 built-in encoder, D-2).

Everything here is a narrow projection or explode: no shuffle. A document's sentences are produced
by the task that reads the document, so a long document costs one row's worth of work per sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.functions import text as tx

TERM_VECTOR_COLS = ("terms", "nsq", "nd", "neg")


def sentence_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sents ARRAY<STRING>, total_sentences INT): one row per document, NULL text -> 0."""
    sents = tx.split_sentences(F.col(text))
    return docs.select(
        F.col(key), F.coalesce(sents, F.array().cast("array<string>")).alias("sents")
    ).withColumn("total_sentences", F.size("sents"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, sentence): sentence position is 0-based and is the sentence's identity."""
    return explode_sentences(sentence_arrays(docs, key, text), key)


def explode_sentences(arrays: DataFrame, key: str = "doc_id", keep=()) -> DataFrame:
    """(key, idx, sentence) from per-document sentence arrays, and further columns to ``keep``.

    posexplode_outer + a null filter instead of posexplode: the plain generator makes Catalyst infer
    a ``size(sents) > 0`` filter that would evaluate the whole split expression a second time.
    """
    return (arrays.select(F.col(key), *keep, F.posexplode_outer("sents").alias("idx", "sentence"))
            .where(F.col("idx").isNotNull()))


def with_term_vector(df: DataFrame, sentence: str, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}terms, nsq, nd, neg``: the sentence's sparse term-count vector (built-in encoder).

    terms = ARRAY<STRUCT<token, tf>> sorted by token, nsq = squared norm (exact integer),
    nd = distinct tokens, neg = holds a negation word. Computed by run-length encoding the sorted
    token array in the row (O(n log n)); each step is its own projection so no lambda re-evaluates
    an array expression per element.
    """
    p = prefix
    out = (df.withColumn(f"{p}_toks", tx.tokens(F.col(sentence)))
             .withColumn(f"{p}neg", tx.has_negation(F.col(f"{p}_toks")))
             .withColumn(f"{p}_sorted", F.array_sort(F.col(f"{p}_toks")))
             .withColumn(f"{p}_starts", tx.run_starts(F.col(f"{p}_sorted")))
             .withColumn(f"{p}terms", tx.run_lengths(F.col(f"{p}_sorted"), F.col(f"{p}_starts")))
             .drop(f"{p}_toks", f"{p}_sorted", f"{p}_starts"))
    return (out.withColumn(f"{p}nsq", tx.sum_squares(F.col(f"{p}terms")))
               .withColumn(f"{p}nd", F.size(F.col(f"{p}terms"))))


def sentence_vectors(sents: DataFrame, keys=("doc_id", "idx"), sentence: str = "sentence") -> DataFrame:
    """One row per sentence with its sparse term-count vector (built-in encoder, exact)."""
    return with_term_vector(sents.select(*keys, sentence), sentence).select(*keys, *TERM_VECTOR_COLS)


def term_rows(vectors: DataFrame, keys=("doc_id", "idx")) -> DataFrame:
    """(keys, token, tf, nsq, nd, neg): one row per distinct token of a sentence.

    explode_outer + null filter: a plain explode lets Catalyst infer ``size(terms) > 0`` and push it
    below the projections, inlining the whole term-vector expression into a second, per-element copy.
    """
    return (vectors.select(*keys, F.explode_outer("terms").alias("t"), "nsq", "nd", "neg")
            .where(F.col("t").isNotNull())
            .select(*keys, F.col("t.token").alias("token"), F.col("t.tf").alias("tf"), "nsq", "nd", "neg"))
