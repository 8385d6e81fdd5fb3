"""Similarity of aligned pairs with a sentence encoder (E-1, E-4): each distinct sentence is encoded once.

Sentences of both sides are named by 128 bits (md5), brought together by an aggregation on the name (a
sentence that stands in a third of all pairs is one row before any shuffle), encoded, and written to the
shared folder: what reads the vectors never runs the encoder again, nor does a lost executor's work. The
distinct pairs of names then meet their vectors in two joins, the product of the unit vectors is taken in
the row, and only names and cosines go back to the pairs.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clashlens.config import BATCH_SIZE
from clashlens.operators.hooks import encode_with
from clashlens.session import ensure_checkpoint_dir


def sentence_key(sentence: Column) -> Column:
    """128 bits that name a sentence; NULL is the empty sentence, as the encoder gets it."""
    return F.unhex(F.md5(F.coalesce(sentence, F.lit(""))))


def encoded_once(sentences: DataFrame, load_encoder: Callable[[], object], batch_size: int = BATCH_SIZE, col: str = "sentence") -> DataFrame:
    """(key, embedding) of the distinct sentences of a column, encoded once each and written."""
    ensure_checkpoint_dir(sentences.sparkSession)
    distinct = (sentences.select(sentence_key(F.col(col)).alias("key"), F.coalesce(F.col(col), F.lit("")).alias("sentence"))
                .groupBy("key").agg(F.first("sentence").alias("sentence")))
    return encode_with(distinct, load_encoder, batch_size=batch_size).select("key", "embedding").checkpoint(eager=True)


def unit_dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors of unit length (E-4), in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def with_encoded_cosine(pairs: DataFrame, load_encoder: Callable[[], object], s1: str = "sentence1", s2: str = "sentence2",
                        batch_size: int = BATCH_SIZE) -> DataFrame:
    """Adds ``cos``, the cosine of the two sentences' vectors; 0 where a vector is zero."""
    keyed = pairs.withColumn("_k1", sentence_key(F.col(s1))).withColumn("_k2", sentence_key(F.col(s2)))
    both = pairs.select(F.col(s1).alias("sentence")).unionByName(pairs.select(F.col(s2).alias("sentence")))
    vectors = encoded_once(both, load_encoder, batch_size)
    side = lambda k, v: vectors.select(F.col("key").alias(k), F.col("embedding").alias(v))
    cosines = (keyed.select("_k1", "_k2").distinct().join(side("_k1", "_v1"), "_k1").join(side("_k2", "_v2"), "_k2")
               .select("_k1", "_k2", unit_dot(F.col("_v1"), F.col("_v2")).alias("cos")))
    return keyed.drop("cos").join(cosines, ["_k1", "_k2"]).drop("_k1", "_k2")
