"""Document and pair sources (S-3, S-4, S-5) and the aligned-pair derivations of the driver tables.

Validation never drops silently: every input row comes out once, with ``error`` NULL when valid
and the reference's message otherwise; ``valid_only`` keeps the good rows for the next step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.config import MISSING_PAIR_REASON, MISSING_TEXT_REASON
from clashlens.functions.text import strip


def document_source(docs: DataFrame, key: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """S-3: (key, text stripped, further columns to ``keep``, error). Missing or blank text is an error, as the document API does."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    return (docs.select(F.col(key), t.alias("text"), *keep)
            .withColumn("error", F.when(F.col("text") == "", F.lit(MISSING_TEXT_REASON))))


def pair_source(pairs: DataFrame, keys=("pair_id",), s1: str = "sentence1", s2: str = "sentence2") -> DataFrame:
    """S-4: (keys, sentence1, sentence2 stripped, error). Both sides are required."""
    a = strip(F.coalesce(F.col(s1), F.lit("")))
    b = strip(F.coalesce(F.col(s2), F.lit("")))
    return (pairs.select(*keys, a.alias("sentence1"), b.alias("sentence2"))
            .withColumn("error", F.when((F.col("sentence1") == "") | (F.col("sentence2") == ""),
                                        F.lit(MISSING_PAIR_REASON))))


def valid_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull()).drop("error")


def assemble_documents(lines: DataFrame, key: str, order: str, line: str, out_key: str = "doc_id") -> DataFrame:
    """S-5: one document per key from its lines in ``order``, joined by one blank, then stripped.

    A key whose lines are all NULL is an empty document. Partial aggregation collects (order, line) pairs; the sort happens once per document.
    """
    row = F.when(F.col(line).isNotNull(), F.struct(F.col(order).alias("o"), F.col(line).alias("l")))
    parts = F.array_sort(F.collect_list(row))
    return (lines.groupBy(F.col(key).alias(out_key)).agg(parts.alias("_p"))
            .select(out_key, strip(F.array_join(F.col("_p.l"), " ")).alias("text")))


def consecutive_sentence_pairs(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, idx, sentence1, sentence2): each sentence with the next one of the same document.

    Built inside the document row from its sentence array, so no join or window is needed.
    """
    n = F.col("total_sentences")
    pos = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    pairs = F.when(n >= 2, F.transform(pos, lambda k: F.struct(
        k.alias("idx"), F.get(F.col("sents"), k).alias("sentence1"),
        F.get(F.col("sents"), k + 1).alias("sentence2"))))
    return (arrays.select(key, F.explode_outer(pairs).alias("p")).where(F.col("p").isNotNull())
            .select(key, "p.idx", "p.sentence1", "p.sentence2"))


def consecutive_turn_pairs(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, sentence1, sentence2): each turn's text with the next turn's text.

    Equi-join on (conv_id, turn + 1): keys are unique, so a long conversation spreads over tasks.
    """
    a = conv.select("conv_id", "turn", F.col("text").alias("sentence1"))
    b = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    return a.join(b, ["conv_id", "turn"])
