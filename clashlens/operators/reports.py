"""Per-document aggregates and reports (D-1..D-9, P-3).

Counts come from one partial-then-final aggregation of the candidate table keyed by ``doc_id``;
the pair total is the closed form n(n-1)/2 of the sentence count, never a count of a join. Every
document keeps its row (left join from the documents), so 0- and 1-sentence documents report
total_pairs 0, reduction 100 % and consistency 1.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.config import CONTRADICTION_THRESHOLD
from clashlens.functions.scores import rounded
from clashlens.functions.text import split_sentences
from clashlens.session import ensure_checkpoint_dir

# Document verdict texts.
VERDICT_CONSISTENT = "Fully Consistent"
VERDICT_WORD = " Contradiction"
VERDICT_PLURAL = "s"


def total_pairs(n):
    return (n.cast("long") * (n.cast("long") - 1) / 2).cast("long")


def reduction_pct(filtered, total):
    return rounded((F.lit(1.0) - filtered.cast("double") / F.greatest(total, F.lit(1)).cast("double")) * 100.0, 2)


def consistency(k, checked):
    return rounded(F.lit(1.0) - k.cast("double") / F.greatest(checked, F.lit(1)).cast("double"), 4)


def candidate_counts(scored: DataFrame, threshold: float = CONTRADICTION_THRESHOLD, key: str = "doc_id", n: str | None = None) -> DataFrame:
    """(key, filtered_pairs, contradiction_count) from scored candidates, or from links of ``n`` pairs each, one aggregation."""
    each = F.lit(1).cast("long") if n is None else F.col(n)
    hit = F.col("contradiction") >= F.lit(threshold)
    return scored.groupBy(key).agg(F.sum(each).alias("filtered_pairs"),
                                   F.sum(F.when(hit, each).otherwise(F.lit(0).cast("long"))).alias("contradiction_count"))


def doc_stats(counts_of_sentences: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """D-2..D-6: (key, total_sentences, total_pairs, filtered_pairs, filter_reduction_pct,
    contradiction_count, consistency_score) for every document."""
    z = F.lit(0).cast("long")
    return (counts_of_sentences.select(key, "total_sentences").join(counts, key, "left")
            .select(key, F.col("total_sentences"),
                    total_pairs(F.col("total_sentences")).alias("total_pairs"),
                    F.coalesce("filtered_pairs", z).alias("filtered_pairs"),
                    F.coalesce("contradiction_count", z).alias("contradiction_count"))
            .withColumn("filter_reduction_pct", reduction_pct(F.col("filtered_pairs"), F.col("total_pairs")))
            .withColumn("consistency_score", consistency(F.col("contradiction_count"), F.col("filtered_pairs"))))


PAIR_BLOCK = 64     # first sentences of the pairs that are packed into one row


def with_texts(pairs: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """P-3: attach sentence1/sentence2 to (key, i, j, ...) rows.

    Pairs are packed by document and blocks of their first sentence, the packs meet the raw documents, and
    only documents with a pair are split, once a pack. A pack holds PAIR_BLOCK sentences' pairs at most.
    Documents that come with their sentence arrays (``sents``) aren't split again.
    """
    ready = "sents" in docs.columns
    rest = [c for c in pairs.columns if c != key]
    packs = (pairs.groupBy(key, F.floor(F.col("i") / PAIR_BLOCK).alias("_block"))
             .agg(F.collect_list(F.struct(*rest)).alias("_pairs")))
    split = packs.join(docs.select(key, F.col("sents" if ready else text).alias("_text")), key)
    split = split.withColumn("sents", F.col("_text") if ready else split_sentences(F.col("_text")))
    return (split.select(key, "sents", F.explode_outer("_pairs").alias("_p")).select(key, "_p.*",
            F.get("sents", F.col("_p.i")).alias("sentence1"), F.get("sents", F.col("_p.j")).alias("sentence2")))


def contradictions(scored: DataFrame, docs: DataFrame, threshold: float = CONTRADICTION_THRESHOLD,
                   key: str = "doc_id") -> DataFrame:
    """D-1 flat: (key, i, j, sentence1, sentence2, confidence) for P(contradiction) >= threshold.

    The hits are narrow and are written first (to the shared checkpoint folder). Documents with one are told by
    their keys before any text moves: their keys are broadcast if they are counted few, else they are joined.
    """
    ensure_checkpoint_dir(scored.sparkSession)
    hits = (scored.where(F.col("contradiction") >= F.lit(threshold))
            .select(key, "i", "j", F.col("contradiction").alias("confidence")).checkpoint(eager=True))
    some = docs.join(broadcast_if_few(hits.select(key).distinct()), key, "left_semi")
    return with_texts(hits, some, key).select(key, "i", "j", "sentence1", "sentence2", "confidence")


def broadcast_if_few(keys: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A narrow table marked for broadcast if it is counted at most ``rows``, else as it is."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def nested_report(stats: DataFrame, flat_contradictions: DataFrame, key: str = "doc_id") -> DataFrame:
    """S-8 shape: stats plus ``contradictions ARRAY<STRUCT<i, j, sentence1, sentence2, confidence>>`` in (i, j) order.

    Only contradictions are collected (never candidates); documents without one get an empty array.
    """
    lists = flat_contradictions.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("i", "j", "sentence1", "sentence2", "confidence"))).alias("contradictions"))
    empty = F.array().cast("array<struct<i:int,j:int,sentence1:string,sentence2:string,confidence:double>>")
    return (stats.join(lists, key, "left")
            .withColumn("contradictions", F.coalesce(F.col("contradictions"), empty)))


def doc_verdict_text(k):
    return (F.when(k == 0, F.lit(VERDICT_CONSISTENT))
            .otherwise(F.concat(k.cast("string"), F.lit(VERDICT_WORD),
                                F.when(k > 1, F.lit(VERDICT_PLURAL)).otherwise(F.lit("")))))


def method_cost(stats: DataFrame) -> DataFrame:
    """D-9: sentences encoded, similarities computed and pairs sent to the verifier, per method.

    One aggregation over the per-document stats, unpivoted to three rows.
    """
    agg = stats.agg(F.count(F.lit(1)).alias("documents"),
                    F.sum("total_sentences").cast("long").alias("n"),
                    F.sum("total_pairs").cast("long").alias("t"),
                    F.sum("filtered_pairs").cast("long").alias("f"))
    z = F.lit(0).cast("long")
    rows = F.array(
        F.struct(F.lit("embedding_only").alias("method"), F.col("n").alias("sentences_encoded"),
                 F.col("t").alias("similarities"), z.alias("verifier_pairs")),
        F.struct(F.lit("verifier_only").alias("method"), z.alias("sentences_encoded"),
                 z.alias("similarities"), F.col("t").alias("verifier_pairs")),
        F.struct(F.lit("two_stage").alias("method"), F.col("n").alias("sentences_encoded"),
                 F.col("t").alias("similarities"), F.col("f").alias("verifier_pairs")))
    return (agg.select("documents", "t", F.inline(rows))
            .withColumn("verifier_reduction_pct", reduction_pct(F.col("verifier_pairs"), F.col("t")))
            .select("method", "documents", "sentences_encoded", "similarities", "verifier_pairs",
                    "verifier_reduction_pct"))
