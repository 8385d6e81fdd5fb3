"""N-8 and friends: checking aligned sentence pairs (one row per pair, no pair join).

With a model scorer (mapInPandas) the cheap similarity gate runs before it as a separate DataFrame
branch: survivors are scored, the rest get NULL scores and a reason, and the branches are unioned, so
the model only sees survivors (Catalyst would not move a Python scorer behind a filter). The built-in
scorer is plain column arithmetic and is applied in one pass with the scores nulled where filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.config import DEFAULT, FILTERED_REASON, LABEL_ORDER, Settings
from clashlens.functions.scores import (argmax_label, expected_score, rounded, verdict,
                                        verdict_confidence)
from clashlens.operators.aligned import with_encoded_cosine
from clashlens.operators.nli import lexical_scorer, model_scored
from clashlens.operators.similarity import aligned_features


def pair_features(pairs: DataFrame, settings: Settings = DEFAULT, scorer=None, encoder=None) -> DataFrame:
    """Pairs with ``cos``, and the built-in scorer's other features where that one is used.

    ``encoder``: a loader of a sentence encoder (hook U-1); every distinct sentence is encoded once. Without
    one the cosine is that of the built-in term vectors.
    """
    if encoder is None:
        return aligned_features(pairs)
    feats = pairs if scorer else aligned_features(pairs).drop("cos")
    return with_encoded_cosine(feats, encoder, batch_size=settings.batch_size)


def _scored(feats: DataFrame, settings: Settings, scorer) -> DataFrame:
    return model_scored(feats, scorer, settings) if scorer else lexical_scorer(feats, settings.scorer_weights)


def scored_pairs(pairs: DataFrame, settings: Settings = DEFAULT, scorer=None) -> DataFrame:
    """Every pair scored, no gate and no similarity where a model scores (the verifier-only path, N-1)."""
    return model_scored(pairs, scorer, settings) if scorer else lexical_scorer(aligned_features(pairs), settings.scorer_weights)


def gated_pairs(pairs: DataFrame, settings: Settings = DEFAULT, scorer=None, threshold: float | None = None, encoder=None) -> DataFrame:
    """P-6: pairs with cos >= threshold are scored; the others keep NULL scores. Adds passed_filter."""
    t = settings.similarity_threshold if threshold is None else threshold
    feats = pair_features(pairs, settings, scorer, encoder)
    if scorer is None:
        # The built-in scorer is a few JVM arithmetic expressions: one pass, scores nulled for the
        # filtered rows, is cheaper than two branches that each recompute the features.
        s = lexical_scorer(feats, settings.scorer_weights)
        passed = F.col("cos") >= F.lit(t)
        for k in LABEL_ORDER:
            s = s.withColumn(k, F.when(passed, F.col(k)))
        return s.withColumn("passed_filter", passed)
    survivors = _scored(feats.where(F.col("cos") >= F.lit(t)), settings, scorer)
    rest = feats.where(~(F.col("cos") >= F.lit(t)))
    for k in LABEL_ORDER:
        rest = rest.withColumn(k, F.lit(None).cast("double"))
    return (survivors.withColumn("passed_filter", F.lit(True))
            .unionByName(rest.withColumn("passed_filter", F.lit(False))))


def pair_report(pairs: DataFrame, keys, settings: Settings = DEFAULT, scorer=None, encoder=None) -> DataFrame:
    """S-7 / N-8 record: similarity, threshold, passed_filter, scores, verdict, confidence, filtered_reason."""
    g = gated_pairs(pairs, settings, scorer, encoder=encoder)
    e, n, c = F.col("entailment"), F.col("neutral"), F.col("contradiction")
    ct = settings.contradiction_threshold
    passed = F.col("passed_filter")
    return g.select(
        *keys,
        rounded(F.col("cos"), 4).alias("similarity"),
        F.lit(settings.similarity_threshold).alias("threshold"),
        passed.alias("passed_filter"),
        *[rounded(F.col(k), 4).alias(k) for k in LABEL_ORDER],
        F.when(passed, verdict(c, ct)).otherwise(F.lit("CONSISTENT")).alias("verdict"),
        F.when(passed, rounded(verdict_confidence(e, n, c, ct), 4)).alias("confidence"),
        F.when(~passed, F.lit(FILTERED_REASON)).alias("filtered_reason"))


def pair_argmax(pairs: DataFrame, keys, settings: Settings = DEFAULT, scorer=None) -> DataFrame:
    """N-5: label of the largest probability, its probability, and all three scores."""
    s = scored_pairs(pairs, settings, scorer)
    e, n, c = F.col("entailment"), F.col("neutral"), F.col("contradiction")
    return s.select(*keys, argmax_label(e, n, c).alias("label"),
                    rounded(F.greatest(e, n, c), 4).alias("confidence"),
                    F.struct(*[rounded(F.col(k), 4).alias(k) for k in LABEL_ORDER]).alias("all_scores"))


def pair_verdict(pairs: DataFrame, keys, settings: Settings = DEFAULT, scorer=None) -> DataFrame:
    """N-6/N-7: threshold verdict and its confidence for every pair (no gate)."""
    s = scored_pairs(pairs, settings, scorer)
    e, n, c = F.col("entailment"), F.col("neutral"), F.col("contradiction")
    ct = settings.contradiction_threshold
    return s.select(*keys, verdict(c, ct).alias("verdict"),
                    rounded(verdict_confidence(e, n, c, ct), 4).alias("confidence"))


def pair_expected_score(pairs: DataFrame, keys, settings: Settings = DEFAULT, scorer=None) -> DataFrame:
    """N-9: 5 P(entailment) + 2.5 P(neutral) + 0 P(contradiction)."""
    s = scored_pairs(pairs, settings, scorer)
    return s.select(*keys, rounded(expected_score(F.col("entailment"), F.col("neutral"),
                                                        F.col("contradiction")), 4).alias("expected_score"))
