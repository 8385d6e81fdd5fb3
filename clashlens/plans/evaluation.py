"""Evaluation of the three methods on graded pairs (S-1, L-1, L-2, M-1..M-10).

All methods are columns of one wide row per pair (cosine computed once, the scorer run once), melted
to a long table ``(split, method, pred, pred_bin, gold, gold_bin)`` and aggregated by
``(split, method)``. Pearson is covar_pop / sqrt(var_pop * var_pop), NULL for constant input (Spark's
``corr`` raises under ANSI there); Spearman is Pearson on average ranks of the distinct values;
F1 is 2tp / (2tp + fp + fn), 0 when undefined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.config import DEFAULT, Settings
from clashlens.functions.scores import expected_score, rounded, score_label, to_05_scale
from clashlens.operators.nli import lexical_scorer, model_scored
from clashlens.operators.ranking import value_ranks
from clashlens.operators.reports import reduction_pct
from clashlens.operators.sentences import sentence_arrays
from clashlens.plans.pair_check import pair_features
from clashlens.session import ensure_checkpoint_dir
from clashlens.sources.documents import consecutive_sentence_pairs
from clashlens.sources.tables import read_table

# Split of a labelled document by doc_id mod 10 (0-6 train, 7 validation, 8-9 test).
SPLIT_TRAIN_BELOW = 7
SPLIT_VALIDATION = 7


def graded_pairs(pairs: DataFrame, score: str = "score", score_scale: str = "0-5") -> DataFrame:
    """S-1 + L-1: adds ``score05`` (0-5 scale) and ``label`` (consistent / neutral / contradiction)."""
    s05 = to_05_scale(F.col(score).cast("double"), score_scale)
    return pairs.withColumn("score05", s05).withColumn("label", score_label(F.col("score05")))


def graded_pairs_from_tables(spark, sf_dir: str) -> DataFrame:
    """Graded pairs derived from the driver tables: consecutive sentences of every labelled document.

    Gold (0-5) = 2.5 * (1 + quality - toxic): 5.0 for good, 2.5 for mixed, 0.0 for bad documents,
    so all three classes occur. Split by doc_id mod 10.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    pairs = consecutive_sentence_pairs(sentence_arrays(docs))
    m = F.pmod(F.col("doc_id"), F.lit(10))
    split = (F.when(m < SPLIT_TRAIN_BELOW, F.lit("train")).when(m == SPLIT_VALIDATION, F.lit("validation"))
             .otherwise(F.lit("test")))
    g = (pairs.join(labels, "doc_id")
         .select(split.alias("split"), "doc_id", "idx", "sentence1", "sentence2",
                 (F.lit(2.5) * (F.lit(1) + F.col("quality") - F.col("toxic"))).cast("double").alias("score")))
    return graded_pairs(g)


def scored_features(graded: DataFrame, settings: Settings = DEFAULT, scorer=None, encoder=None) -> DataFrame:
    """Graded pairs with ``cos`` and the three probabilities, every pair scored once (the verifier-only method needs all).

    ``encoder`` and ``scorer`` are the hooks of the pair check: each distinct sentence is encoded once, and a model
    gets sentences cut to the sequence limit.
    """
    feats = pair_features(graded, settings, scorer, encoder)
    return model_scored(feats, scorer, settings) if scorer else lexical_scorer(feats, settings.scorer_weights)


def wide_predictions(graded: DataFrame, settings: Settings = DEFAULT, scorer=None, threshold: float | None = None, encoder=None) -> DataFrame:
    """One row per pair: cos, scores, gold, and every method's prediction and confidences (M-1..M-3)."""
    t = settings.similarity_threshold if threshold is None else threshold
    ct = settings.contradiction_threshold
    w = scored_features(graded, settings, scorer, encoder)
    e, n, c, cos = F.col("entailment"), F.col("neutral"), F.col("contradiction"), F.col("cos")
    five = F.lit(5.0) * cos
    passed = cos >= F.lit(t)
    ce_score = expected_score(e, n, c)
    ce_bin = (c >= F.lit(ct)).cast("int")
    low_bin = (five <= F.lit(2.0)).cast("int")
    return w.select(
        "*",
        F.when(F.col("label") == "contradiction", 1).otherwise(0).alias("gold_bin"),
        five.alias("pred_embedding"), (five < F.lit(2.0)).cast("int").alias("bin_embedding"),
        ce_score.alias("pred_verifier"), ce_bin.alias("bin_verifier"),
        F.when(passed, ce_score).otherwise(five).alias("pred_two_stage"),
        F.when(passed, ce_bin).otherwise(low_bin).alias("bin_two_stage"),
        F.when(passed, e).otherwise(F.lit(0.0)).alias("entail_conf"),
        F.when(passed, c).otherwise(F.when(low_bin == 1, F.lit(1.0)).otherwise(F.lit(0.0))).alias("contra_conf"))


METHODS = ("embedding", "verifier", "two_stage")


def long_predictions(wide: DataFrame, keys=("split", "doc_id", "idx")) -> DataFrame:
    """(keys, method, pred, pred_bin, gold, gold_bin): the wide row melted, no join."""
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"pred_{m}").alias("pred"),
                              F.col(f"bin_{m}").alias("pred_bin")) for m in METHODS])
    return (wide.select(*keys, F.col("score05").alias("gold"), "gold_bin", F.inline_outer(rows))
            .where(F.col("method").isNotNull()))


def _pearson(cov, vx, vy):
    den = vx * vy
    return F.when(den > 0, cov / F.sqrt(den))


def _f1(tp, fp, fn):
    den = tp * 2 + fp + fn
    return F.when(den > 0, (tp * 2).cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def pearson(long: DataFrame, groups=("split", "method")) -> DataFrame:
    """M-4: (groups, n_pairs, pearson), one aggregation."""
    return (long.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_pairs"), F.covar_pop("pred", "gold").alias("_cov"),
                                      F.var_pop("pred").alias("_vp"), F.var_pop("gold").alias("_vg"))
            .select(*groups, "n_pairs", rounded(_pearson(F.col("_cov"), F.col("_vp"), F.col("_vg")), 6).alias("pearson")))


def f1_binary(long: DataFrame, groups=("split", "method")) -> DataFrame:
    """M-6: (groups, f1), one aggregation."""
    hit = lambda p, g: F.count_if((F.col("pred_bin") == p) & (F.col("gold_bin") == g))
    return (long.groupBy(*groups).agg(hit(1, 1).alias("_tp"), hit(1, 0).alias("_fp"), hit(0, 1).alias("_fn"))
            .select(*groups, rounded(_f1(F.col("_tp"), F.col("_fp"), F.col("_fn")), 6).alias("f1")))


def spearman(long: DataFrame, groups=("split", "method"), num_partitions: int | None = None) -> DataFrame:
    """M-5: (groups, spearman) from the distinct (pred, gold) pairs and their counts, written once.

    Ranks are of distinct values. The ranks of pred meet the pairs on keys without repeats there; what is
    left is summed by gold before the ranks of gold join, so no row count decides the size of a join key.
    """
    g = list(groups)
    ensure_checkpoint_dir(long.sparkSession)
    pairs = long.groupBy(*g, "pred", "gold").agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)
    of = lambda v: value_ranks(pairs.groupBy(*g, v).agg(F.sum("_c").alias("_c")), g, v, f"_r{v}", num_partitions)
    c, p, q = F.col("_c"), F.col("_rpred"), F.col("_rgold")
    by_gold = (pairs.join(of("pred"), [*g, "pred"]).groupBy(*g, "gold")
               .agg(F.sum(c).alias("_c"), F.sum(c * p).alias("_p"), F.sum(c * p * p).alias("_pp")))
    sums = by_gold.join(of("gold"), [*g, "gold"]).groupBy(*g).agg(
        F.sum(c).cast("double").alias("n"), F.sum("_p").alias("p"), F.sum("_pp").alias("pp"), F.sum(c * q).alias("q"),
        F.sum(c * q * q).alias("qq"), F.sum(F.col("_p") * q).alias("pq"))
    mean = lambda x: F.col(x) / F.col("n")
    return sums.select(*g, rounded(_pearson(mean("pq") - mean("p") * mean("q"), mean("pp") - mean("p") * mean("p"),
                                            mean("qq") - mean("q") * mean("q")), 6).alias("spearman"))


def metrics(long: DataFrame, groups=("split", "method"), num_partitions: int | None = None) -> DataFrame:
    """M-4..M-7: (groups, n_pairs, pearson, spearman, f1), metrics rounded to 6 decimals."""
    g = list(groups)
    return (pearson(long, g).join(spearman(long, g, num_partitions), g).join(f1_binary(long, g), g)
            .select(*g, "n_pairs", "pearson", "spearman", "f1"))


def method_predictions(graded: DataFrame, settings: Settings = DEFAULT, scorer=None, encoder=None) -> DataFrame:
    return long_predictions(wide_predictions(graded, settings, scorer, encoder=encoder))


def method_comparison(graded: DataFrame, settings: Settings = DEFAULT, scorer=None, encoder=None) -> DataFrame:
    """M-8: one row per (split, method).

    The long table feeds three aggregations; it is checkpointed once to the shared checkpoint folder so
    the features and the scorer run once and the lineage is cut.
    """
    ensure_checkpoint_dir(graded.sparkSession)
    long = method_predictions(graded, settings, scorer, encoder).select("split", "method", "pred", "pred_bin", "gold", "gold_bin").checkpoint(eager=True)
    return metrics(long, num_partitions=settings.rank_partitions or None)


def reached(cos, thresholds: list[float]):
    """How many of the ascending thresholds a cosine reaches; binary search in the row."""
    def half(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(cos >= F.lit(float(thresholds[mid])), half(mid + 1, hi)).otherwise(half(lo, mid))
    return half(0, len(thresholds))


def threshold_sweep(graded: DataFrame, settings: Settings = DEFAULT, scorer=None, thresholds=None, encoder=None) -> DataFrame:
    """M-10: per (split, threshold): pairs, survivors, reduction %, F1 of the two-stage method.

    The whole curve from one pass, however many thresholds: a pair is counted once, by the number of thresholds that
    its cosine reaches, and a threshold's figures are sums over those counts (those above it as verified, the others
    by their low cosine). Nothing is replicated per threshold but the counts.
    """
    ts = sorted(set(thresholds or settings.sweep_thresholds))
    w = scored_features(graded, settings, scorer, encoder)
    gold = F.col("label") == "contradiction"
    verified = F.col("contradiction") >= F.lit(settings.contradiction_threshold)
    low = F.lit(5.0) * F.col("cos") <= F.lit(2.0)
    hit = lambda said, truth: F.count_if(said & truth)
    by_reach = w.withColumn("_k", reached(F.col("cos"), ts)).groupBy("split", "_k").agg(
        F.count(F.lit(1)).alias("_n"),
        *[hit(p, g).alias(f"_{name}{x}") for x, p in (("v", verified), ("l", low)) for name, g in (("tp", gold), ("fp", ~gold))],
        *[hit(~p, gold).alias(f"_fn{x}") for x, p in (("v", verified), ("l", low))])
    # from here on a row for each split and reach: the curve's points are running sums from either end
    m = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("m")) for i, t in enumerate(ts)]))
    c = by_reach.withColumn("_t", m).withColumn("_pass", F.col("_k") > F.col("_t.m"))
    total = lambda name: F.sum(F.when(F.col("_pass"), F.col(f"_{name}v")).otherwise(F.col(f"_{name}l")))
    a = c.groupBy("split", F.col("_t.threshold").alias("threshold")).agg(
        F.sum("_n").alias("n_pairs"), F.sum(F.when(F.col("_pass"), F.col("_n")).otherwise(F.lit(0))).cast("long").alias("survivors"),
        *(total(x).alias(f"_{x}") for x in ("tp", "fp", "fn")))
    return a.select("split", "threshold", "n_pairs", "survivors",
                    reduction_pct(F.col("survivors"), F.col("n_pairs")).alias("reduction_pct"),
                    rounded(_f1(F.col("_tp"), F.col("_fp"), F.col("_fn")), 6).alias("f1"))


def example_pairs(wide: DataFrame, k: int = 5, split: str = "test") -> DataFrame:
    """M-9: of the test split, the first k correct contradictions (gold < 1.5, P(c) > 0.7) and consistencies
    (gold > 4.0, P(e) > 0.8) in pair order. A top-k per kind (each partition keeps k rows)."""
    kinds = [("contradiction", (F.col("score05") < 1.5) & (F.col("contra_conf") > 0.7), "contra_conf"),
             ("consistent", (F.col("score05") > 4.0) & (F.col("entail_conf") > 0.8), "entail_conf")]
    out = None
    for name, cond, conf in kinds:
        top = (wide.where((F.col("split") == split) & cond).orderBy("split", "doc_id", "idx").limit(k)
               .select(F.lit(name).alias("kind"), "split", "doc_id", "idx", "sentence1", "sentence2",
                       rounded(F.col("score05"), 2).alias("human_score"),
                       rounded(F.col(conf), 4).alias("confidence")))
        out = top if out is None else out.unionByName(top)
    return out
