"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame, each over whole driver tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clashlens.config import DEFAULT
from clashlens.functions.scores import argmax_label, rounded
from clashlens.operators import reports
from clashlens.operators.sentences import sentence_vectors, term_rows
from clashlens.plans.document_check import check_documents
from clashlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _check(spark, sf_dir):
    return check_documents(read_table(spark, sf_dir, "documents"), DEFAULT)


@register("sentences")
def q_sentences(spark, sf_dir):
    return _check(spark, sf_dir).sentences


@register("encode_tf")
def q_encode_tf(spark, sf_dir):
    vec = sentence_vectors(_check(spark, sf_dir).sentences)
    return term_rows(vec).select("doc_id", "idx", "token", "tf")


@register("candidate_pairs")
def q_candidate_pairs(spark, sf_dir):
    return _check(spark, sf_dir).candidates.select("doc_id", "i", "j", "dot", "cos")


@register("candidate_texts")
def q_candidate_texts(spark, sf_dir):
    return _check(spark, sf_dir).candidate_texts()


@register("nli_scores")
def q_nli_scores(spark, sf_dir):
    s = _check(spark, sf_dir).scored
    return s.select("doc_id", "i", "j",
                    *[rounded(F.col(k), 4).alias(k) for k in ("entailment", "neutral", "contradiction")],
                    argmax_label(F.col("entailment"), F.col("neutral"), F.col("contradiction")).alias("label"))


@register("contradictions")
def q_contradictions(spark, sf_dir):
    c = _check(spark, sf_dir).contradictions()
    return c.withColumn("confidence", rounded(F.col("confidence"), 4))


@register("doc_pair_stats")
def q_doc_pair_stats(spark, sf_dir):
    return _check(spark, sf_dir).stats().select("doc_id", "total_sentences", "total_pairs", "filtered_pairs",
                                                "filter_reduction_pct")


@register("doc_consistency")
def q_doc_consistency(spark, sf_dir):
    return _check(spark, sf_dir).stats().select("doc_id", F.col("filtered_pairs").alias("checked_pairs"),
                                                "contradiction_count", "consistency_score")


@register("doc_report")
def q_doc_report(spark, sf_dir):
    return _check(spark, sf_dir).report(nested=False)


@register("doc_verdict")
def q_doc_verdict(spark, sf_dir):
    s = _check(spark, sf_dir).stats()
    return s.select("doc_id", F.col("contradiction_count").alias("n_contradictions"),
                    reports.doc_verdict_text(F.col("contradiction_count")).alias("verdict"))


@register("method_cost")
def q_method_cost(spark, sf_dir):
    return reports.method_cost(_check(spark, sf_dir).stats())


# ------------------------------------------------------------------------------------------------
# aligned sentence pairs: each sentence of a document with the next one
# ------------------------------------------------------------------------------------------------
from clashlens.config import LABEL_ORDER, MAX_SEQ_LEN  # noqa: E402
from clashlens.functions import text as tx  # noqa: E402
from clashlens.functions.scores import softmax3  # noqa: E402
from clashlens.operators.nli import _logit  # noqa: E402
from clashlens.operators.similarity import aligned_features, dense_candidates, lsh_candidates, with_l2_normalized  # noqa: E402
from clashlens.plans import pair_check  # noqa: E402
from clashlens.sources import documents as srcdocs  # noqa: E402

PAIR_KEYS = ("doc_id", "idx")


def doc_pairs(spark, sf_dir):
    return srcdocs.consecutive_sentence_pairs(_check(spark, sf_dir).arrays)


@register("doc_source_valid")
def q_doc_source_valid(spark, sf_dir):
    return srcdocs.document_source(read_table(spark, sf_dir, "documents"))


@register("pair_source_valid")
def q_pair_source_valid(spark, sf_dir):
    turns = srcdocs.consecutive_turn_pairs(read_table(spark, sf_dir, "conversations"))
    return srcdocs.pair_source(turns, keys=("conv_id", "turn"))


@register("assemble_docs")
def q_assemble_docs(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return srcdocs.assemble_documents(conv, "conv_id", "turn", "text")


@register("aligned_cosine")
def q_aligned_cosine(spark, sf_dir):
    return aligned_features(doc_pairs(spark, sf_dir)).select(*PAIR_KEYS, "cos")


@register("pair_report")
def q_pair_report(spark, sf_dir):
    return pair_check.pair_report(doc_pairs(spark, sf_dir), PAIR_KEYS)


@register("pair_argmax")
def q_pair_argmax(spark, sf_dir):
    a = pair_check.pair_argmax(doc_pairs(spark, sf_dir), PAIR_KEYS)
    return a.select(*PAIR_KEYS, "label", "confidence", *[F.col(f"all_scores.{k}").alias(k) for k in LABEL_ORDER])


@register("pair_verdict")
def q_pair_verdict(spark, sf_dir):
    return pair_check.pair_verdict(doc_pairs(spark, sf_dir), PAIR_KEYS)


@register("expected_score")
def q_expected_score(spark, sf_dir):
    return pair_check.pair_expected_score(doc_pairs(spark, sf_dir), PAIR_KEYS)


@register("softmax3")
def q_softmax3(spark, sf_dir):
    f = aligned_features(doc_pairs(spark, sf_dir))
    w = DEFAULT.scorer_weights
    z = [_logit(w[k], F.col("cos"), F.col("jac"), F.col("neg")) for k in LABEL_ORDER]
    f = f.select(*PAIR_KEYS, *[zz.alias(f"z_{k}") for zz, k in zip(z, LABEL_ORDER)])
    p = softmax3(*[F.col(f"z_{k}") for k in LABEL_ORDER])
    return f.select(*PAIR_KEYS, *[rounded(F.col(f"z_{k}"), 6).alias(f"z_{k}") for k in LABEL_ORDER],
                    *[rounded(pp, 4).alias(k) for pp, k in zip(p, LABEL_ORDER)])


@register("pair_truncate")
def q_pair_truncate(spark, sf_dir):
    budget = MAX_SEQ_LEN - 3   # three special tokens of a pair encoding
    p = (doc_pairs(spark, sf_dir).withColumn("_ta", tx.tokens(F.col("sentence1")))
         .withColumn("_tb", tx.tokens(F.col("sentence2"))))
    p = p.withColumn("len_a", F.size("_ta")).withColumn("len_b", F.size("_tb"))
    ka, kb = tx.truncate_pair(F.col("len_a"), F.col("len_b"), budget)
    p = p.withColumn("keep_a", ka).withColumn("keep_b", kb)
    return p.select(*PAIR_KEYS, "len_a", "len_b", "keep_a", "keep_b",
                    F.array_join(F.slice("_ta", F.lit(1), F.col("keep_a")), " ").alias("text_a"),
                    F.array_join(F.slice("_tb", F.lit(1), F.col("keep_b")), " ").alias("text_b"))


# ------------------------------------------------------------------------------------------------
# dense vectors (embeddings table)
# ------------------------------------------------------------------------------------------------

@register("l2_normalize")
def q_l2_normalize(spark, sf_dir):
    e = with_l2_normalized(read_table(spark, sf_dir, "embeddings"), "embedding")
    e = e.withColumn("unit_norm", F.sqrt(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x)))
    e = e.withColumn("unit_sum", F.aggregate("unit", F.lit(0.0), lambda a, x: a + x))
    return e.select("vec_id", "label", rounded(F.col("norm"), 6).alias("norm_in"),
                    rounded(F.col("unit_norm"), 6).alias("norm_out"),
                    rounded(F.col("unit_sum"), 6).alias("unit_sum"))


@register("candidate_pairs_dense")
def q_candidate_pairs_dense(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    c = dense_candidates(e, DEFAULT.similarity_threshold, group="label", ident="vec_id", vector="embedding",
                         block_rows=DEFAULT.dense_block_rows)
    return c.select("label", "i", "j", rounded(F.col("cos"), 6).alias("cos"))


@register("candidate_pairs_dense_all")
def q_candidate_pairs_dense_all(spark, sf_dir):
    """All embeddings as one group, in tiles of the production size."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(0).alias("whole"))
    c = dense_candidates(e, DEFAULT.similarity_threshold, group="whole", ident="vec_id", vector="embedding",
                         block_rows=DEFAULT.dense_block_rows)
    return c.select("i", "j", rounded(F.col("cos"), 6).alias("cos"))


@register("candidate_pairs_lsh")
def q_candidate_pairs_lsh(spark, sf_dir):
    """The approximate plan over the same groups; no twin, as it may miss pairs (recall is tested)."""
    e = read_table(spark, sf_dir, "embeddings")
    c = lsh_candidates(e, DEFAULT.similarity_threshold, group="label", ident="vec_id", vector="embedding")
    return c.select("label", "i", "j", rounded(F.col("cos"), 6).alias("cos"))


# ------------------------------------------------------------------------------------------------
# evaluation on graded pairs (consecutive sentences of labelled documents)
# ------------------------------------------------------------------------------------------------
from clashlens.plans import evaluation as ev  # noqa: E402


def _graded(spark, sf_dir):
    return ev.graded_pairs_from_tables(spark, sf_dir)


@register("graded_pairs")
def q_graded_pairs(spark, sf_dir):
    return _graded(spark, sf_dir).select("split", "doc_id", "idx", "sentence1", "sentence2", "score", "label")


@register("score_label")
def q_score_label(spark, sf_dir):
    g = _graded(spark, sf_dir)
    return g.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_pairs"),
                                           rounded(F.min("score05"), 4).alias("min_score"),
                                           rounded(F.max("score05"), 4).alias("max_score"))


@register("gated_scores")
def q_gated_scores(spark, sf_dir):
    w = ev.wide_predictions(_graded(spark, sf_dir))
    return w.select("split", "doc_id", "idx", rounded(F.col("cos"), 6).alias("cos"),
                    (F.col("cos") >= F.lit(DEFAULT.similarity_threshold)).alias("passed_filter"),
                    rounded(F.col("pred_two_stage"), 6).alias("pred"), F.col("bin_two_stage").alias("pred_bin"),
                    rounded(F.col("entail_conf"), 6).alias("entail_conf"),
                    rounded(F.col("contra_conf"), 6).alias("contra_conf"))


def _predictions(spark, sf_dir):
    return ev.method_predictions(_graded(spark, sf_dir))


@register("method_comparison")
def q_method_comparison(spark, sf_dir):
    return ev.method_comparison(_graded(spark, sf_dir))


@register("pearson")
def q_pearson(spark, sf_dir):
    return ev.pearson(_predictions(spark, sf_dir)).select("split", "method", "pearson")


@register("spearman")
def q_spearman(spark, sf_dir):
    return ev.spearman(_predictions(spark, sf_dir))


@register("f1_binary")
def q_f1_binary(spark, sf_dir):
    return ev.f1_binary(_predictions(spark, sf_dir))


@register("threshold_sweep")
def q_threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(_graded(spark, sf_dir))


@register("example_pairs")
def q_example_pairs(spark, sf_dir):
    return ev.example_pairs(ev.wide_predictions(_graded(spark, sf_dir)))


@register("doc_threshold_sweep")
def q_doc_threshold_sweep(spark, sf_dir):
    """Per sweep threshold over all documents: surviving pairs, contradictions, reduction %.

    Candidates are formed once at the lowest threshold and counted once a link, by the number of thresholds that their
    cosine reaches; documents add their possible pairs. Only the counts meet the thresholds.
    """
    ts = sorted(DEFAULT.sweep_thresholds)
    c = check_documents(read_table(spark, sf_dir, "documents"), DEFAULT, similarity_threshold=ts[0])
    z = F.lit(0).cast("long")
    hit = F.col("contradiction") >= F.lit(DEFAULT.contradiction_threshold)
    cand = c.links.select(ev.reached(F.col("cos"), ts).alias("k"), F.col("n").alias("s"), F.when(hit, F.col("n")).otherwise(z).alias("c"), z.alias("t"))
    docs = c.arrays.select(F.lit(0).alias("k"), z.alias("s"), z.alias("c"), reports.total_pairs(F.col("total_sentences")).alias("t"))
    counts = cand.unionByName(docs).groupBy("k").agg(*(F.sum(x).cast("long").alias(x) for x in "sct"))
    m = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("m")) for i, t in enumerate(ts)]))
    above = lambda x: F.sum(F.when(F.col("k") > F.col("p.m"), F.col(x)).otherwise(z)).cast("long")
    a = counts.withColumn("p", m).groupBy(F.col("p.threshold").alias("threshold")).agg(
        above("s").alias("survivors"), above("c").alias("contradictions"), F.sum("t").cast("long").alias("total_pairs"))
    return a.withColumn("reduction_pct", reports.reduction_pct(F.col("survivors"), F.col("total_pairs")))


# ------------------------------------------------------------------------------------------------
# training-set preparation (NLI-shaped rows from documents and conversations)
# ------------------------------------------------------------------------------------------------
from clashlens.config import NLI_HEAD_LIMIT, NUM_PARAPHRASES, SNLI_LIMIT  # noqa: E402
from clashlens.plans import training as tr  # noqa: E402


@register("seeded_sample")
def q_seeded_sample(spark, sf_dir):
    rows = tr.valid_labels(tr.nli_rows_from_tables(spark, sf_dir)).where(F.col("source_ord") == 0)
    return tr.seeded_sample(rows, {0: SNLI_LIMIT}).select("source", "key", "sample_ord", "label")


@register("nli_training_set")
def q_nli_training_set(spark, sf_dir):
    return tr.load_nli(spark, sf_dir).select("source", "source_ord", "sample_ord", "key", "premise", "hypothesis", "label")


@register("head_limit")
def q_head_limit(spark, sf_dir):
    return tr.head_by_rank(tr.load_nli(spark, sf_dir), NLI_HEAD_LIMIT).select("row_ord", "source", "key", "label")





def _valid(spark, sf_dir):
    """All valid NLI-shaped rows; the samples' limits hold in the training queries only."""
    return tr.valid_labels(tr.nli_rows_from_tables(spark, sf_dir))


@register("distinct_first")
def q_distinct_first(spark, sf_dir):
    return tr.distinct_first(_valid(spark, sf_dir))


def _premises(spark, sf_dir):
    return _valid(spark, sf_dir).select(F.col("premise").alias("sentence")).distinct()


@register("paraphrase_topn")
def q_paraphrase_topn(spark, sf_dir):
    return tr.builtin_paraphrases(_premises(spark, sf_dir), NUM_PARAPHRASES)


@register("paraphrase_lookup")
def q_paraphrase_lookup(spark, sf_dir):
    nli = _valid(spark, sf_dir)
    cache = tr.builtin_paraphrases(nli.where(F.col("source_ord") == 0).select(F.col("premise").alias("sentence"))
                                   .distinct(), NUM_PARAPHRASES)
    req = nli.select(F.col("premise").alias("sentence"))
    return tr.paraphrase_lookup(req, cache, NUM_PARAPHRASES)


@register("augment_pairs")
def q_augment_pairs(spark, sf_dir):
    firsts = tr.distinct_first(_valid(spark, sf_dir))
    return tr.augment(firsts.withColumnRenamed("premise", "sentence"), NUM_PARAPHRASES).select(
        "first_ord", "sentence", "rank", "paraphrase")


@register("training_set")
def q_training_set(spark, sf_dir):
    return tr.training_set(tr.load_nli(spark, sf_dir))


@register("training_shards")
def q_training_shards(spark, sf_dir):
    return tr.training_shards(tr.training_set(tr.load_nli(spark, sf_dir))).select("part", "ord", "shuffle_ord", "shard")


@register("train_pair_classifier")
def q_train_pair_classifier(spark, sf_dir):
    """Every row of the training set with the class that the fitted classifier gives it."""
    train = tr.rule_labels(tr.training_set(tr.load_nli(spark, sf_dir)))
    feats = tr.pair_features(train).select("part", "ord", "label", *tr.FEATURES).checkpoint()   # the training limits bound it
    scored = tr.fit_features(feats, max_iter=15).transform(feats)
    return scored.select("part", "ord", "label", F.col("prediction").cast("int").alias("prediction"))
