"""The tiled plans against brute force, and the plans' shapes."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clashlens.functions import text as tx
from clashlens.operators.sentences import sentence_arrays, sentence_vectors
from clashlens.operators.similarity import aligned_features, lsh_candidates, sentence_candidates, token_candidates
from clashlens.plans.document_check import check_documents

WORDS = "alpha beta gamma not été ÜBER eps İstanbul Σας ﬁn x1 𝐀b".split()


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lsh_in_tiles_finds_the_pairs_that_agree_on_a_band(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 8)).astype(np.float32)
    x[7] = 0.0
    labels = rng.integers(0, 2, 240)
    df = spark.createDataFrame([(int(i), x[i].tolist(), int(labels[i])) for i in range(240)] + [(None, [1.0] * 8, 0), (999, [1.0] * 8, None)],
                               "vec_id long, embedding array<float>, label int")
    planes = np.random.default_rng(42).standard_normal((8, 6 * 4))
    keys = (x.astype(np.float64) @ planes > 0).reshape(240, 6, 4)
    u = x.astype(np.float64) / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1), 1e-12)[:, None]
    want = {(int(labels[i]), i, j) for i, j in combinations(range(240), 2) if labels[i] == labels[j] and x[i].any() and x[j].any()
            and (keys[i] == keys[j]).all(axis=1).any() and u[i] @ u[j] >= 0.4}
    for rows in (32, 4096):
        got = [(r.label, r.i, r.j) for r in lsh_candidates(df, 0.4, bands=6, bits=4, block_rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def brute(docs, t):
    out = {}
    for d, sents in docs.items():
        for (i, a), (j, b) in combinations(enumerate(sents), 2):
            dot, nsq = sum(a[w] * b[w] for w in a), sum(v * v for v in a.values()) * sum(v * v for v in b.values())
            if nsq and dot / nsq ** 0.5 >= t:
                out[d, i, j] = (dot, len(a.keys() & b.keys()), sum(v * v for v in a.values()), len(b), "not" in a)
    return out


@pytest.mark.parametrize("block_rows", [7, 256])
def test_tiles_of_sentences_equal_brute_force(spark, block_rows):
    rnd = random.Random(3)
    docs = {d: [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 7))) + "!" for _ in range(n)] for d, n in enumerate((0, 1, 2, 30, 41))}
    arrays = spark.createDataFrame([(d, s, len(s)) for d, s in docs.items()] + [(None, ["a", "a"], 2)], "doc_id long, sents array<string>, total_sentences int")
    words = {d: [[] for _ in s] for d, s in docs.items()}
    for r in arrays.where("doc_id is not null").select("doc_id", F.posexplode("sents").alias("i", "s")).select("doc_id", "i", tx.tokens(F.col("s")).alias("w")).collect():
        words[r.doc_id][r.i] = Counter(r.w)
    words = {d: [Counter(w) for w in s] for d, s in words.items()}
    got = sentence_candidates(arrays, 0.4, block_rows=block_rows).collect()
    assert len(got) == len({(r.doc_id, r.i, r.j) for r in got})
    assert {(r.doc_id, r.i, r.j): (r.dot, r.shared, r.nsq_i, r.nd_j, r.neg_i) for r in got} == brute(words, 0.4)


def test_copies_of_a_document_add_up_as_on_words(spark):
    one = [(1, ["a b b c", "a c d", "x y"], 3)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, sents array<string>, total_sentences int")
    once, twice = (sentence_candidates(df(rows), 0.4).collect() for rows in (one, one * 2))
    assert [(r.i, r.j, r.dot * 4, r.shared * 4, r.nsq_i) for r in once] == [(r.i, r.j, r.dot, r.shared, r.nsq_i) for r in twice]
    v = sentence_vectors(df(one * 2).select("doc_id", F.posexplode("sents").alias("idx", "sentence")))
    assert token_candidates(v, 0.4).collect() == twice


def test_candidates_need_one_shuffle_and_no_join(spark):
    docs = spark.createDataFrame([(1, "A b. A c.")], "doc_id long, text string")
    plan = plan_of(check_documents(docs).candidates)
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1 and plan.count("split(") == 1


def test_aligned_features_of_odd_sentences(spark):
    rows = [("Not été été", "ÉTÉ not x"), ("İstanbul Σας", "i̇stanbul σας"), ("", "a"), (None, "a"), ("𝐀b 10²", "𝐀b 10²"), ("no a", "a")]
    df = spark.createDataFrame(rows, "sentence1 string, sentence2 string")
    out = aligned_features(df)
    got = out.withColumn("a", tx.tokens(F.col("sentence1"))).withColumn("b", tx.tokens(F.col("sentence2"))).collect()
    for r in got:
        a, b = Counter(r.a or []), Counter(r.b or [])
        den = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
        assert r.cos == (sum(a[w] * b[w] for w in a) / den ** 0.5 if den else 0.0)
        assert r.jac == (len(a.keys() & b.keys()) / len(a.keys() | b.keys()) if a and b else 0.0)
        assert r.neg == (None if r.a is None else (bool({"not", "no"} & a.keys()) != bool({"not", "no"} & b.keys())))
    assert len(got) == 6 and "array_sort" not in plan_of(out)


def test_sentence_split_works_on_whole_texts(spark):
    """The cheap patterns split as the plain ones do, and nothing runs for each sentence."""
    rnd = random.Random(8)
    bits = ["mr", "Dr", "e.g", "prof", "I.E", "é", "a", "𝐀", "😀", " ", " ", "\xa0", ".", ".", ".", "!", "”", ")", "\x85", "​", "7"]
    df = spark.createDataFrame([("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))),) for _ in range(4000)] + [(None,)], "text string")
    bare = F.regexp_replace("text", tx.STRIP_RE, "")
    marked = F.regexp_replace(F.regexp_replace(bare, tx.ABBREV_RE, "$1$2." + tx.GUARD_MARK), tx.BOUNDARY_RE, "$1" + tx.SPLIT_MARK)
    plain = F.filter(F.transform(F.split(marked, tx.SPLIT_MARK), lambda s: F.regexp_replace(s, tx.GUARD_MARK, "")), lambda s: s != "")
    new = df.select(tx.split_sentences(F.col("text")))
    assert df.where(~plain.eqNullSafe(tx.split_sentences(F.col("text")))).count() == 0
    assert "lambdafunction" not in plan_of(new)
    assert "lambdafunction" not in plan_of(sentence_arrays(df.withColumn("doc_id", F.lit(1))))
