"""Candidate plans against brute force (P-1, P-2, E-2, E-4)."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from clashlens.operators.sentences import sentence_vectors
from clashlens.operators.similarity import aligned_features, dense_candidates, token_candidates, with_l2_normalized

WORDS = "alpha beta gamma delta not no eps zeta eta theta".split()


def brute_pairs(rows, t):
    """All pairs i < j of a document (the reference's double loop), kept when cos >= t."""
    out = {}
    by_doc = {}
    for d, i, s in rows:
        by_doc.setdefault(d, []).append((i, Counter(s.lower().split())))
    for d, items in by_doc.items():
        for (i, a), (j, b) in itertools.combinations(sorted(items), 2):
            dot = sum(a[k] * b[k] for k in a)
            na, nb = sum(v * v for v in a.values()), sum(v * v for v in b.values())
            cos = dot / math.sqrt(na * nb) if na * nb else 0.0
            if cos >= t:
                out[(d, i, j)] = cos
    return out


@pytest.mark.parametrize("t", [0.3, 0.4, 0.65])
def test_token_plan_equals_brute_force(spark, t):
    rnd = random.Random(7)
    rows = [(d, i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 6))))
            for d in range(5) for i in range(rnd.randint(0, 25))]
    df = spark.createDataFrame(rows, "doc_id long, idx int, sentence string")
    got = {(r.doc_id, r.i, r.j): r.cos for r in token_candidates(sentence_vectors(df), t).collect()}
    want = brute_pairs(rows, t)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)
        assert k[1] < k[2]


def test_token_plan_rejects_nonpositive_threshold(spark):
    df = spark.createDataFrame([(1, 0, "a")], "doc_id long, idx int, sentence string")
    with pytest.raises(ValueError):
        token_candidates(sentence_vectors(df), 0.0)


def test_survivors_fall_as_threshold_rises(spark):
    rnd = random.Random(3)
    rows = [(0, i, " ".join(rnd.choice(WORDS) for _ in range(4))) for i in range(40)]
    v = sentence_vectors(spark.createDataFrame(rows, "doc_id long, idx int, sentence string"))
    counts = [token_candidates(v, t).count() for t in (0.3, 0.4, 0.5, 0.65)]
    assert counts == sorted(counts, reverse=True)


def test_dense_plan_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n, d = 300, 8
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[0] = 0.0                                   # zero vector never pairs
    labels = rng.integers(0, 3, size=n)
    rows = [(int(i), x[i].tolist(), int(labels[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.label, r.i, r.j): r.cos for r in dense_candidates(df, 0.4, block_rows=32).collect()}
    u = x.astype(np.float64)
    nr = np.linalg.norm(u, axis=1)
    u = u / np.where(nr > 0, nr, 1)[:, None]
    want = {}
    for i in range(n):
        for j in range(i + 1, n):
            if labels[i] == labels[j]:
                c = float(u[i] @ u[j])
                if c >= 0.4:
                    want[(int(labels[i]), i, j)] = c
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_l2_normalize_zero_and_unit(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    rows = {r.id: r for r in with_l2_normalized(df, "v").collect()}
    assert rows[1].unit == pytest.approx([0.6, 0.8]) and rows[1].norm == 5.0
    assert rows[2].unit == [0.0, 0.0]


def test_aligned_features(spark):
    df = spark.createDataFrame([(1, "a a b", "a b c"), (2, "", "x"), (3, "it is not", "it is")],
                               "pair_id long, sentence1 string, sentence2 string")
    rows = {r.pair_id: r for r in aligned_features(df).collect()}
    assert rows[1].cos == pytest.approx(3 / math.sqrt(5 * 3))
    assert rows[1].jac == pytest.approx(2 / 3)
    assert rows[2].cos == 0.0 and rows[2].jac == 0.0
    assert rows[3].neg is True and rows[1].neg is False


def test_lsh_recall_and_precision_against_the_exact_plan(spark):
    from clashlens.operators.similarity import lsh_candidates
    from clashlens.plans.catalog import QUERIES
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 24))
    x = np.concatenate([base + 0.8 * rng.normal(size=base.shape) for _ in range(8)] + [np.zeros((2, 24))]).astype(np.float32)
    df = spark.createDataFrame([(int(i), x[i].tolist(), int(i % 3)) for i in range(len(x))], "vec_id long, embedding array<float>, label int").repartition(5)
    exact = {(r.label, r.i, r.j): r.cos for r in dense_candidates(df, 0.4, block_rows=16).collect()}
    found = {(r.label, r.i, r.j): r.cos for r in lsh_candidates(df, 0.4).collect()}
    assert found.keys() <= exact.keys() and len(found) >= 0.9 * len(exact) > 100
    assert all(found[k] == pytest.approx(exact[k], abs=1e-9) for k in found)
    sf = "/root/testdata/sf0.01"
    want, got = ({(r.label, r.i, r.j) for r in QUERIES[q](spark, sf).collect()} for q in ("candidate_pairs_dense", "candidate_pairs_lsh"))
    assert got <= want and len(got) >= 0.9 * len(want) - 1
    assert lsh_candidates(df.limit(0), 0.4).collect() == []


def test_cosine_exactly_at_threshold_passes(spark):
    # 5 distinct tokens each, 2 shared: cos = 2 / sqrt(5 * 5) = 0.4 exactly
    df = spark.createDataFrame([(1, 0, "a b c d e"), (1, 1, "a b x y z")], "doc_id long, idx int, sentence string")
    v = sentence_vectors(df)
    rows = token_candidates(v, 0.40).collect()
    assert [(r.i, r.j, r.cos) for r in rows] == [(0, 1, 0.4)]
    assert token_candidates(v, 0.4000001).count() == 0


def test_hot_word_of_a_long_document_is_cut_into_bounded_keys(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(11)
    rows = [(0, i, "the " + " ".join(rnd.choice(WORDS) for _ in range(3))) for i in range(330)]   # "the" in all
    rows += [(1, i, "the " + rnd.choice(WORDS)) for i in range(5)]
    v = sentence_vectors(spark.createDataFrame(rows, "doc_id long, idx int, sentence string"))
    whole = {(r.doc_id, r.i, r.j, r.dot, r.shared) for r in token_candidates(v, 0.3, block_rows=1000).collect()}
    cut = token_candidates(v, 0.3, block_rows=50)
    assert {(r.doc_id, r.i, r.j, r.dot, r.shared) for r in cut.collect()} == whole and len(whole) > 1000
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "_lo" in plan and "_hi" in plan
    # keys of the hot word: pairs of 7 blocks of at most 50 sentences, none with more than two blocks
    t = spark.range(330).select((F.col("id") / 50).cast("int").alias("b"))
    t = t.select("b", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    sizes = [r["count"] for r in t.groupBy(F.least("b", "k"), F.greatest("b", "k")).count().collect()]
    assert len(sizes) == 28 and max(sizes) <= 100


def test_dense_tiles_off_the_diagonal(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, id int, v array<double>")
    got = {(r.i, r.j) for r in dense_candidates(df, 0.5, "g", "id", "v", block_rows=20).collect()}
    assert got == {(i, j) for j in range(90) for i in range(j) if x[i] @ x[j] >= 0.5}
