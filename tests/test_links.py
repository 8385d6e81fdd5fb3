"""Links of equal sentences: compared once, counted and expanded as their pairs."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clashlens.operators import reports
from clashlens.operators.similarity import aligned_features, pairs_of, sentence_links, token_candidates
from clashlens.operators.sentences import sentence_arrays, sentence_vectors
from clashlens.operators.terms import odd_tokens
from clashlens.plans.document_check import check_documents

SENTS = ["a b c", "a b no", "...", "x y", "a a b", "ÉTÉ Σας b", "q"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def arrays_of(spark, rows):
    return spark.createDataFrame([(d, s, len(s)) for d, s in rows], "doc_id long, sents array<string>, total_sentences int")


@pytest.mark.parametrize("block_rows", [4, 7, 256])
def test_equal_sentences_are_one_link_with_all_their_pairs(spark, block_rows):
    docs = [(1, [SENTS[k * k % 7] for k in range(40)]), (2, ["a b"] * 30), (3, SENTS)]
    arrays = arrays_of(spark, docs)
    words = {"a b c": "a b c", "a b no": "a b no", "...": "", "x y": "x y", "a a b": "a a b", "ÉTÉ Σας b": "été σας b", "q": "q", "a b": "a b"}
    want = set()
    for d, sents in docs:
        for (i, s), (j, z) in combinations(enumerate(sents), 2):
            a, b = Counter(words[s].split()), Counter(words[z].split())
            dot, den = sum(a[w] * b[w] for w in a), sum(v * v for v in a.values()) * sum(v * v for v in b.values())
            if den and dot / den ** 0.5 >= 0.4:
                want.add((d, i, j, s, z, dot, len(a.keys() & b.keys()), len(a), len(b), "no" in a, "no" in b))
    links = sentence_links(arrays, 0.4, block_rows=block_rows, with_texts=True).cache()
    got = [tuple(r) for r in pairs_of(links).select("doc_id", "i", "j", "sentence1", "sentence2", "dot", "shared", "nd_i", "nd_j", "neg_i", "neg_j").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = sentence_links(arrays, 0.4, block_rows=block_rows, with_pairs=False).groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("n").alias("links")).collect()
    assert {r.doc_id: r.n for r in few} == Counter(w[0] for w in want)
    if block_rows == 256:
        assert {r.doc_id: r.links for r in few}[2] == 1 and links.where("doc_id = 2").count() == 1


def test_stats_count_the_pairs_of_links(spark):
    text = "The cat is on the mat. " * 5 + "The cat is not on the mat. " * 4 + "Dogs bark."
    docs = spark.createDataFrame([(1, text), (2, None), (None, text), (4, "Rain.")], "doc_id long, text string")
    c = check_documents(docs)
    plain = reports.doc_stats(c.arrays, reports.candidate_counts(c.scored))
    assert sorted(map(str, c.stats().collect())) == sorted(map(str, plain.collect())) and c.stats().schema == plain.schema
    row = c.stats().where("doc_id = 1").first()
    assert (row.filtered_pairs, row.contradiction_count) == (36, 20)
    assert c.links.count() == 3


def test_texts_come_from_the_tiles(spark):
    docs = spark.createDataFrame([(1, "A b c. A b d. A not b c."), (2, "A b c. A b d. Z.")], "doc_id long, text string")
    c = check_documents(docs)
    for df in (c.candidate_texts(), c.contradictions()):
        plan = plan_of(df)
        assert "Join" not in plan and "Aggregate" not in plan and plan.count("split(") == 1
    assert sorted(map(tuple, c.candidate_texts().collect())) == sorted(map(tuple, reports.with_texts(c.candidates.select("doc_id", "i", "j"), docs).collect()))
    assert [tuple(r)[:5] for r in c.contradictions().collect()] == [tuple(r)[:5] for r in reports.contradictions(c.scored, docs).collect()]


def test_texts_of_documents_that_come_twice(spark):
    rows = [(1, "A b c. A b d. A not b c."), (1, "A b c. A b d. A not b c."), (2, "A b. A b."), (2, "A b."), (3, "X y. X not y."), (None, "A b. A b.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c = check_documents(docs)
    for got, want in ((c.candidate_texts(), reports.with_texts(c.candidates.select("doc_id", "i", "j"), docs)), (c.contradictions(), reports.contradictions(c.scored, docs))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.schema == want.schema


def test_items_that_come_twice_in_a_group_add_up_beside_others(spark):
    rows = [(1, ["a b", "a c", "a b"]), (1, ["a b", "a c", "a b"]), (2, ["a b", "a c", "a b"])]
    vectors = sentence_vectors(arrays_of(spark, rows).select("doc_id", F.posexplode("sents").alias("idx", "sentence")))
    got = {(r.doc_id, r.i, r.j): r.dot for r in token_candidates(vectors, 0.4).collect()}
    assert got == {(1, 0, 1): 4, (1, 0, 2): 8, (1, 1, 2): 4, (2, 0, 1): 1, (2, 0, 2): 2, (2, 1, 2): 1}


def test_odd_words_go_to_python_without_null_lists(spark):
    """The Arrow writer goes over the null lists of a batch at each of its rows."""
    df = spark.createDataFrame([("a", "b")], "sentence1 string, sentence2 string")
    assert df.select(odd_tokens(F.col("sentence1")).alias("o")).schema["o"].dataType == T.StringType()
    assert "array<" not in str(aligned_features(df)._jdf.queryExecution().analyzed().toString()) and aligned_features(df).count() == 1
    one = check_documents(spark.createDataFrame([(1, "Σ b. Σ b. !")], "doc_id long, text string"))
    assert [(r.i, r.j, r.dot) for r in one.candidates.collect()] == [(0, 1, 2)] and sentence_arrays(one.docs).count() == 1
