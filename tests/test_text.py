"""Sentence split, strip, tokens, truncation (T-1..T-4)."""

from pyspark.sql import functions as F

from clashlens.functions import text as tx
from clashlens.operators.sentences import sentence_arrays, sentence_vectors, sentences


def split(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: list(r.sents) for r in sentence_arrays(df).collect()}


def test_split_cases(spark):
    got = split(spark, [
        None, "", " \t\n ", "One sentence.", "First one. Second one!", "Same. Same.",
        "No terminal mark", "Dr. Smith arrived. He sat.", "A line\nbreak inside. Next?", "...",
        "He said \"stop.\" Then left.", "e.g. this stays. New one.",
    ])
    assert got[0] == [] and got[1] == [] and got[2] == []
    assert got[3] == ["One sentence."]
    assert got[4] == ["First one.", "Second one!"]
    assert got[5] == ["Same.", "Same."]
    assert got[6] == ["No terminal mark"]
    assert got[7] == ["Dr. Smith arrived.", "He sat."]
    assert got[8] == ["A line\nbreak inside.", "Next?"]
    assert got[9] == ["..."]
    assert got[10] == ["He said \"stop.\"", "Then left."]
    assert got[11] == ["e.g. this stays.", "New one."]


def test_strip_matches_python(spark):
    samples = [" a ", " \tb\n", "　c ", "d", "", "  "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(tx.strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]


def test_positions_are_zero_based(spark):
    df = spark.createDataFrame([(7, "A b. C d. E f.")], "doc_id long, text string")
    rows = sorted((r.idx, r.sentence) for r in sentences(df).collect())
    assert rows == [(0, "A b."), (1, "C d."), (2, "E f.")]


def test_term_vector_counts(spark):
    df = spark.createDataFrame([(1, 0, "The cat saw the other cat, the end."), (1, 1, "!!!")],
                               "doc_id long, idx int, sentence string")
    rows = {r.idx: r for r in sentence_vectors(df).collect()}
    terms = {t.token: t.tf for t in rows[0].terms}
    assert terms == {"the": 3, "cat": 2, "saw": 1, "other": 1, "end": 1}
    assert rows[0].nsq == 9 + 4 + 1 + 1 + 1 and rows[0].nd == 5
    assert rows[1].terms == [] and rows[1].nsq == 0 and rows[1].nd == 0


def greedy(la, lb, budget):
    while la + lb > budget:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def test_truncation_closed_form_equals_greedy(spark):
    cases = [(a, b, k) for a in range(0, 12) for b in range(0, 12) for k in (0, 1, 5, 8, 13)]
    df = spark.createDataFrame(cases, "la int, lb int, k int")
    out = []
    for k in (0, 1, 5, 8, 13):
        ka, kb = tx.truncate_pair(F.col("la"), F.col("lb"), k)
        out += [((r.la, r.lb, k), (r.a, r.b)) for r in df.where(F.col("k") == k).select("la", "lb", ka.alias("a"), kb.alias("b")).collect()]
    for (la, lb, k), got in out:
        assert got == greedy(la, lb, k), (la, lb, k)
