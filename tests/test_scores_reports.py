"""Scorer arithmetic, verdict boundaries, and the worked-example report (N-*, D-*)."""

import pytest
from pyspark.sql import functions as F

from clashlens.functions.scores import (argmax_label, expected_score, score_label, softmax3, verdict,
                                        verdict_confidence)
from clashlens.operators import reports


def test_softmax_extremes(spark):
    df = spark.createDataFrame([(1000.0, -1000.0, 0.0), (1.0, 1.0, 1.0)], "a double, b double, c double")
    rows = df.select(*[x.alias(n) for x, n in zip(softmax3(F.col("a"), F.col("b"), F.col("c")), "pqr")]).collect()
    assert rows[0].p == pytest.approx(1.0) and rows[0].q == 0.0
    assert rows[1].p == pytest.approx(1 / 3) and rows[1].p + rows[1].q + rows[1].r == pytest.approx(1.0)


def test_argmax_tie_takes_first_label(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "e double, n double, c double")
    got = [r[0] for r in df.select(argmax_label(F.col("e"), F.col("n"), F.col("c"))).collect()]
    assert got == ["entailment", "neutral", "contradiction"]


def test_verdict_boundary_070(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.70), (0.2, 0.1, 0.6999999999), (0.5, 0.3, None)],
                               "e double, n double, c double")
    rows = df.select(verdict(F.col("c")).alias("v"),
                     verdict_confidence(F.col("e"), F.col("n"), F.col("c")).alias("conf")).collect()
    assert [r.v for r in rows] == ["CONTRADICTION", "CONSISTENT", "CONSISTENT"]
    assert [r.conf for r in rows] == [0.70, 0.2, 0.5]


def test_expected_score(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], "e double, n double, c double")
    assert [r[0] for r in df.select(expected_score(F.col("e"), F.col("n"), F.col("c"))).collect()] == [5.0, 2.5, 0.0]


def test_score_label_boundaries(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 2.0, 2.0001, 3.4999, 3.5, 5.0)], "s double")
    got = [r[0] for r in df.select(score_label(F.col("s"))).collect()]
    assert got == ["contradiction", "contradiction", "neutral", "neutral", "consistent", "consistent"]


def test_worked_example(spark):
    """4 sentences; given cosines and P(contradiction): 6 pairs, 4 survive, (0,2) and (1,2), score 0.5."""
    cos = {(0, 1): 0.52, (0, 2): 0.61, (0, 3): 0.48, (1, 2): 0.43, (1, 3): 0.39, (2, 3): 0.35}
    pc = {(0, 1): 0.01, (0, 2): 0.9996, (0, 3): 0.02, (1, 2): 0.997, (1, 3): 0.0, (2, 3): 0.0}
    scored = spark.createDataFrame([(1, i, j, c, pc[(i, j)]) for (i, j), c in cos.items()],
                                   "doc_id long, i int, j int, cos double, contradiction double").where("cos >= 0.40")
    sents = ["The frost was hard.", "Mia wore a wool coat.", "It was a hot sunny noon.", "Kids sledded on snow."]
    arrays = spark.createDataFrame([(1, sents, 4), (2, [], 0), (3, ["Only one."], 1)],
                                   "doc_id long, sents array<string>, total_sentences int")
    stats = {r.doc_id: r for r in reports.doc_stats(arrays, reports.candidate_counts(scored)).collect()}
    s = stats[1]
    assert (s.total_pairs, s.filtered_pairs, s.filter_reduction_pct, s.consistency_score) == (6, 4, 33.33, 0.5)
    for d in (2, 3):
        assert (stats[d].total_pairs, stats[d].filtered_pairs, stats[d].filter_reduction_pct,
                stats[d].consistency_score) == (0, 0, 100.0, 1.0)
    c = reports.contradictions(scored, arrays).orderBy("i", "j").collect()
    assert [(r.i, r.j) for r in c] == [(0, 2), (1, 2)]
    assert c[0].sentence1 == sents[0] and c[0].sentence2 == sents[2]


def test_doc_verdict_text(spark):
    df = spark.createDataFrame([(0,), (1,), (3,)], "k long")
    got = [r[0] for r in df.select(reports.doc_verdict_text(F.col("k"))).collect()]
    assert got == ["Fully Consistent", "1 Contradiction", "3 Contradictions"]


def test_properties_on_driver_documents(spark):
    from clashlens.plans.document_check import check_documents
    from clashlens.sources.tables import read_table
    c = check_documents(read_table(spark, "/root/testdata/sf0.001", "documents"))
    s = c.scored.agg(F.max(F.abs(F.col("entailment") + F.col("neutral") + F.col("contradiction") - 1)).alias("dev"),
                     F.min("cos").alias("mincos"), F.count_if(F.col("i") >= F.col("j")).alias("bad")).collect()[0]
    assert s.dev < 1e-12 and s.mincos >= 0.40 and s.bad == 0
    st = c.stats().agg(F.min("consistency_score").alias("lo"), F.max("consistency_score").alias("hi"),
                       F.count_if(F.col("filtered_pairs") > F.col("total_pairs")).alias("over")).collect()[0]
    assert 0.0 <= st.lo <= st.hi <= 1.0 and st.over == 0


def test_rounding_equals_python(spark):
    from pyspark.sql import functions as F

    from clashlens.functions.scores import rounded
    df = (spark.range(1, 401).withColumnRenamed("id", "n").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
          .withColumn("x", 1 - F.col("k") / F.col("n")).withColumn("y", F.col("x") * 100.0))
    got = df.select("x", "y", rounded(F.col("x"), 4).alias("a"), rounded(F.col("y"), 2).alias("b"), rounded(-F.col("x"), 3).alias("c")).toPandas()
    for x, y, a, b, c in got.itertuples(index=False, name=None):
        assert (a, b, c) == (round(x, 4), round(y, 2), round(-x, 3)), (x, y)
    odd = [2.675, 0.5, 1.5, 2.5, 0.125, 1e15 + 0.5, 4.35, 1.005]
    got = spark.createDataFrame([(v,) for v in odd], "x double").select("x", rounded(F.col("x"), 2).alias("r"), rounded(F.col("x"), 0).alias("z")).collect()
    assert all(r["r"] == round(r["x"], 2) and r["z"] == round(r["x"], 0) for r in got)


def test_a_curve_of_many_thresholds_equals_one_by_one(spark):
    """Every point of a fine sweep against plain counting, boundaries included."""
    from clashlens.functions.scores import rounded  # noqa: F401
    from clashlens.plans import evaluation as ev
    said = ["a b c d e", "a b x y z", "a b c d e f g", "not a b", "a", "q r", "a b c not", ""]
    rows = [("s" if i % 3 else "t", i, 0, said[i % 8], said[(i * 5 + 2) % 8], float(i % 6)) for i in range(60)]
    g = ev.graded_pairs(spark.createDataFrame(rows, "split string, doc_id int, idx int, sentence1 string, sentence2 string, score double"))
    ts = [i / 50 for i in range(1, 51)] + [0.4]
    got = {(r.split, r.threshold): r for r in ev.threshold_sweep(g, thresholds=ts).collect()}
    wide = ev.scored_features(g).select("split", "cos", "contradiction", "label").collect()
    assert len(got) == 2 * len(set(ts)) and any(r.cos in ts for r in wide)
    for (split, t), r in got.items():
        mine = [w for w in wide if w.split == split]
        said_ = [(w.contradiction >= 0.7) if w.cos >= t else 5 * w.cos <= 2 for w in mine]
        tp, fp, fn = (sum(p == x and (w.label == "contradiction") == y for p, w in zip(said_, mine)) for x, y in ((1, 1), (1, 0), (0, 1)))
        assert (r.n_pairs, r.survivors) == (len(mine), sum(w.cos >= t for w in mine))
        assert abs(r.f1 - (2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)) < 1e-6
