"""A report on a building with four planted contradictions; the gold marks are of these sentences."""

import itertools

from clashlens.plans.document_check import check_documents
from clashlens.plans.evaluation import metrics

TEXT = [
    "The bridge opened to traffic in April.",
    "Divers inspected both of the stone piers.",
    "The eastern pier shows deep cracks near the water.",
    "A ferry carried cars across the river before that.",
    "Painters need eight weeks for the railings.",
    "The eastern pier shows no deep cracks near the water.",
    "Trucks pay a toll of nine euros.",
    "The bridge never opened to traffic in April.",
    "School classes visit the old toll house.",
    "Trucks pay no toll of nine euros.",
    "The town council voted for new lamps.",
    "Storms closed the walkway twice.",
    "The town council did not vote for new lamps.",
]
GOLD = {(0, 7), (2, 5), (6, 9), (10, 12)}


def test_annotated_document(spark):
    docs = spark.createDataFrame([(1, " ".join(TEXT))], "doc_id long, text string")
    check = check_documents(docs)
    stats = check.stats().collect()[0]
    n = len(TEXT)
    assert (stats.total_sentences, stats.total_pairs) == (n, n * (n - 1) // 2)
    pc = {(r.i, r.j): r.contradiction for r in check.scored.collect()}
    found = {k for k, c in pc.items() if c >= 0.70}
    assert stats.filtered_pairs == len(pc) and stats.contradiction_count == len(found) and len(found & GOLD) >= 3
    rows = [("doc", "two_stage", float(pc.get(k, 0.0)), int(k in found), float(k in GOLD), int(k in GOLD))
            for k in itertools.combinations(range(n), 2)]
    long = spark.createDataFrame(rows, "split string, method string, pred double, pred_bin int, gold double, gold_bin int")
    tp = len(found & GOLD)
    assert metrics(long).collect()[0].f1 == round(2 * tp / (2 * tp + len(found - GOLD) + len(GOLD - found)), 6)
    for t in (0.30, 0.40, 0.50, 0.65):
        k = check_documents(docs, similarity_threshold=t).stats().collect()[0]
        assert k.filter_reduction_pct == round(100 * (1 - k.filtered_pairs / k.total_pairs), 2)
