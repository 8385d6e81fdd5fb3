"""Model hooks (U-1, U-2, U-3) and the pair JSON sink (S-7)."""

import json

import numpy as np
import pytest

from clashlens.operators.hooks import encode_with, generate_with
from clashlens.operators.nli import model_scorer
from clashlens.operators.similarity import dense_candidates
from clashlens.plans.pair_check import pair_report
from clashlens.sources.sinks import pair_records_json


# Loaders are built inside factories so that cloudpickle ships them by value to the Python workers
# (functions at module level of a test file are pickled by reference and cannot be imported there).

def make_letter_encoder():
    def load():
        import numpy as np

        def enc(texts):
            out = np.zeros((len(texts), 26))
            for r, t in enumerate(texts):
                for ch in t.lower():
                    if "a" <= ch <= "z":
                        out[r, ord(ch) - 97] += 1
            return out
        return enc
    return load


def make_fixed_scorer():
    """A model whose classes come in another order: contradiction, entailment, neutral."""
    def load():
        def score(a, b):
            return [[0.9, 0.05, 0.05] if ("not" in x.split()) != ("not" in y.split()) else [0.1, 0.6, 0.3]
                    for x, y in zip(a, b)]
        return score
    return load


def make_upper_generator():
    def load():
        def gen(prompts, n):
            return [[p.split(": ", 1)[1].upper()] * n for p in prompts]
        return gen
    return load


def test_encoder_hook_feeds_dense_plan(spark):
    df = spark.createDataFrame([(1, "abc", 0), (2, "abd", 0), (3, "xyz", 0)], "vec_id long, sentence string, label int")
    enc = encode_with(df, make_letter_encoder(), out="embedding")
    norms = [float(np.linalg.norm(r.embedding)) for r in enc.collect()]
    assert norms == pytest.approx([1.0, 1.0, 1.0], abs=1e-6)
    pairs = {(r.i, r.j) for r in dense_candidates(enc, 0.5).collect()}
    assert pairs == {(1, 2)}


def test_model_scorer_remaps_labels_by_name(spark):
    df = spark.createDataFrame([(1, "it is not so", "it is so"), (2, "it is so", "it is so")],
                               "pair_id long, sentence1 string, sentence2 string")
    rep = {r.pair_id: r for r in pair_report(df, ("pair_id",),
                                             scorer=lambda d: model_scorer(d, make_fixed_scorer(),
                                                                           ["contradiction", "entailment", "neutral"])).collect()}
    assert rep[1].contradiction == 0.9 and rep[1].verdict == "CONTRADICTION"
    assert rep[2].entailment == 0.6 and rep[2].verdict == "CONSISTENT" and rep[2].confidence == 0.6


def test_generator_hook(spark):
    df = spark.createDataFrame([("a cat",), ("a dog",)], "sentence string")
    got = {(r.sentence, r.rank): r.paraphrase for r in generate_with(df, make_upper_generator(), 2).collect()}
    assert got[("a cat", 1)] == "A CAT" and got[("a dog", 2)] == "A DOG"


def test_pair_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "Cats purr.", "Engines roar loudly.")], "pair_id long, sentence1 string, sentence2 string")
    rec = json.loads(pair_records_json(pair_report(df, ("pair_id",)), ("pair_id",)).collect()[0].json)
    assert rec["passed_filter"] is False and rec["entailment"] is None and rec["verdict"] == "CONSISTENT"
    assert rec["threshold"] == 0.4 and rec["filtered_reason"]


def make_constant_encoder(column):
    def load():
        import numpy as np
        return lambda texts: np.eye(3)[[column] * len(texts)]
    return load


def test_two_loaders_of_one_factory_are_two_models(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, sentence string")
    for k in (0, 1, 2):
        assert {int(np.argmax(r.embedding)) for r in encode_with(df, make_constant_encoder(k)).collect()} == {k}


def test_a_model_is_loaded_once_for_each_worker(spark, tmp_path):
    def make(folder):
        def load():
            import os
            import uuid
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(str(os.getpid()))
            return lambda a, b: [[0.2, 0.3, 0.5]] * len(a)
        return load
    df = spark.createDataFrame([(i, "x", "y") for i in range(64)], "id long, sentence1 string, sentence2 string").repartition(16)
    load = make(str(tmp_path))
    for _ in range(2):
        model_scorer(df, load, ["entailment", "neutral", "contradiction"]).collect()
    pids = [p.read_text() for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids))


def make_worked_example():
    """An encoder and a scorer with fixed cosines and probabilities for four sentences."""
    def encoder():
        import numpy as np
        gram = np.eye(4)
        for (i, j), c in {(0, 1): 0.52, (0, 2): 0.61, (0, 3): 0.48, (1, 2): 0.43, (1, 3): 0.39, (2, 3): 0.35}.items():
            gram[i, j] = gram[j, i] = c
        rows = np.linalg.cholesky(gram)
        return lambda texts: rows[["abcd".index(t[0].lower()) for t in texts]]

    def scorer():
        p = {"ab": 0.01, "ac": 0.9996, "ad": 0.02, "bc": 0.997}
        return lambda x, y: [[1 - (c := p[a[0].lower() + b[0].lower()]), 0.0, c] for a, b in zip(x, y)]
    return encoder, scorer


def test_document_check_with_an_encoder_and_a_model(spark):
    from clashlens.plans.document_check import check_documents
    encoder, load = make_worked_example()
    docs = spark.createDataFrame([(7, "A one. B two. C three. D four."), (8, "A only.")], "doc_id long, text string")
    c = check_documents(docs, scorer=lambda d: model_scorer(d, load, ["entailment", "neutral", "contradiction"]), encoder=encoder)
    r = {x.doc_id: x for x in c.report(nested=True).collect()}
    assert (r[7].total_pairs, r[7].filtered_pairs, r[7].consistency_score, r[7].filter_reduction_pct) == (6, 4, 0.5, 33.33)
    assert [(x.i, x.j, x.sentence1, x.sentence2) for x in r[7].contradictions] == [(0, 2, "A one.", "C three."), (1, 2, "B two.", "C three.")]
    assert (r[8].total_pairs, r[8].consistency_score, list(r[8].contradictions)) == (0, 1.0, [])


def test_texts_are_cut_before_the_model(spark):
    from clashlens.operators.nli import within_budget
    df = spark.createDataFrame([("a b c d e f", "x y"), ("a b.", "c d!"), (" ".join("abcdefghij"), " ".join("klmnopqrst"))], "sentence1 string, sentence2 string")
    got = [tuple(r) for r in within_budget(df, 6).collect()]
    assert got == [("a b c d", "x y"), ("a b.", "c d!"), ("a b c", "k l m")]


def test_stream_with_a_model_and_rejects(spark, tmp_path):
    from clashlens.streaming.checks import stream_doc_reports
    encoder, load = make_worked_example()
    docs = spark.createDataFrame([(7, "A one. B two. C three. D four."), (8, "  "), (9, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream_doc_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), encoder=encoder,
                       scorer=lambda d: model_scorer(d, load, ["entailment", "neutral", "contradiction"])).awaitTermination()
    assert [(r.doc_id, r.consistency_score) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(7, 0.5)]
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "out-rejected")).where("error is not null").collect()} == {8, 9}


def test_streams_have_their_own_checkpoints(spark):
    from clashlens.streaming.checks import _checkpoint
    assert _checkpoint(spark, "docs", "/a", None) != _checkpoint(spark, "docs", "/b", None) and _checkpoint(spark, "docs", "/a", "/c") == "/c"
