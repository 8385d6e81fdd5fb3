"""The user's encoder and model in the pair check, the evaluation and the pair stream (E-4, N-8, M-1..M-3, M-8, ST-1, T-4)."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clashlens.config import Settings
from clashlens.operators.aligned import with_encoded_cosine
from clashlens.operators.nli import model_scored, model_scorer
from clashlens.plans import evaluation as ev
from clashlens.plans.pair_check import gated_pairs, pair_report
from clashlens.streaming.checks import stream_pair_reports

ORDER = ["entailment", "neutral", "contradiction"]


def vector(text):
    v = np.zeros(27)
    for ch in text.lower():
        v[ord(ch) - 97 if "a" <= ch <= "z" else 26] += 1
    return v


def cosine(a, b):
    x, y = (vector(t) / max(np.linalg.norm(vector(t)), 1e-300) for t in (a, b))
    return float(np.dot(x.astype(np.float32).astype(float), y.astype(np.float32).astype(float)))


def logging_encoder(folder):
    """Counts letters; leaves a file for every sentence that it encodes."""
    def load():
        import os
        import uuid

        import numpy as np

        def enc(texts):
            out = np.zeros((len(texts), 27))
            for r, t in enumerate(texts):
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(t)
                for ch in t.lower():
                    out[r, ord(ch) - 97 if "a" <= ch <= "z" else 26] += 1
            return out
        return enc
    return load


def length_model(folder):
    """Contradiction where the lengths differ by over five characters; notes the texts that it is given."""
    def load():
        import json
        import os
        import uuid

        def score(a, b):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                json.dump([a, b], f)
            return [[0.1, 0.1, 0.8] if abs(len(x) - len(y)) > 5 else [0.7, 0.2, 0.1] for x, y in zip(a, b)]
        return score
    return load


@pytest.fixture
def folders(tmp_path):
    out = [tmp_path / x for x in ("encoded", "scored")]
    for p in out:
        p.mkdir()
    return [str(p) for p in out]


def encoded(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def some_pairs():
    said = ["The sky is blue", "The sky is not blue at all", "zzz qqq", "", "A sky of blue", "The sky is blue", "été à Zürich"]
    rows = [(i, said[i % 7], said[(i * 3 + 1) % 7]) for i in range(40)]
    return rows + [(100, None, "x"), (101, None, None), (102, "zzz qqq", "zzz qqq")]


def frame(spark):
    return spark.createDataFrame(some_pairs(), "pair_id long, sentence1 string, sentence2 string").repartition(5)


def test_cosines_equal_numpy_and_sentences_are_encoded_once(spark, folders):
    got = {r.pair_id: r.cos for r in with_encoded_cosine(frame(spark).withColumn("cos", F.lit(9.0)), logging_encoder(folders[0])).collect()}
    for i, a, b in some_pairs():
        assert got[i] == pytest.approx(cosine(a or "", b or ""), abs=1e-12)
    assert len(got) == len(some_pairs()) and encoded(folders[0]) == sorted({t or "" for _, a, b in some_pairs() for t in (a, b)})
    assert with_encoded_cosine(frame(spark).limit(0), logging_encoder(folders[0])).collect() == []


def test_pair_report_with_encoder_and_model(spark, folders):
    model = length_model(folders[1])
    rep = {r.pair_id: r for r in pair_report(frame(spark), ("pair_id",), scorer=lambda d: model_scorer(d, model, ORDER), encoder=logging_encoder(folders[0])).collect()}
    for i, a, b in some_pairs():
        a, b, r = a or "", b or "", rep[i]
        cos = cosine(a, b)
        assert r.similarity == pytest.approx(round(cos, 4), abs=1e-4) and r.passed_filter == (cos >= 0.4)
        if cos >= 0.4:
            contra = abs(len(a) - len(b)) > 5
            assert (r.verdict, r.confidence) == (("CONTRADICTION", 0.8) if contra else ("CONSISTENT", 0.7)) and r.filtered_reason is None
        else:
            assert (r.verdict, r.confidence, r.contradiction) == ("CONSISTENT", None, None) and r.filtered_reason
    assert len(encoded(folders[0])) == len(set(encoded(folders[0])))


def test_pair_report_with_an_encoder_and_the_built_in_scorer(spark, folders):
    g = {r.pair_id: r for r in gated_pairs(frame(spark), encoder=logging_encoder(folders[0])).collect()}
    for i, a, b in some_pairs():
        assert g[i].cos == pytest.approx(cosine(a or "", b or ""), abs=1e-12)
    assert g[1].passed_filter and 0 < g[1].contradiction < 1


def test_models_get_cut_texts_and_rows_keep_whole_ones(spark, folders):
    import json
    long = "Héé, " + "Word-Two  " * 300 + "END"
    df = spark.createDataFrame([(1, long, "short one"), (2, "a b", "c d")], "pair_id long, sentence1 string, sentence2 string")
    model = length_model(folders[1])
    out = {r.pair_id: r for r in model_scored(df, lambda d: model_scorer(d, model, ORDER)).collect()}
    assert out[1].sentence1 == long and out[1].sentence2 == "short one"
    seen = [t for f in os.listdir(folders[1]) for side in json.load(open(os.path.join(folders[1], f))) for t in side]
    cut = next(t for t in seen if t.startswith("Héé"))
    words = "Héé, " + "Word-Two  " * 61      # 123 tokens of 125, the short sentence has two
    assert cut == words.rstrip() and "short one" in seen and {"a b", "c d"} <= set(seen)


def graded(spark):
    rows = [("test", 1, i, a or "", b or "", float(i % 6)) for i, a, b in some_pairs()]
    return ev.graded_pairs(spark.createDataFrame(rows, "split string, doc_id int, idx long, sentence1 string, sentence2 string, score double").repartition(3))


def test_evaluation_with_encoder_and_model(spark, folders):
    model, enc = length_model(folders[1]), logging_encoder(folders[0])
    scorer = lambda d: model_scorer(d, model, ORDER)
    wide = {r.idx: r for r in ev.wide_predictions(graded(spark), scorer=scorer, encoder=enc).collect()}
    for i, a, b in some_pairs():
        cos, contra = cosine(a or "", b or ""), abs(len(a or "") - len(b or "")) > 5
        w, full = wide[i], 5 * 0.1 + 2.5 * 0.1 if contra else 5 * 0.7 + 2.5 * 0.2
        assert w.pred_embedding == pytest.approx(5 * cos) and w.bin_embedding == int(5 * cos < 2)
        assert w.pred_verifier == pytest.approx(full) and w.bin_verifier == int(contra)
        assert w.pred_two_stage == pytest.approx(full if cos >= 0.4 else 5 * cos)
    assert len(encoded(folders[0])) == len(set(encoded(folders[0])))
    m = {r.method: r for r in ev.method_comparison(graded(spark), scorer=scorer, encoder=enc).collect()}
    preds = {k: [getattr(wide[i], f"pred_{k}") for i, *_ in some_pairs()] for k in ev.METHODS}
    gold = [float(i % 6) for i, *_ in some_pairs()]
    for k in ev.METHODS:
        assert m[k].pearson == pytest.approx(np.corrcoef(preds[k], gold)[0, 1], abs=1e-5) and m[k].n_pairs == len(gold)
    sweep = {r.threshold: r.survivors for r in ev.threshold_sweep(graded(spark), scorer=scorer, encoder=enc).collect()}
    assert all(sweep[t] == sum(cosine(a or "", b or "") >= t for _, a, b in some_pairs()) for t in Settings().sweep_thresholds)


def test_pair_stream_with_encoder_equals_batch(spark, folders, tmp_path):
    model, enc = length_model(folders[1]), logging_encoder(folders[0])
    scorer = lambda d: model_scorer(d, model, ORDER)
    frame(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream_pair_reports(spark, str(tmp_path / "in"), str(tmp_path / "out"), scorer=scorer, encoder=enc).awaitTermination()
    got = {r.pair_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = [(i, a, b) for i, a, b in some_pairs() if (a or "").strip() and (b or "").strip()]
    assert set(got) == {i for i, *_ in some_pairs()} and {i for i, r in got.items() if r.error is None} == {i for i, *_ in whole}
    for i, a, b in whole:
        assert got[i].similarity == pytest.approx(round(cosine(a, b), 4), abs=1e-4)
    assert len(encoded(folders[0])) == len(set(encoded(folders[0])))
