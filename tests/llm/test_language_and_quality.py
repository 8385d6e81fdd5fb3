import random

import numpy as np
import pytest

from clashlens.llm import language_id as L
from clashlens.llm import mixing, quality
from clashlens.llm.common import PieceTable
from tests.llm.helpers import SF, empty, odd, odd_rows, rows

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet(f"{BIG}/documents.parquet"))


def test_held_out_languages(spark):
    from clashlens.llm.queries import op4_language_id
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    got = op4_language_id(spark, BIG).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.98


def test_mixture_of_two_languages(spark, model):
    by = {}
    for r in spark.read.parquet(f"{BIG}/documents.parquet").where("length(text) > 600 and text not like '%|%' and text not like '%##%'").orderBy("doc_id").collect():
        by.setdefault(r["lang"], " ".join(r["text"].split()[:96]))
    both = by["en"] + " " + " ".join(by["fr"].split()[:48])
    (lang, score, p), = L.infer(model, [both])
    share = dict(zip(model.langs, p))
    assert lang == "en" and 0.5 < share["en"] < 0.8 and 0.2 < share["fr"] < 0.5 and 0 < score < 0.9


def test_expectation_maximisation_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    ll = rng.normal(0, 4, (40, 3))
    values = [L.expectation_maximisation(ll, tolerance=10.0 ** -k)[1] for k in range(1, 9)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def plain_language(model, text):
    """(language, proportions) by plain loops: runs of eight words, every set grown one language at a time."""
    import math

    import regex
    if not text or not regex.search(r"\p{L}", text):
        return "und", None
    found = regex.findall(r"[\p{L}\p{M}]+", text.lower())
    one = [[sum(float(model.logp[g, k]) for w in found[a:a + 8] for g in L.grams(w)) for k in range(len(model.langs))] for a in range(0, len(found), 8)]

    def fitted(some):
        p = [1 / len(some)] * len(some)
        while True:
            share = [[p[i] * math.exp(r[k] - max(r[j] for j in some)) for i, k in enumerate(some)] for r in one]
            q = [sum(s[i] / sum(s) for s in share) / len(one) for i in range(len(some))]
            far, p = max(abs(x - y) for x, y in zip(p, q)), q
            if far <= 1e-6:
                return p, sum(math.log(sum(p[i] * math.exp(r[k] - max(r[j] for j in some)) for i, k in enumerate(some))) + max(r[j] for j in some) for r in one)

    total = [sum(r[k] for r in one) for k in range(len(model.langs))]
    chosen = [total.index(max(total))]
    p, have = fitted(chosen)
    while len(chosen) < len(model.langs):
        value, k = max((fitted([*chosen, k])[1], -k) for k in range(len(model.langs)) if k not in chosen)
        if value - have <= 3 + 0.5 * math.log(len(one)):
            break
        chosen.append(-k)
        p, have = fitted(chosen)
    sizes = [min(8, len(found) - a) for a in range(0, len(found), 8)]
    weigh = [[p[i] * math.exp(r[k] - max(r[j] for j in chosen)) for i, k in enumerate(chosen)] for r in one]
    shares = {model.langs[k]: sum(n * s[i] / sum(s) for n, s in zip(sizes, weigh)) / len(found) for i, k in enumerate(chosen)}
    return max(sorted(shares), key=shares.get), shares


def test_languages_equal_plain_loops(spark, model):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs += [f"{a[:300]} {b[:200]}" for a, b in zip(docs[::7], docs[3::7])] + ["\u0301", "\u0301 12", "a\u0301", "x", ""]
    for text, (lang, score, p) in zip(docs, L.infer(model, docs)):
        want, shares = plain_language(model, text)
        assert lang == want and 0 <= score <= 1
        if shares is not None:
            assert {x: round(v, 3) for x, v in zip(model.langs, p) if v > 0} == {x: round(v, 3) for x, v in shares.items()}


def test_marks_alone_are_no_language(spark, model):
    got = L.infer(model, ["\u0301\u0302", "\u0e31 \u0301 5!", "e\u0301"])
    assert [g[0] == "und" for g in got] == [True, True, False]


def test_selection_skips_only_where_no_set_can_gain():
    rng = np.random.default_rng(4)
    for _ in range(40):
        ll = rng.normal(0, 3, (rng.integers(1, 12), 4))
        p = L.mixture(ll, np.ones(len(ll)), 4.0)
        best = ll.sum(axis=0).max()
        gain = max(L.expectation_maximisation(ll[:, [int(ll.sum(axis=0).argmax()), k]])[1] for k in range(4)) - best
        assert p.sum() == pytest.approx(1) and ((p > 0).sum() > 1) == (gain > 4.0)


def test_odd_rows(spark, model):
    got = rows(L.identify(odd(spark, ["lang_pred", "score", "proportions"]), model))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert len(got) == len(odd_rows())
    for i in (1, 2, 3, 9):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["proportions"]) == ("und", 0.0, None)
    assert by[5]["lang_pred"] == by[6]["lang_pred"] in model.langs
    assert L.identify(empty(spark), model).count() == 0
    kept = L.accepted(odd(spark, ["score"]), model)
    assert kept.columns[-1] == "score" and {r["doc_id"] for r in kept.collect()} & {1, 2, 3, 9} == set()
    none = L.train(empty(spark))
    assert {r["lang_pred"] for r in L.identify(odd(spark), none).collect()} == {"und"}


def test_a_text_with_more_words_than_the_table_has_places():
    """A text is one block, however many words it has: the table grows with it."""
    rng = np.random.default_rng(5)
    many = " ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (300, 6)))
    m = L.LanguageModel(["a", "b"], rng.normal(-3, 1, (L.BUCKETS, 2)).astype(np.float32))
    q = quality.QualityModel(rng.normal(size=quality.BUCKETS), 0.25, 0.5)
    want = str(L.infer(m, [many])), q.scores([many]).tolist()
    m._known, q._known = PieceTable(6), PieceTable(6)
    assert (str(L.infer(m, [many])), q.scores([many]).tolist()) == want
    assert str(L.infer(m, ["few words", many])) == str(L.infer(L.LanguageModel(m.langs, m.logp), ["few words", many]))


def test_held_out_quality(spark):
    from clashlens.llm.queries import op8_quality_classifier
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    got = [r for r in op8_quality_classifier(spark, BIG).collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.95


def test_quality_of_odd_rows(spark):
    rng = random.Random(0)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30)), 1) for i in range(0, 80, 2)]
    bad = [(i, " ".join(rng.choice(["###", "$$$", "zzz"]) for _ in range(30)), 0) for i in range(1, 80, 2)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    m = quality.train(df, df.select("doc_id", "quality"))
    got = {(r["doc_id"], round(r["score"], 9)) for r in quality.score(odd(spark, ["score", "label", "predicted"]), m).collect()}
    prior = round(m.prior, 9)
    assert {(1, prior), (2, prior), (3, prior)} <= got and len({s for i, s in got if i in (5, 6)}) == 1 and len([1 for i, _ in got if i == 7]) == 1
    s = m.scores(["beta alpha gamma beta", "### zzz $$$ ###"])
    assert s[0] > 0.7 > 0.3 > s[1]
    assert quality.score(empty(spark), m).count() == 0
    none = quality.train(empty(spark), df.select("doc_id", "quality"))
    assert [r["score"] for r in quality.score(odd(spark), none).collect()] == [0.5] * len(odd_rows())


def test_a_words_share_of_the_margin_adds_up(spark):
    margin = np.random.default_rng(0).normal(size=quality.BUCKETS)
    m = quality.QualityModel(margin, 0.25, 0.5)
    w = quality.words_of("one two two three")
    at = [k for x in [*w, quality.AGAIN] for k in quality.buckets_of(x)]
    assert m.scores(["One two two  three"])[0] == pytest.approx(1 / (1 + np.exp(-margin[at].mean() - 0.25)))


@pytest.fixture(scope="module")
def domains(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    return docs, mixing.train(docs, mixing.domains_of(spark.read.parquet(f"{BIG}/labels.parquet")))


def test_totals_match_targets(spark, domains):
    docs, model = domains
    m = mixing.mix(docs, model, {"good": 0.9, "poor": 0.08, "toxic": 0.02})
    got = m.documents.collect()
    assert len(got) == 1000 and min(r["rate"] for r in got) >= 0
    n = sum(r["n_tokens"] for r in got)
    for k, goal in (("good", 0.9), ("poor", 0.08), ("toxic", 0.02)):
        total = sum(r["n_tokens"] * r["rate"] * r["posterior"][k] for r in got)
        assert total == pytest.approx(m.totals[k]) and abs(total / n - goal) < 0.005
    assert all(sum(r["posterior"].values()) == pytest.approx(1) for r in got[:50])


def test_a_rare_domain_meets_its_target(spark):
    """4 of 2,000 texts are toxic: 0.2 % of the tokens."""
    names = ["good", "poor", "toxic"]
    at = {mixing.token_bucket(f"{x}word"): i for i, x in enumerate(names)}
    weights = np.zeros((5, 3))
    for row, b in enumerate(sorted(at)):
        weights[row, at[b]] = 60
    model = mixing.DomainModel(names, np.array(sorted(at)), weights)
    for poor in (200, 1000):
        kinds = ["toxic"] * 4 + ["poor"] * poor + ["good"] * (1996 - poor)
        docs = spark.createDataFrame([(i, f"{x}word " * 20) for i, x in enumerate(kinds)], "doc_id long, text string")
        m = mixing.mix(docs, model, {"good": 0.90, "poor": 0.08, "toxic": 0.02})
        assert all(m.totals[k] == pytest.approx(m.targets[k], rel=0.01) for k in m.targets)
        m = mixing.mix(docs, model, {"good": 1.02, "poor": 0.5, "toxic": 0.0}, of_own=True, max_rate=1.0)
        rate = {x: r["rate"] for x, r in zip(kinds, rows(m.documents))}
        assert rate["good"] == 1 and rate["poor"] == pytest.approx(0.5, abs=0.01) and rate["toxic"] < 0.01


@pytest.mark.parametrize("most", [np.inf, 1.0, 2.0])
def test_rates_equal_a_separate_solver(most):
    """The rates are those of plain projected descent on every document by itself, run for long."""
    for seed in range(6):
        rng = np.random.default_rng(seed)
        p, n = rng.dirichlet([0.3, 0.3, 0.1], 80), rng.integers(0, 100, 80).astype(float)
        big, gram = n.sum(), (p.T * n) @ p / n.sum()
        goal = rng.dirichlet([1, 1, 1]) * big * rng.uniform(0.3, 1.5)
        sums = lambda tried: np.array([mixing.sums_at(p, n, at, most) for at in tried])  # noqa: E731, B023
        at, totals, steps = mixing.descended(sums, gram, goal, big, n @ p, 1e-2, 1e-7)
        x, measure = np.ones(80), np.linalg.inv(gram)
        for _ in range(60_000):
            x = np.clip(x - 0.9 * (p @ (measure @ ((n * x) @ p - goal) / big) + 1e-2 * (x - 1)), 0, most)
        assert np.allclose(mixing.rates_at(p, at, most)[n > 0], x[n > 0], atol=1e-4) and np.allclose(totals, (n * x) @ p, atol=1e-2) and steps < 60


def test_a_result_that_is_no_minimum_is_an_error():
    wrong = lambda tried: np.full((len(tried), 13), 5.0)
    with pytest.raises(RuntimeError, match="off their minimum"):
        mixing.descended(wrong, np.eye(3) / 3, np.zeros(3), 10.0, np.ones(3), 1e-3, 1e-6)


def test_posteriors_of_held_out_texts(spark):
    """Trained without them, on the labels of sf0.1: toxic texts are told by words and by beginnings of words."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.train(docs, mixing.domains_of(labels))
    held = docs.join(mixing.domains_of(labels), "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    _, p = model.posteriors([r["text"] for r in held])
    said = [model.domains[i] for i in p.argmax(axis=1)]
    toxic = [(a == "toxic", r["domain"] == "toxic") for a, r in zip(said, held)]
    assert np.mean([a == r["domain"] for a, r in zip(said, held)]) > 0.97
    assert sum(a and b for a, b in toxic) > 0.88 * sum(b for _, b in toxic) and sum(a and not b for a, b in toxic) < 0.01 * len(toxic)
    for k, name in enumerate(model.domains):       # calibrated: the posteriors add up to the domain's share
        assert abs(p[:, k].mean() - np.mean([r["domain"] == name for r in held])) < 0.02


def test_a_text_without_tokens_has_the_label_shares(spark):
    docs = spark.createDataFrame([(i, f"tok{i % 2} common words here") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(60)] + [(99, "c")], "doc_id long, domain string")
    model = mixing.train(docs, labels)
    assert model.domains == ["a", "b"] and model.posteriors([None, "", "  "])[0].tolist() == [0, 0, 0]
    n, p = model.posteriors(["tok1 x", "tok0 x"])
    assert n.tolist() == [2, 2] and p[0, 0] > 0.8 and p[1, 1] > 0.8


def test_mixing_odd_rows(spark, domains):
    _, model = domains
    m = mixing.mix(odd(spark, ["rate", "n_tokens"]), model, {"good": 1, "poor": 1, "toxic": 1})
    got = rows(m.documents)
    assert len(got) == len(odd_rows()) and [r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert mixing.mix(empty(spark), model, {"good": 1.0}).documents.count() == 0
    none = mixing.train(empty(spark), spark.createDataFrame([(1, "good")], "doc_id long, domain string"))
    assert {round(v, 6) for r in mixing.mix(odd(spark), none, {"a": 1, "b": 3}).documents.collect() for v in r["posterior"].values()} == {0.5}
    kept = mixing.drawn(odd(spark, ["kept_id"]), m)
    assert kept.columns == odd(spark, ["kept_id"]).columns and None in {r["doc_id"] for r in kept.collect()}
