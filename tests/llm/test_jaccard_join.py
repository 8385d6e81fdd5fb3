import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from clashlens.llm import jaccard_join as J
from tests.llm.helpers import SF, empty, odd, rows, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(pairs, n, percent):
    """(id, set size, component) by comparing all sets that share a shingle."""
    import re
    sets, inv = [], defaultdict(list)
    for k, (_, t) in enumerate(pairs):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
        for x in sets[-1]:
            inv[x].append(k)
    up = list(range(len(pairs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for k, s in enumerate(sets):
        for j in {j for x in s for j in inv[x] if j < k}:
            i = len(s & sets[j])
            if 100 * i >= percent * (len(s) + len(sets[j]) - i):
                a, b = sorted((root(k), root(j)))
                up[b] = a
    low = {}
    for k, (i, _) in enumerate(pairs):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(pairs))


def edited(rng, text, share):
    w = text.split()
    for _ in range(int(share * len(w))):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out, passage = [], words(60, 5000)
    for g in range(12):
        base = words(rng.choice([3, 5, 7, 12, 30, 120, 500]), g * 700, "w")
        for _ in range(rng.randrange(1, 9)):
            out.append(edited(rng, base, rng.choice([0, 0, 0.005, 0.01, 0.02, 0.04, 0.1])))
    out += [words(rng.randrange(5, 80), 9000 + 90 * k, "v") + " " + passage for k in range(40)]       # a shared passage
    return list(enumerate(out))


def test_components_equal_brute_force(spark, corpus):
    for n, percent in ((4, 85), (5, 80)):
        got = J.similarity_components(spark.createDataFrame(corpus, "doc_id long, text string"), n, percent).collect()
        assert sorted(tuple(r) for r in got) == brute(corpus, n, percent)


def test_tiles_of_a_large_hub_are_complete(spark):
    rng = random.Random(2)
    base = words(300)
    docs = [(i, edited(rng, base, rng.uniform(0, 0.12))) for i in range(60)]
    sets = J.shingle_sets(pa.array([t for _, t in docs]), 4)
    grouped = spark.createDataFrame([(0, i, i, len(s), bytearray(J.parity_sketch(s))) for (i, _), s in zip(docs, sets)],
                                    "hub long, node long, comp long, size long, sketch binary")
    found = {tuple(r) for r in J.compared_in_tiles(grouped, 85, 100, block=7).collect()}
    linked = {(i, j) for j in range(60) for i in range(j)
              if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)}
    assert linked and linked <= found
    span = {tuple(r) for r in J.compared_in_tiles(grouped, 85, 100, block=100, spanning=True).collect()}
    assert span <= found and len(span) < 60      # one tile: as connected as all pairs are

    def groups(pairs):
        up = list(range(60))
        for _ in range(60):
            for x, y in pairs:
                up[x] = up[y] = min(up[x], up[y])
        return up
    assert groups(span) == groups(found)


def test_components_do_not_depend_on_the_hub(spark):
    """Near copies of a text that isn't there itself: any two may be too far apart, all are one group."""
    rng = random.Random(7)
    base = words(200)
    docs = [(i, edited(rng, base, 0.01)) for i in range(120)]
    want = brute(docs, 4, 85)
    assert 1 < sum(c == 0 for *_, c in want) and sorted(tuple(r) for r in J.similarity_components(
        spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()) == want


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_key_under_any_allocation(seed):
    rng = np.random.default_rng(seed)
    frequent = np.sort(rng.integers(0, 1 << 62, 200).astype(np.uint64))
    for _ in range(150):
        size = int(rng.integers(6, 200))
        hot = rng.choice(frequent, min(len(frequent), int(size * rng.uniform(0, 1))), replace=False)
        a = np.unique(np.concatenate([hot, rng.integers(0, 1 << 62, size - len(hot)).astype(np.uint64)]))
        h = J.most_differences(len(a), 85, 100)
        drop = int(rng.integers(0, h + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 62, h - drop).astype(np.uint64)]))
        a, b = sorted((a, b), key=len)
        i = len(np.intersect1d(a, b))
        if 100 * i < 85 * (len(a) + len(b) - i):
            continue
        k = J.band(len(a))
        need = J.most_differences(J.band_start(k + 1) - 1, 85, 100) + 1
        m = int(rng.integers(max(1, -(-need // 2)), need + 8))
        plan = m, int(rng.integers(max(0, need - m), m + 1))
        ka, kb = (J.keys_of(x, k, plan, 85, 100, frequent) for x in (a, b))
        assert np.array_equal(a, b) or len(np.intersect1d(ka, kb))


def test_sketch_never_overstates_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 62, int(rng.integers(0, 900))).astype(np.uint64)]))
        x, y = J._words([J.parity_sketch(a), J.parity_sketch(b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_query_equals_brute_force(spark):
    from clashlens.llm.queries import op2_ngram_jaccard_join
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in op2_ngram_jaccard_join(spark, SF).collect()) == brute(docs, 4, 85)


def test_odd_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.similarity_components(odd(spark, ["n_shingles", "node"]), 4, 85).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (7, 1, 7), (None, 2, None)} <= got
    assert {c for i, _, c in got if i in (5, 6)} == {5}
    assert J.similarity_components(empty(spark)).count() == 0
    kept = J.one_of_each(odd(spark, ["kept_id"]))
    assert [r["doc_id"] for r in rows(kept)] == [None, 1, 2, 3, 4, 5, 7, 8, 9] and kept.columns[-1] == "kept_id"


def test_rows_of_one_id_are_compared_each_by_its_text(spark):
    a, b, c = words(40, 0), words(40, 100), words(40, 200)
    df = lambda rows_: spark.createDataFrame(rows_, "doc_id long, text string")
    kept = lambda rows_: sorted((r["doc_id"], r["text"]) for r in J.one_of_each(df(rows_)).collect())
    assert kept([(1, a), (1, b), (2, b)]) == sorted([(1, a), (1, b)])
    assert kept([(1, a), (2, b), (2, c), (3, c), (3, c), (2, b)]) == sorted([(1, a), (2, b), (2, c)])
    assert kept([(4, ""), (4, ""), (5, a), (5, a)]) == [(4, ""), (4, ""), (5, a)]
    got = sorted(tuple(r) for r in J.similarity_components(df([(3, a), (3, b), (2, b), (9, a), (9, c)])).collect())
    assert got == [(2, 37, 2), (3, 37, 2), (3, 37, 3), (9, 37, 3), (9, 37, 9)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 300) for i in range(20)]
    got = {r["node"]: r["comp"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[300] == 200
