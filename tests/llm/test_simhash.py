"""Operator 13 against brute force: every pair of fingerprints compared bit by bit."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clashlens.llm import simhash
from tests.llm.helpers import SF, empty, odd, rows

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = BLANK.findall(low)
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Index of the first member of each one's group."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(fps))]


def expected(pairs):
    fps = [plain_fingerprint(t) for _, t in pairs]
    group = plain_components(fps)
    least = {}
    for (d, _), g in zip(pairs, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{f:016x}", least.get(g)) for (d, _), f, g in zip(pairs, fps, group)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == expected(pairs)


def test_odd_rows(spark):
    docs = odd(spark, clash=("fp", "key", "fingerprint", "component_id", "comp"))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == expected(pairs)
    assert simhash.near_duplicates(empty(spark)).collect() == []
    zero = {r.doc_id: r for r in rows(simhash.near_duplicates(docs)) if r.doc_id in (1, 2, 3)}
    assert {r.component_id for r in zero.values()} == {1} and zero[3].fingerprint == "0" * 16


def test_only_ascii_letters_fold_and_only_six_blanks_split():
    for text in ("ΟΔΟΣ a B", "İ KK x", "a b c d", "a\x1cb c\x0bd e", "A  b\tC\nd"):
        assert simhash.simhash(text) == plain_fingerprint(text)


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 100)
    text = " ".join(str(i * i) for i in range(1234))
    assert simhash.simhash(text) == plain_fingerprint(text)


def test_pivots_resolve_every_segment():
    parts = list(simhash.SEGMENTS) + [q for lo, hi in simhash.SEGMENTS for q in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    for lo, hi in parts:
        t = simhash.pivot_table(lo, hi)
        assert len(np.unique(t, axis=0)) == len(t)


def test_coordinates_are_hamming_distances_and_bound_them():
    fps = np.random.default_rng(3).integers(0, 1 << 63, 50, dtype=np.uint64)
    c = simhash.coordinates(fps)
    assert (c == np.bitwise_count(fps[:, None] ^ simhash.PIVOTS[None, :])).all()


@pytest.mark.parametrize("hot", [2048, 3])
def test_near_fingerprints_meet_however_crowded_a_key_is(spark, hot):
    """Balls of fingerprints around few centres: chains of links, keys with very many members."""
    rng = np.random.default_rng(11)
    fps = []
    for centre in rng.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            f = centre
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.linked_fingerprints(nodes, hot).collect()]
    place = {f: i for i, f in enumerate(fps)}
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        x, y = sorted((root(place[a]), root(place[b])))
        up[y] = x
    assert [root(i) for i in range(len(fps))] == plain_components(fps)


def test_spanning_links_lose_no_link_between_large_groups(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 9, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, 300).astype(np.uint64)))
    size = np.array([len(fps)])
    a, b = simhash.spanning_links(fps, size)
    group = plain_components(fps.tolist())
    assert len(b) == len(fps) - len(set(group))


def test_query_keeps_every_row(spark):
    from clashlens.llm.queries import QUERIES
    out = QUERIES["op13_simhash_near_dedup"](spark, SF)
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.where(F.col("component_id") > F.col("doc_id")).count() == 0
