"""Operator 12 against scoring every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from clashlens.llm import lexical_search as S
from tests.llm.helpers import SF, empty, odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, most=20):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(1, words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_tables_equal_scoring_everything(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(S.search(docs, items)) == want


def test_sql_twin(spark):
    from clashlens.llm.queries import QUERIES
    from clashlens.llm.sql import ORACLES
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = sorted(con.sql(ORACLES["op12_ranked_lexical_search"]).fetchall(), key=str)
    assert got(QUERIES["op12_ranked_lexical_search"](spark, SF)) == want


ODD_ITEMS = [(1, None), (2, ""), (3, "!!! ..."), (4, "word a b"), (5, "word a b"), (5, "no id at all"), (None, "12 été 'll X"), (6, "notinanydocument"),
             (7, "a a a a b 123")]


@pytest.mark.parametrize("query_bytes", [1 << 20, 10])
def test_odd_rows(spark, query_bytes):
    docs = odd(spark, clash=("query", "terms", "rank", "score"))
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string").selectExpr("*", "'x' AS query", "0 AS rank")
    assert got(S.search(docs, items, query_bytes=query_bytes)) == plain_search(pairs, ODD_ITEMS)
    assert got(S.search(empty(spark), items)) == [] and got(S.search(docs, items.limit(0))) == []


def test_long_text_in_pieces(spark):
    text = " ".join(f"w{i % 700}" for i in range(4000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, "é" * 9000)], "doc_id long, text string")
    terms, _ = S.query_terms(["w1 w2 w699 zzz"])
    rows = {r.doc_id: r for r in S.term_counts(docs, terms, limit=300).collect()}
    whole = {r.doc_id: r for r in S.term_counts(docs, terms).collect()}
    assert rows == whole and rows[1].n == 4000 and sum(rows[1].tfs) == 6 + 6 + 5 and rows[3].n == 1


def shard_of(rng, docs, terms, null=0):
    n = rng.integers(1, 400, docs)
    each = [rng.choice(terms, rng.integers(0, min(terms, 40)), replace=False) for _ in range(docs)]
    ids = rng.permutation(docs * 3)[:docs]
    flags = np.zeros(docs, bool)
    flags[:null] = True
    tf = rng.integers(1, 5, sum(map(len, each)))
    return S.Shard(ids, flags, n, np.array([len(e) for e in each]), np.concatenate(each), tf, 1000, 150_000)


def test_range_maxima_equal_slices():
    s = shard_of(np.random.default_rng(1), 300, 12)
    rng = random.Random(2)
    for _ in range(500):
        t = rng.randrange(12)
        lo, hi = np.searchsorted(s.key, [t * s.size, (t + 1) * s.size])
        a = rng.randrange(lo, hi + 1)
        z = rng.randrange(a, hi + 1)
        v, at = s.range_maximum(np.array([a]), np.array([z]))
        assert v[0] == (s.impact[a:z].max() if z > a else 0)
        assert z == a or (a <= at[0] < z and s.impact[at[0]] == v[0])


@pytest.mark.parametrize("wide", [1024, 2])
def test_intervals_equal_scoring_everything(monkeypatch, wide):
    monkeypatch.setattr(S, "WIDE", wide)
    for seed in range(12):
        rng = np.random.default_rng(seed)
        s = shard_of(rng, 200, 50, null=3)
        terms = np.sort(rng.choice(50, rng.integers(1, 30), replace=False))
        weights = rng.integers(0, 4, len(terms)) * (1000 if seed % 2 else 1)
        if seed % 3 == 0:
            s.impact = s.impact // 100_000      # many ties
            s._tables()
        dense = np.zeros(s.size, np.int64)
        for t, w in zip(terms, weights):
            here = s.key // s.size == t
            dense[s.key[here] % s.size] += w * s.impact[here]
        want = sorted((-x, s.id_at(i)) for i, x in enumerate(dense.tolist()) if x > 0)[:20]
        start = want[5:8]                       # a list that has documents already keeps the better ones
        assert s.search(terms, weights, [], 20) == want
        assert s.search(terms, weights, list(start), 20) == sorted(want + start)[:20]


def test_shards_cut_rows_by_postings(spark):
    import pyarrow as pa
    b = [pa.record_batch({"doc_id": list(range(7)), "n": [1] * 7, "terms": [[0] * k for k in (3, 9, 0, 1, 1, 1, 20)]}) for _ in range(2)]
    parts = list(S._shards(iter(b), 5))
    assert [x.column(0)[i].as_py() for p in parts for x in p for i in range(x.num_rows)] == list(range(7)) * 2
    assert max(sum(len(t) for x in p for t in x.column(2).to_pylist()) for p in parts) <= 25
