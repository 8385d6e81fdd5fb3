"""The correctness gate in miniature: a representative subset of queries equals its DuckDB twin at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
KEYS = ["sentences", "candidate_pairs", "doc_report", "pair_report", "candidate_pairs_dense",
        "method_comparison", "training_shards"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canon(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(None if v != v else v for v in row) for row in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, con, key):
    got = canon(E.queries()[key](spark, SF).toPandas())
    want = canon(con.execute(E.oracle_sql()[key]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
