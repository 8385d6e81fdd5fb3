from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clashlens.llm import token_codes, token_count
from clashlens.llm.queries import tokenizer_file
from clashlens.llm.transducer import CHUNK, FRESH, MARKS, NEXT, WIDTH, PieceTable, run_chunks
from tests.llm.helpers import SF, empty, odd, odd_rows, rows

PATH = tokenizer_file()


@pytest.fixture(scope="module")
def library():
    return token_count.load_tokenizer(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_count.Counter(PATH, token_count.compiled_classes(PATH))


@given(st.lists(st.text(alphabet=" '  \n\t!stmdrvel'aé1٣漢🙂S-\r|<>endoftx", max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_counts_equal_the_library(library, counter, texts):
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want


def test_long_pieces_and_special_strings(library, counter):
    texts = ["ab" * 9000, "=-=-" * 3000, " " * 5000, "<|endoftext|>" * 3, "a<|endoftext|> <|endoftext", "漢字" * 700, ""]
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_starts_over_when_full(library, counter):
    fresh = token_count.Counter(PATH, counter.classes)
    fresh.bpe.LIMIT, fresh.known = 50, PieceTable(bits=6)
    texts = [f"word{i} other{i * 7} x" for i in range(400)]
    got = [int(fresh.count([t])[0]) for t in texts]
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_text_with_more_pieces_than_the_table_has_places(library, counter):
    text = " ".join(f"word{i} other{i * 7}" for i in range(400))
    want = library.encode(text, add_special_tokens=False).ids
    fresh = token_count.Counter(PATH, counter.classes)
    fresh.known = PieceTable(bits=6)
    assert [int(fresh.count([t])[0]) for t in (text, "word1", text)] == [len(want), len(library.encode("word1").ids), len(want)]
    enc = token_codes.Encoder(PATH, counter.classes)
    enc.known = PieceTable(bits=6)
    assert enc.encode([text], 2)[0].tolist() == [*want, 2]


def test_chunk_maps_compose_to_one_sequential_run():
    classes = np.random.default_rng(3).integers(0, 11, 40 * CHUNK).astype(np.uint8)
    state, want = FRESH, []
    for c in classes.tolist():
        want.append(int(MARKS[state * WIDTH + c]))
        state = int(NEXT[state * WIDTH + c])
    assert run_chunks(classes).tolist() == want


def test_token_counts_query(spark, library):
    from clashlens.llm.queries import op5_token_counts
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs}
    got = op5_token_counts(spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_token_counts_of_odd_rows(spark, library):
    got = token_count.token_counts(odd(spark, ["n_tokens", "n_bytes"]), PATH).collect()
    key = lambda x: (x[0] is not None, x)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows()]
    assert sorted(((r[0], r[1], r[2]) for r in got), key=lambda x: (x[0] or 0, x[1])) == sorted(want, key=lambda x: (x[0] or 0, x[1])) and key
    assert token_count.token_counts(empty(spark), PATH).count() == 0


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_segment_gives_back_every_token(docs):
    flat = [x for d in docs for x in d]
    s = token_codes.Segment(token_codes.encode_segment(np.arange(len(docs)), np.array([len(d) for d in docs]), np.array(flat, np.uint32)))
    assert [s.document(k).tolist() for k in range(s.n_docs)] == docs
    assert [s.token(i) for i in range(0, len(flat), 3)] == flat[::3]
    assert s.tokens(len(flat) // 3, len(flat)).tolist() == flat[len(flat) // 3:]


def test_random_access_across_rank_blocks():
    ids = np.random.default_rng(0).integers(0, 70_000, 5000).astype(np.uint32)
    s = token_codes.Segment(token_codes.encode_segment(np.array([9]), np.array([5000]), ids))
    for i in (0, 511, 512, 513, 1023, 1024, 4095, 4999):
        assert s.token(i) == ids[i]


def test_round_trip_query(spark, library):
    from clashlens.llm.queries import op7_token_id_output
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, []
    for r in docs:
        x = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(x), crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in op7_token_id_output(spark, SF).collect()) == want


def test_round_trip_of_odd_rows(spark, library):
    path = token_codes.shared_path(spark, "test")
    token_codes.write(odd(spark, ["bucket", "seg"]), PATH, path, buckets=3)
    got = sorted(token_codes.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    assert [r["ids"] for r in got] == [[*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in order]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert rows(token_codes.round_trip(empty(spark), PATH)) == []
