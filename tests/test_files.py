"""JSON and whole-text inputs, batch and stream: broken rows are rejects, none is lost (S-3, S-4)."""

import json

import pytest

from clashlens.config import MISSING_PAIR_REASON, MISSING_TEXT_REASON
from clashlens.plans.document_check import run_document_check
from clashlens.sources import files
from clashlens.sources.documents import valid_only
from clashlens.streaming.checks import stream_doc_reports, stream_pair_reports

DOC_LINES = [json.dumps({"doc_id": 1, "text": "  The sky is blue. The sky is not blue.\n"}), json.dumps({"doc_id": 2, "text": " \t"}), json.dumps({"doc_id": 3}),
             json.dumps({"text": "No number. Here."}), "{broken", '["an", "array"]', json.dumps({"doc_id": 4, "text": None}), '{"doc_id": "x", "text": "bad id"}',
             json.dumps({"doc_id": 5, "text": "Übung macht.  ", "more": [1, {"a": 2}]}), "just words", json.dumps({"doc_id": 6, "text": 7})]
PAIR_LINES = [json.dumps({"pair_id": 1, "sentence1": " The sky is blue.", "sentence2": "The sky is not blue."}), json.dumps({"pair_id": 2, "sentence1": "a", "sentence2": " "}),
              json.dumps({"pair_id": 3, "sentence2": "b"}), "{", json.dumps({"sentence1": "Cats purr.", "sentence2": "Engines roar loudly."})]


def write(path, *texts):
    path.mkdir()
    for k, t in enumerate(texts):
        (path / f"part-{k}.json").write_text(t, encoding="utf-8")
    return str(path)


def document_rows(df):
    return sorted((r.text, r.error or "", r.record or "") for r in df.collect())


WANT_DOCS = sorted([("The sky is blue. The sky is not blue.", "", ""), ("", MISSING_TEXT_REASON, ""), ("", MISSING_TEXT_REASON, ""), ("No number. Here.", "", ""),
                    ("", files.INVALID_JSON_REASON, "{broken"), ("", MISSING_TEXT_REASON, ""), ("Übung macht.", "", ""),
                    ("", files.INVALID_JSON_REASON, "just words"), ("7", "", "")])


def test_json_documents(spark, tmp_path):
    path = write(tmp_path / "in", "\n".join(DOC_LINES[:6]) + "\n", "\n".join(DOC_LINES[6:]))
    got = files.json_documents(spark, path)
    rows = document_rows(got)
    # an array and a wrong id are objects of another schema: rejects with their text, whatever was read of them
    odd = [r for r in rows if r[2] in ('["an", "array"]', '{"doc_id": "x", "text": "bad id"}')]
    assert len(rows) == len(DOC_LINES) and len(odd) == 2 and all(r[1] == files.INVALID_JSON_REASON for r in odd)
    assert sorted(set(rows) - set(odd)) == sorted(set(WANT_DOCS)) and len(rows) - 2 == len(WANT_DOCS)
    ids = {r.text: r.doc_id for r in got.collect() if r.error is None}
    assert ids["7"] == 6 and ids == {r.text: r.doc_id for r in files.json_documents(spark, path).collect() if r.error is None} and None not in ids.values()
    assert valid_only(got).count() + files.rejects(got).count() == len(DOC_LINES)


def test_json_pairs(spark, tmp_path):
    path = write(tmp_path / "in", "\n".join(PAIR_LINES))
    got = sorted((r.sentence1, r.sentence2, r.error or "", r.record or "") for r in files.json_pairs(spark, path).collect())
    assert got == sorted([("The sky is blue.", "The sky is not blue.", "", ""), ("a", "", MISSING_PAIR_REASON, ""), ("", "b", MISSING_PAIR_REASON, ""),
                          ("", "", files.INVALID_JSON_REASON, "{"), ("Cats purr.", "Engines roar loudly.", "", "")])


def test_whole_json_files_and_text_files(spark, tmp_path):
    path = write(tmp_path / "a", json.dumps({"doc_id": 1, "text": "One.\nTwo."}, indent=2), "{\n broken\n", json.dumps([{"doc_id": 2, "text": "x"}, {"doc_id": 3, "text": ""}]))
    got = sorted((r.doc_id, r.text, r.error) for r in files.json_documents(spark, path, whole_files=True).collect() if r.record is None)
    assert got == [(1, "One.\nTwo.", None), (2, "x", None), (3, "", MISSING_TEXT_REASON)]
    assert [r.error for r in files.json_documents(spark, path, whole_files=True).collect() if r.record is not None] == [files.INVALID_JSON_REASON]
    path = write(tmp_path / "b", "A text.\n\nWith two paragraphs.\n", " \n", "A text.")
    rows = files.text_documents(spark, path).collect()
    assert sorted((r.text, r.error or "") for r in rows) == [("", MISSING_TEXT_REASON), ("A text.", ""), ("A text.\n\nWith two paragraphs.", "")]
    assert len({r.doc_id for r in rows}) == 3


@pytest.mark.parametrize("source", ["json", "text"])
def test_document_stream_of_files(spark, tmp_path, source):
    path = write(tmp_path / "in", *(["\n".join(DOC_LINES)] if source == "json" else ["The sky is blue. The sky is not blue.", "  ", "One."]))
    stream_doc_reports(spark, path, str(tmp_path / "out"), source=source).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    bad = spark.read.parquet(str(tmp_path / "out-rejected")).collect()
    assert len(out) + len(bad) == (len(DOC_LINES) if source == "json" else 3) and all(r.error for r in bad)
    assert max(len(r.contradictions) for r in out) == 1
    if source == "json":
        assert {"{broken", "just words"} <= {r.record for r in bad}


def test_pair_stream_of_json(spark, tmp_path):
    path = write(tmp_path / "in", "\n".join(PAIR_LINES))
    stream_pair_reports(spark, path, str(tmp_path / "out"), source="json").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == len(PAIR_LINES) and sorted(r.error or "" for r in out) == sorted(
        ["", "", MISSING_PAIR_REASON, MISSING_PAIR_REASON, files.INVALID_JSON_REASON]) and [r.record for r in out if r.record] == ["{"]


def test_batch_job_over_json(spark, tmp_path):
    path = write(tmp_path / "in", "\n".join(DOC_LINES))
    run_document_check(files.json_documents(spark, path), str(tmp_path / "out"))
    kept, bad = (spark.read.parquet(str(tmp_path / "out" / x)).count() for x in ("doc_report", "rejected"))
    assert kept + bad == len(DOC_LINES) and spark.read.parquet(str(tmp_path / "out" / "contradictions")).count() == 1
