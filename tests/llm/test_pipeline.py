import os
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from clashlens.llm import language_id, mixing, token_count
from clashlens.llm.queries import tokenizer_file
from clashlens.llm.common import saved
from tests.llm.helpers import SF, odd_rows
from tests.llm.test_jaccard_join import brute
from tests.llm.test_text_ops import leaks


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    model = language_id.train(docs)
    got = language_id.infer(model, [t for _, t in left])
    left = [d for d, (lang, score, _) in zip(left, got) if lang != "und"]
    first = {i for i, _, c in brute(left, 5, 80) if i == c}
    left = [d for d in left if d[0] in first]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in leaks(left, items) if r[-1]}
    left = [d for d in left if d[0] not in dirty]
    here = spark.createDataFrame(left, "doc_id long, text string")
    domains = mixing.train(docs, mixing.domains_of(spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r["doc_id"] for r in mixing.drawn(here, mixing.mix(here, domains, corpus_pipeline.KEEP, of_own=True, max_rate=1.0)).collect()}
    marks = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, _ in left if i in marks and marks[i]["quality"] == 1 and not marks[i]["toxic"]}
    assert dirty and len(good & kept) > 0.95 * len(good)
    insults = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}
    toxic = {i for i, t in left if insults & set(t.lower().replace(".", " ").replace(",", " ").split())}
    assert toxic and len(toxic & kept) < 0.5 * len(toxic)
    tok, at, want = token_count.load_tokenizer(tokenizer_file()), 0, []
    for i, t in left:
        if i in kept:
            x = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
            want.append((i, at, len(x), crc32(x.tobytes())))
            at += len(x)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_toxic_documents_go_and_clean_ones_stay(spark):
    """With the labels of a whole small table: what the mixing stage draws, by the labels of texts held out of the fit."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    kept = {r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, sf).select("doc_id").collect()}
    toxic, good = ([r["doc_id"] in kept for r in held if (r["toxic"], r["quality"]) in want] for want in ({(1, 0), (1, 1)}, {(0, 1)}))
    assert np.mean(toxic) < 0.5 and np.mean(good) > 0.95


def odd_tables(spark, path, rows):
    """A folder of tables: the given documents, with clashing columns, and tables of the other inputs that hold nothing."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("digest", "h1", "kept_id", "rate", "node", "bucket", "text_"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] != 9] + [(20, "same words here and there for two texts", "en", None, None), (20, "a second text under one number, quite another", "en", None, None),
            (21, "\u0301\u0301", "fr", "b", 2), (22, "12 34", "de", "b", 5)]
    sf = odd_tables(spark, tmp_path / "odd", rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, columns = saved(stage(spark, docs, sf), name), docs.columns
        assert docs.columns == columns, name
        left = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect())
        want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
        if name != "language_id":       # 6 repeats 5, and 7 is there twice
            want = [r for k, r in enumerate(want) if r[0] != 6 and r not in want[:k]]
        whole = sorted((str(r[0]), r[1]) for r in want)
        if name == "mixing":            # of three domains, as likely as each other, one stays whole and one by half
            assert set(left) <= set(whole) and ("None", "no id here at all") in left
        else:
            assert left == whole, name
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == len(left) and sorted(r["start"] for r in out)[0] == 0
    nothing = odd_tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, nothing).collect() == []


def test_intermediate_tables_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    folder = corpus_pipeline._folders[-1]
    assert any(folder in f for f in first.inputFiles()) or os.path.isdir(folder)
    ids = saved(first, "result")
    corpus_pipeline.decontamination_stage(spark, ids, SF)
    assert not os.path.exists(folder) and ids.count() > 0 and len(corpus_pipeline._folders) == 1
