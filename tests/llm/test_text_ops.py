import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clashlens.llm import decontaminate as D
from clashlens.llm import fingerprint, line_dedup, warc
from tests.llm.helpers import SF, empty, odd, odd_rows, rows, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, window=10):
    where = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w and i is not None else ():
            where[tuple(w[k:k + n])].add(str(i))
    out = []
    for i, t in docs:
        w, found = WORD.findall((t or "").translate(LOWER)), set()
        hit = [False] * len(w)
        for n in {len(x) for x in where}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in where:
                    found |= where[tuple(w[k:k + n])]
                    hit[k:k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(k, words(rng.choice([1, 2, 4, 9, 10, 11, 30]), 40 * k)) for k in range(30)]
    items += [(7, "Zürich ÉTÉ straße"), (50, None), (51, " .,! "), (None, words(12, 0)), (3, words(12, 120)), (53, words(10, 120))]
    docs = []
    for i in range(80):
        w = words(rng.randrange(0, 60), 5000 + 60 * i).split()
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1] or ""
            part = t.upper().split() if rng.random() < 0.3 else t.split()
            a = rng.randrange(0, max(1, len(part) - 8))
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[a:a + rng.randrange(1, 25)]
        docs.append((i, rng.choice([" ", "  ", ", ", "\n"]).join(w)))
    docs += [(90, "in zürich été straße"), (91, "in zürich ÉTÉ strasse"), (92, "Zürich ÉTÉ straße"), (93, None), (94, "")]
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == leaks(docs, items)
    assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, words(10, 4000), "x"), (2, "123 456", "x")], "item_id long, text string, id string")
    docs = odd(spark, ["id", "digest", "start", "n_hit"])
    got = sorted((tuple(r) for r in D.report(docs, items).collect()), key=str)
    assert got == leaks([r[:2] for r in odd_rows()], [(1, words(10, 4000)), (2, "123 456")])
    assert sorted(str(r["doc_id"]) for r in D.clean(docs, items).collect()) == sorted(str(r[0]) for r in odd_rows() if r[0] not in (5, 6, 9))
    assert D.report(empty(spark), items).count() == 0 and not any(r["contaminated"] for r in D.report(docs, items.limit(0)).collect())


def test_decontamination_tells_letters_as_the_exact_words_do(spark):
    """Greek sigmas, dotted and dotless i, the Kelvin sign: equal but for A-Z is equal, whatever stands between the words."""
    tail = "ββ γγ δδ εε ζζ ηη θθ ιι"
    items = [(1, f"ΟΔΟΣ.αα {tail}"), (2, "İstanbul ISPARTA ığdır izmir a1 a2 a3 a4 a5 a6"), (3, "5 \u212a 6 k b1 b2 b3 b4 b5 b6"), (4, "ΣΑΣ'ς"), (5, "K\u0307ΑΣ")]
    docs = [(1, f"x ΟΔΟΣ αα {tail}"), (2, f"ΟΔΟΣ,\u0020αα {tail} ΣΑΣ ς"), (3, f"οδος αα {tail}"), (4, f"ΟΔΟσ αα {tail}"), (5, "İSTANBUL isparta ığdır IZMIR a1 a2 a3 a4 a5 a6"),
            (6, "i̇stanbul isparta ığdır izmir a1 a2 a3 a4 a5 a6"), (7, "5 k 6 k b1 b2 b3 b4 b5 b6"), (8, "5 \u212a 6 K b1 b2 b3 b4 b5 b6"), (9, "ςας ς"), (10, "k\u0307ΑΣ."),
            (11, "K\u0307ας"), (12, f"ΟΔΟΣ:αα.{tail.replace(' ', '.')}")]
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == leaks(docs, items)
    assert {r["doc_id"] for r in got if r["contaminated"]} == {1, 2, 5, 8, 10, 12}


def test_folding_changes_every_character_by_itself(spark):
    """Over all code points and several neighbours, so that equal words have equal folded words."""
    import pyarrow as pa
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    alone = spark.createDataFrame(pa.table({"text": chars})).select("text", D.folded("text").alias("f"))
    small = {r["text"]: r["f"] for r in alone.collect()}
    around = ("a{}b", "a{}", "{}a", "I{}\u0307", "Α{} ", "{}\u0307", "Σ{}Σ", "\u0301{}.", "{0}{0}")
    texts = [form.format(c) for a in range(0, len(chars), 997) for form in around for c in chars[a:a + 997:7]]
    joined = ["".join(texts[a:a + 5000]) for a in range(0, len(texts), 5000)]
    for r in spark.createDataFrame(pa.table({"text": joined})).select("text", D.folded("text").alias("f")).collect():
        assert r["f"] == "".join(map(small.get, r["text"]))


def test_winnowing_guarantees_shared_windows():
    """Any 10 shared words hold one 5-gram that both texts select."""
    rng = random.Random(0)
    for _ in range(50):
        shared = [rng.random() for _ in range(10)]
        picks = []
        for _ in range(2):
            w = [rng.random() for _ in range(rng.randrange(9))] + shared + [rng.random() for _ in range(rng.randrange(9))]
            grams = [hash(tuple(w[i:i + 5])) for i in range(len(w) - 4)]
            picks.append({min(grams[i:i + 6]) for i in range(len(grams) - 5)})
        assert picks[0] & picks[1]


def next_texts(docs):
    order = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]


def shingles(t):
    w = [x for x in re.split(r"\s+", t.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark):
    from clashlens.llm.queries import op9_document_fingerprints
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in op9_document_fingerprints(spark, SF).collect()}
    by_text, errors = defaultdict(set), []
    for i, t, nxt in next_texts(docs):
        k = len(t) // 4
        changed = t[:len(t) - k] + nxt[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        by_text[t].add(r["fingerprint"])
        a, b = shingles(t), shingles(changed)
        if min(len(a), len(b)) > 400:
            errors.append(r["near_edited"] - len(a & b) / min(len(a), len(b)))
        assert 0 <= r["near_next"] <= 1 and (r["near_next"] == 1 if nxt == t else True)
    assert all(len(f) == 1 for f in by_text.values())
    assert errors and max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.05


def plain_sketch(t):
    """The hashes of the shingles, word after word seeded by the last one, that lie in the lowest quarter."""
    import xxhash
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if x]
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i:i + 5]:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(x for x in out if x < fingerprint.THRESHOLD) or sorted(out)[:1]


def test_fingerprints_equal_plain_hashing(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + [(10**6, ""), (10**6 + 1, "two words")]
    df = fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.withColumn("back", fingerprint.read_back("fingerprint")).collect()}
    share = lambda a, b: 1.0 if not a and not b else len({*a} & {*b}) / min(len(a), len(b)) if a and b else 0.0
    for i, t, nxt in next_texts(docs):
        r, own = got[i], plain_sketch(t)
        changed = plain_sketch(t[:len(t) - len(t) // 4] + nxt[:len(t) // 4])
        assert r["back"] == own and r["fingerprint"] == "".join(f"{x % (1 << 64):016X}" for x in own)
        assert r["edited_fingerprint"] == "".join(f"{x % (1 << 64):016X}" for x in changed) and r["n_kept"] == sum(x < fingerprint.THRESHOLD for x in own)
        assert r["near_edited"] == share(own, changed) and r["near_next"] == share(own, plain_sketch(nxt))


def test_fingerprints_of_odd_rows(spark):
    got = fingerprint.fingerprints(odd(spark, ["bucket", "guard", "own", "next"])).collect()
    want = Counter((i, len(t), hashlib.sha256((t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]).encode()).hexdigest())
                   for i, t, nxt in next_texts([r[:2] for r in odd_rows()]))
    assert Counter((r[0], r[1], r[2]) for r in got) == want
    assert {(r["fingerprint"] == "") for r in got if r["doc_id"] in (1, 2, 3)} == {True} and all(r["fingerprint"] for r in got if r["doc_id"] in (4, 5, 7))
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    one = fingerprint.fingerprints(odd(spark).where("doc_id = 4")).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"worw").hexdigest()


def test_sketches_of_unions_merge(spark):
    a, b = words(300, 0), words(300, 200)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "x"), "b", "y")
    r = df.select("x", "y", fingerprint.merged("x", "y").alias("m")).collect()[0]
    assert r["m"] == sorted({*r["x"], *r["y"]}) and all(v < fingerprint.THRESHOLD for v in r["m"])


def pages(spark):
    return spark.createDataFrame([
        (1, "http://a.example/x", "<html lang=\"fr\"><head><title> A &amp;\n B </title></head><body><p>Un&nbsp;&lt;texte&gt;</p><script>p('</p>')</script>"
                                  "<div>dé<b>ux</b></div><!-- no --></body></html>", "z"),
        (2, None, None, "z"), (3, "", "", "z"), (None, "http://b.example/\r\nWARC-Type: bad", "plain\r\n\r\nWARC/1.1 text", "z"),
        (4, "http://c.example", "<p>" + "wort " * 50_000 + "</p>", "z"), (4, "http://c.example", "<p>" + "wort " * 50_000 + "</p>", "z")],
        "page_id long, url string, html string, block string")


def test_warc_records_link_and_read_back(spark, tmp_path):
    resp = warc.responses(pages(spark))
    records = warc.response_records(resp).unionByName(warc.derivatives(resp))
    got = records.collect()
    assert len(got) == 18
    sources = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    for r in got:
        body = r["block"].encode()
        assert r["content_length"] == len(body) and r["record_digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        if r["record_type"] != "response":
            src = sources[r["refers_to"]]
            assert src["target_uri"] == r["target_uri"]
            if r["record_type"] == "metadata":
                assert src["record_digest"] in r["block"] and "Content-Type: text/html; charset=utf-8" in r["block"]
            else:
                assert r["source_digest"] == src["source_digest"]
    text = {r["page_id"]: r["block"] for r in got if r["record_type"] == "conversion"}
    assert text[1] == "Un <texte>\ndéux" and text[2] == text[3] == "" and text[4] == ("wort " * 50_000).strip()
    meta = {r["page_id"]: r["block"] for r in got if r["record_type"] == "metadata"}
    assert "title: A & B\r\nlanguage: fr\r\n" in meta[1]
    warc.write(records, str(tmp_path / "w"), per_file=5)
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert Counter((f["fields"]["WARC-Record-ID"], bytes(f["block"])) for f in back) == Counter((r["record_id"], r["block"].encode()) for r in got)
    assert not any("bad" in f["fields"].get("WARC-Type", "") for f in back)
    assert warc.derivatives(warc.responses(pages(spark).limit(0))).count() == 0


def test_entities_are_decoded_once(spark):
    """Expected texts written by hand."""
    cases = [("&copy; 2024 &middot; caf&eacute; &mdash; &#8217;&#x27;&#X41;", "\u00a9 2024 \u00b7 caf\u00e9 \u2014 \u2019'A"), ("&amp;lt; &amp;amp;copy;", "&lt; &amp;copy;"),
             ("a&nbsp;&nbsp;b&#160;c&#xa0;", "a b c"), ("AT&T & R&D &unknown; &", "AT&T & R&D &unknown; &"), ("&lt;p&gt;not a tag&lt;/p&gt;", "<p>not a tag</p>"),
             ("&copy2024 &AMP; &notin; &nbspx", "\u00a92024 & \u2209 x"), ("&#0;&#x110000;&#xD800;&#128;", "\ufffd\ufffd\ufffd\u20ac"), ("&NotEqualTilde;|&#10;|", "\u2242\u0338|\n|")]
    df = spark.createDataFrame([(k, f"<p>{a}</p>") for k, (a, _) in enumerate(cases)], "k int, html string")
    got = df.select("k", warc.plain_text(F.col("html")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in got] == [b for _, b in cases]


def neighbours(text):
    """(first line, last line, text) of each two lines with words that have only blank ones between them."""
    lines = (text or "").split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    return [(a, z, "\n".join(lines[a:z + 1])) for a, z in zip(at, at[1:])]


def plain_dedup(docs):
    """Without every two neighbouring lines that stand together anywhere before."""
    seen, out = set(), {}
    for i, t in sorted(set(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = set()
        for a, z, both in neighbours(t):
            gone |= set(range(a, z + 1)) if both in seen else set()
            seen.add(both)
        lines = t.split("\n") if t else []
        out[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t, len(gone))
    return out


def dedup(spark, docs):
    return line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()


def test_line_dedup_equals_brute_force(spark):
    """Lines so long that there is a boundary between any two: chunks are all neighbours."""
    rng = random.Random(3)
    passages = ["\n".join(words(12, 1000 * p + 15 * k) + ("\n" if k % 5 == 2 else "") for k in range(12)) for p in range(4)]
    docs = []
    for i in range(40):
        own = [words(13, 20000 + 900 * i + 9 * k) for k in range(rng.randrange(0, 20))]
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own) + 1):0] = rng.choice(passages).split("\n")
        docs.append((i, "\n".join(own)))
    docs += [(100, docs[0][1]), (100, docs[0][1]), (101, None), (102, ""), (103, "\n\n\n\n"), (104, "\n\n\n\n")]
    got, want = dedup(spark, docs), plain_dedup(docs)
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in got) == Counter((i, *want[i, t]) for i, t in docs)
    assert sum(r["n_removed"] for r in got) > 100 and {r["text"] for r in got if r["doc_id"] in (103, 104)} == {"\n\n\n\n"}


def some_lines(rng, n, tag):
    return [" ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(rng.choice([1, 1, 2, 3, 6, 20]))) if rng.random() < 0.85 else "" for _ in range(n)]


def test_only_repeated_neighbours_go_and_one_of_each_line_stays(spark):
    rng = random.Random(6)
    passages = [some_lines(rng, rng.randrange(1, 30), "p") for _ in range(12)]
    docs = []
    for i in range(120):
        own = some_lines(rng, rng.randrange(0, 25), "o")
        for _ in range(rng.randrange(3)):
            a = rng.randrange(4)
            own[rng.randrange(len(own) + 1):0] = rng.choice(passages)[a:a + rng.randrange(1, 30)]
        docs.append((i, "\n".join(own)))
    places = Counter(both for _, t in docs for *_, both in neighbours(t))
    got = {r["doc_id"]: r for r in dedup(spark, docs)}
    stays, removed = Counter(x for r in got.values() for x in r["text"].split("\n")), 0
    for i, t in docs:
        lines = t.split("\n") if t else []
        left = got[i]["text"].split("\n") if got[i]["n_removed"] < len(lines) else []
        assert got[i]["n_lines"] == len(lines) and len(lines) - got[i]["n_removed"] == len(left)
        may = {k for a, z, both in neighbours(t) if places[both] > 1 for k in range(a, z + 1)}
        it = iter(lines)
        assert all(x in it for x in left)                                           # in order
        assert not Counter(x for k, x in enumerate(lines) if k not in may) - Counter(left)     # nothing else goes
        gone = Counter(lines) - Counter(left)
        assert all(stays[x] for x in gone if x.strip())
        removed += sum(gone.values())
    assert removed > 200


def test_boundaries_do_not_depend_on_what_stands_before():
    rng = random.Random(2)
    passage = [f"{x} end" for x in some_lines(rng, 60, "q")]
    plain = line_dedup.Lines("\n".join(passage)).boundary.tolist()
    assert 0 < sum(plain) < len(plain)
    for n in (1, 2, 5):
        assert line_dedup.Lines("\n".join([*(f"before {k}" for k in range(n)), *passage])).boundary.tolist()[n:] == plain


def test_repeated_passages_go_whole(spark):
    """From the first line to the last, wherever they stand: long lines, short ones (by steps from a seed), blank ones between."""
    docs, want, n = [], {}, 0
    for size, long in ((2, 30), (3, 30), (5, 16), (6, 30), (40, 2), (60, 1)):
        for trial in range(8):
            passage = [f"{size} {trial} {k} " + "word " * (long + k % 2) + "." for k in range(size)]
            if trial % 2:
                passage = "\n\n".join(passage).split("\n")
            for copy in range(2):
                head, tail = ([f"{x} {n} {k}" for k in range((trial + copy) % 3)] for x in ("before", "after"))
                docs.append((n, "\n".join(head + passage + tail)))
                want[n] = "\n".join(head + ([] if copy else passage) + tail)
                n += 1
    got = {r["doc_id"]: r["text"] for r in dedup(spark, docs)}
    assert [i for i in want if got[i] != want[i]] == []


def test_single_lines_between_blank_ones_stay(spark):
    thanks = "Thanks to all who have read this far and to everyone who has sent word about what was missing here and there."
    docs = [(1, f"Intro one.\n\n{thanks}\n\nEnd one."), (2, f"Intro two.\n\n{thanks}\n\nEnd two."), (3, thanks), (4, f"{thanks}\n"), (5, f"\n\n{thanks}\n\n")]
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup(spark, docs)} == {i: (t, 0) for i, t in docs}


def test_line_dedup_of_odd_rows(spark):
    got = rows(line_dedup.deduplicated(odd(spark, ["drop", "n_lines"])))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in odd_rows())
    assert line_dedup.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op6_warc_derivatives", "op2_ngram_jaccard_join"])
def test_sql_twins(spark, name):
    import duckdb

    from clashlens.llm.queries import QUERIES
    from clashlens.llm.sql import ORACLES
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))
