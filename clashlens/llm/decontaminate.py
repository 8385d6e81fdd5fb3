"""Benchmark decontamination by winnowing (operator 3), in DataFrame functions only.

Documents and benchmark items are word sequences. Of every ``window`` words, both keep the smallest hash
of the k-grams in it; a shared run of ``window`` words therefore has one fingerprint in common, so the
join of the fingerprints finds every document with such a run. Only the texts of those documents are
taken up again: the places of the items' fingerprints in them are found, and the windows around each are
cut out and joined with the items' windows, by a hash and then as text.

Items shorter than a window are one window of all their words. No fingerprint of a longer window need
fall inside them, so documents are joined on all their word n-grams of the few lengths that occur, all in
one pass, and the texts of the documents with a common hash are compared.

Fingerprints are taken over lower-cased words, which costs a fraction of changing A-Z alone. That is safe
only where equal words (after A-Z became a-z) stay equal: lower-casing changes each character by itself
but for the capital sigma, whose small form depends on its neighbours, so that one is made small first.

Defined results: words are runs without the break characters after A-Z became a-z. A null text, or one
without words, has no words and no hits. Items with a null id or no words are left out; items that repeat
an id are one item. Documents that repeat an id are taken by their text, and rows that repeat both get
equal rows. Other columns of the inputs, whatever their names, aren't read.
"""

# A plain explode lets the optimizer infer a filter on its array, which puts a copy of all that the array is made of,
# the splitting included, into the lambda below: explode_outer and a test for null don't.
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clashlens.llm.common import checked_broadcast, columns_only, saved

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(1 << 63)


def split_words(lowered: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAKS), "")


def exact_words(text: str) -> Column:
    """Words after A-Z became a-z; letters beyond ASCII stay as they are."""
    return split_words(F.translate(text, UPPER, UPPER.lower()))


def folded(text: str) -> Column:
    """The text in lower case, each character by itself."""
    return F.lower(F.replace(F.col(text), F.lit("Σ"), F.lit("σ")))


def folded_words(text: str) -> Column:
    """As many words as the exact ones, and equal wherever those are."""
    return split_words(folded(text))


def gram_hashes(words: str, k: int) -> Column:
    """Hashes of all k-grams; of all words together where there are fewer than k."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, k)))


def winnowed(hashes: str, width: int) -> Column:
    """The distinct minima of all runs of ``width`` hashes."""
    last = F.greatest(F.size(hashes) - width, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice(hashes, i + 1, width))))


def window_text(words: str, start: Column, length) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, id, digest, text): id and digest tell documents apart and are never null."""
    return columns_only(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("digest"), "text")


def _items(bench: DataFrame) -> DataFrame:
    b = columns_only(bench, item_id="string", text="string").where("item_id is not null")
    return saved(b.select("item_id", exact_words("text").alias("w"), folded_words("text").alias("f")).where(F.size("w") > 0), "items")


def _texts(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """(id, digest, text) of the documents in ``found`` (id, digest), once each, written."""
    here = keyed.select("id", "digest", "text").join(checked_broadcast(saved(found.distinct(), "found")), ["id", "digest"], "left_semi")
    return saved(here.dropDuplicates(["id", "digest"]), "texts")


def _whole_windows(keyed: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """(id, digest, start, length, item_id) for the items of at least a window's words."""
    width = window - k + 1
    long_ = items.where(F.size("w") >= window)
    prints = checked_broadcast(saved(long_.withColumn("h", gram_hashes("f", k)).select(F.explode(winnowed("h", width)).alias("print")).distinct(), "prints"))
    texts = _texts(keyed, (
        keyed.select("id", "digest", folded_words("text").alias("f")).where(F.size("f") >= window).withColumn("h", gram_hashes("f", k))
        .select("id", "digest", F.explode(winnowed("h", width)).alias("print")).join(prints, "print", "left_semi").select("id", "digest")))

    places = (texts.select("id", "digest", folded_words("text").alias("f")).withColumn("h", gram_hashes("f", k))
              .select("id", "digest", F.posexplode_outer("h").alias("at", "print")).where("print is not null")
              .join(prints, "print", "left_semi").groupBy("id", "digest").agg(F.collect_set("at").alias("ats")))
    around = F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(
        F.greatest(p - (width - 1), F.lit(0)), F.least(p, F.size("w") - window)))))
    parts = (texts.join(places, ["id", "digest"]).select("id", "digest", exact_words("text").alias("w"), "ats")
             .select("id", "digest", "w", F.explode(around).alias("start"))
             .select("id", "digest", "start", window_text("w", F.col("start"), window).alias("key")).withColumn("h", F.xxhash64("key")))
    whole = (long_.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("at"))
             .select("item_id", window_text("w", F.col("at"), window).alias("item_key")).distinct().withColumn("h", F.xxhash64("item_key")))
    return (parts.join(checked_broadcast(saved(whole, "windows")), "h").where(F.col("key") == F.col("item_key"))
            .select("id", "digest", "start", F.lit(window).alias("length"), "item_id"))


def _short_items(keyed: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(id, digest, start, length, item_id) for the items of fewer words than a window, of all lengths at once."""
    short = saved(items.where(F.size("w") < window).select(
        F.size("w").alias("length"), "item_id", F.xxhash64("f").alias("h"), F.array_join("w", " ").alias("key")).distinct(), "short")
    lengths = sorted(r[0] for r in short.select("length").distinct().collect())        # window - 1 at most
    side = checked_broadcast(short)
    if not lengths:
        return keyed.select("id", "digest", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("item_id")).where("false")
    none = F.array().cast("array<struct<length:int,start:int,h:bigint>>")

    def grams(n):
        each = F.transform(gram_hashes("f", n), lambda h, i: F.struct(F.lit(n).alias("length"), i.alias("start"), h.alias("h")))
        return F.when(F.size("f") >= n, each).otherwise(none)

    near = saved(keyed.select("id", "digest", folded_words("text").alias("f")).where(F.size("f") >= lengths[0])
                 .select("id", "digest", F.explode_outer(F.flatten(F.array(*map(grams, lengths)))).alias("g")).where("g is not null").select("id", "digest", "g.*")
                 .join(side, ["length", "h"]).select("id", "digest", "start", "length", "item_id", "key").distinct(), "near")
    texts = _texts(keyed, near.select("id", "digest")).select("id", "digest", exact_words("text").alias("w"))
    return (near.join(texts, ["id", "digest"]).where(window_text("w", F.col("start"), F.col("length")) == F.col("key"))
            .select("id", "digest", "start", "length", "item_id"))


def spans(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """(id, digest, start, length, item_id): every occurrence of an item's window in a document.

    ``start`` counts words from 0. Documents are the rows of ``_keyed(docs)``.
    """
    keyed = _keyed(docs)
    items = _items(bench)
    return _whole_windows(keyed, items, window, k).unionByName(_short_items(keyed, items, window))


def report(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A word is hit when any span covers it. The digest is of the ids of the items, sorted as text and
    joined by commas; an uncontaminated document has the digest of the empty text.
    """
    found = saved(spans(docs, bench, window), "spans")
    before = Window.partitionBy("id", "digest").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    hit = (found.select("id", "digest", "start", "length").distinct().withColumn("covered", F.max(end).over(before))
           .groupBy("id", "digest").agg(F.sum(F.greatest(end - F.greatest("start", "covered"), F.lit(0))).cast("long").alias("n_hit")))
    items = found.select("id", "digest", "item_id").distinct().groupBy("id", "digest").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    size = _keyed(docs).select("doc_id", "id", "digest", F.size(folded_words("text")).cast("long").alias("n_words"))
    hits = saved(hit.join(items, ["id", "digest"]).select("id", "digest", "n_hit", F.size("items").cast("long").alias("n_items"),
                                                          F.array_join("items", ",").alias("items")), "hits")
    zero = F.lit(0).cast("long")
    return (size.join(checked_broadcast(hits), ["id", "digest"], "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
                    F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")))


def clean(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, without a span of any item."""
    found = saved(spans(docs, bench, window).select("id", "digest").distinct(), "leaks")
    mark = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == found["id"]) & (F.xxhash64(docs["text"].cast("string")) == found["digest"])
    return docs.join(checked_broadcast(found), mark, "left_anti")
