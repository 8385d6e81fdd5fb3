"""Threshold-scaled document fingerprints (operator 9), in DataFrame functions only.

The sketch of a text keeps every hash of its five-word shingles that lies below a fixed fraction of the
hash range. Sketches grow with their texts, so those of texts of very different lengths can be compared:
the hashes that two sketches share estimate how much of the smaller text is contained in the larger one.
The sketch of a union is the union of the sketches.

A text whose shingles all lie above the threshold keeps its smallest one, so only a text without words
has an empty sketch; ``n_kept`` is 0 then, and its likeness to another text rests on that one hash alone. With m
shingles that happens with probability 0.75^m. A text of fewer than five words is one shingle.

Defined results: null texts are empty. Two empty sketches are alike (1.0), an empty one and another are
not (0.0). The next document is the one with the next id, the first after the last; null ids come first,
and rows that repeat an id are ordered by their text. Of a table of one row the next is the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clashlens.llm.common import bucket_of, columns_only, range_splits

WORDS = 5
#: Signed hashes below this are the lowest quarter of the range.
THRESHOLD = -(1 << 62)


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def shingle_hashes(w: str, n: int = WORDS) -> Column:
    last = F.greatest(F.size(w) - n, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(w, i + 1, n)))


def with_sketch(df: DataFrame, text: str, sketch: str) -> DataFrame:
    """``df`` and the sketch of a text column: an ascending array of distinct hashes."""
    low = F.filter("_h", lambda x: x < THRESHOLD)
    return (df.withColumn("_w", words(text)).withColumn("_h", shingle_hashes("_w")).withColumn("_low", low)
            .withColumn(sketch, F.when(F.size("_w") == 0, F.array().cast("array<bigint>"))
                        .when(F.size("_low") == 0, F.array(F.array_min("_h"))).otherwise(F.array_sort(F.array_distinct("_low"))))
            .drop("_w", "_h", "_low"))


def printed(sketch: str) -> Column:
    """Hexadecimal text of a sketch: the 16 digits of each hash, ascending as signed numbers, so that it can be read back."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def read_back(fingerprint: str) -> Column:
    """The sketch of a printed fingerprint."""
    digits = F.regexp_extract_all(F.col(fingerprint), F.lit("[0-9A-F]{16}"), 0)
    signed = lambda d: F.conv(d, 16, -10).cast("long")
    return F.transform(digits, signed)


def containment(a: str, b: str) -> Column:
    """Share of the smaller sketch that the other one holds, 0 to 1."""
    least = F.least(F.size(a), F.size(b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0)
            .otherwise(F.size(F.array_intersect(a, b)) / least))


def merged(a: str, b: str) -> Column:
    """The sketch of two texts' shingles together (up to the smallest hash that a short text keeps)."""
    return F.array_sort(F.array_union(a, b))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(bucket, guard, doc_id, text) and a window that puts each row before the next document's.

    Ids are cut into ranges, a few for each shuffle partition. Every range also gets a guard, the first row
    of the range after it, so that no window looks beyond its range; guards aren't documents.
    """
    spark = docs.sparkSession
    base = columns_only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    splits = range_splits(base, "doc_id", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = base.withColumn("bucket", bucket_of("doc_id", splits).cast("int")).withColumn("guard", F.lit(0))
    first = sorted((r["bucket"], r["id"]) for r in rows.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("id")).collect())
    if first:       # one row a range: its number, the range after it and the first id there
        after = [(b, *first[(i + 1) % len(first)]) for i, (b, _) in enumerate(first)]
        guards = F.broadcast(spark.createDataFrame(after, "bucket int, other int, first long"))
        found = (rows.withColumnRenamed("bucket", "other").withColumn("first", F.coalesce("doc_id", F.lit(-(1 << 63))))
                 .join(guards, ["other", "first"]).groupBy("bucket", "doc_id").agg(F.min("text").alias("text")))
        # a null id and the smallest number are two ids of one place: the null one is the first
        found = found.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("g")).select("bucket", "g.doc_id", "g.text")
        rows = rows.unionByName(found.withColumn("guard", F.lit(1)).select("doc_id", "text", "bucket", "guard"))
    return rows, Window.partitionBy("bucket").orderBy("guard", F.col("doc_id").asc_nulls_first(), "text")


def edited_texts(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of ``with_next`` with n_chars, the next text and the text whose last quarter is the next one's beginning."""
    rows, order = with_next(docs)
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    return (rows.withColumn("n_chars", F.length("text")).withColumn("next_text", F.lead("text").over(order))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut),
                                           F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))).drop("next_text"), order)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_kept) of every row.

    ``n_kept``: the hashes of the own sketch that lie below the threshold.
    """
    rows, order = edited_texts(docs)
    rows = with_sketch(with_sketch(rows, "text", "own"), "edited", "changed")
    rows = rows.withColumn("next", F.lead("own").over(order)).where("guard = 0")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        printed("own").alias("fingerprint"), printed("changed").alias("edited_fingerprint"),
        containment("own", "changed").alias("near_edited"), containment("own", "next").alias("near_next"),
        F.size(F.filter("own", lambda x: x < THRESHOLD)).cast("long").alias("n_kept"))
