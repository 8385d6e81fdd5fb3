"""WARC derivative builder (operator 6).

Responses (page_id, url, html) become linked records: the response itself, a metadata record and a
plain-text conversion record. Both derivatives name the response in WARC-Refers-To, and keep its target,
date, HTTP headers (metadata) and digests. Record ids are made from the content, so a task that runs again
builds the same records.

Defined results: null html is an empty page; a null url gives no WARC-Target-URI line; repeated rows give
equal records; a null page_id stays null. An empty table gives no records. Other columns aren't read.
Texts are read whole. Line breaks inside an url are taken out, as a header is one line. Entities in text and
title are decoded in one pass, all that HTML names and all numeric ones, as HTML's own rules have it (also
without a semicolon where that is allowed); a no-break space is a blank.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clashlens.llm.common import columns_only

VERSION = "WARC/1.1"
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"       # the pages carry no date
SERVED_AS = "text/html; charset=utf-8"

#: Steps from HTML to text, in order: pattern and replacement; entities are decoded between the two lists.
MARKUP_STEPS = (
    (r"(?is)<(?:!--.*?-->|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>|head\b[^>]*>.*?</head\s*>)", ""),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|main|body|html|pre|blockquote)\b[^>]*>", "\n"),
    (r"(?i)</?(?:td|th)\b[^>]*>", " "),
    (r"<[a-zA-Z/!][^>]*>", ""),
)
#: Runs of blanks become one, lines lose blanks at their ends, empty lines go.
SPACE_STEPS = ((r"[ \t\r\f\x{A0}]{2,}|[\t\r\f\x{A0}]", " "), (r" \n ?|\n ", "\n"), (r"\n{2,}", "\n"))


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Entities replaced by their characters."""
    return text.map(lambda t: html.unescape(t) if t and "&" in t else t)


def plain_text(text: Column) -> Column:
    for pattern, to in MARKUP_STEPS:
        text = F.regexp_replace(text, pattern, to)
    text = decoded(text)
    for pattern, to in SPACE_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.btrim(text, F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    return F.regexp_replace(F.md5(F.concat_ws("\n", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def header(fields: list[tuple[str, Column]]) -> Column:
    """Header lines in order; a field whose value is null is left out."""
    return F.concat(F.lit(VERSION + CRLF), *(F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)), F.lit("")) for k, v in fields), F.lit(CRLF))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, target, date, http, html, response_id, block_digest, payload_digest)."""
    p = columns_only(pages, page_id="long", url="string", html="string")
    p = p.select("page_id", F.regexp_replace("url", r"[\r\n]+", "").alias("target"), F.coalesce("html", F.lit("")).alias("html"), F.lit(date).alias("date"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {SERVED_AS}{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF))
    return (p.withColumn("http", http).withColumn("payload_digest", digest(F.col("html")))
            .withColumn("block_digest", digest(F.concat("http", F.lit(CRLF), "html")))
            .withColumn("response_id", record_id(F.lit("response"), F.coalesce("target", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("block_digest"))))


def _record(kind: str, name: str, refers_to: Column, content_type: str, block: str, own: str, source: Column) -> Column:
    """One record as a struct; its id, block and digest are columns, as they are used several times."""
    none = F.lit(None).cast("string")
    name, block, own = F.col(name), F.col(block), F.col(own)
    length = F.octet_length(block).cast("long")
    lines = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", name), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target")),
             ("WARC-Refers-To", none if refers_to is None else refers_to), ("WARC-Block-Digest", own),
             ("WARC-Payload-Digest" if kind == "response" else "WARC-Source-Payload-Digest", none if source is None else source),
             ("Content-Type", F.lit(content_type)), ("Content-Length", length.cast("string"))]
    return F.struct(F.lit(kind).alias("record_type"), name.alias("record_id"), (none if refers_to is None else refers_to).alias("refers_to"),
                    F.col("target").alias("target_uri"), F.col("date").alias("date"), F.lit(content_type).alias("content_type"),
                    length.alias("content_length"), own.alias("record_digest"), (none if source is None else source).alias("source_digest"),
                    block.alias("block"), header(lines).alias("header"))


def response_records(resp: DataFrame) -> DataFrame:
    df = resp.withColumn("_block", F.concat("http", F.lit(CRLF), "html"))
    return df.select("page_id", F.inline(F.array(_record(
        "response", "response_id", None, "application/http; msgtype=response", "_block", "block_digest", F.col("payload_digest")))))


def derivatives(resp: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response, two rows each, from one pass over its text."""
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title", 1)
    lang = F.regexp_extract("html", r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1)
    one_line = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    fields = F.concat(
        F.lit("source-headers: "), F.regexp_replace(F.regexp_replace("http", "\r\n$", ""), "\r\n", "\r\n "), F.lit(CRLF),
        F.lit("source-block-digest: "), "block_digest", F.lit(CRLF + "source-payload-digest: "), "payload_digest", F.lit(CRLF),
        F.lit("title: "), one_line(decoded(title)), F.lit(CRLF + "language: "), one_line(lang), F.lit(CRLF))
    kind = lambda k: record_id(F.lit(k), F.col("response_id"))
    both = (resp.withColumn("_fields", fields).withColumn("_text", plain_text(F.col("html")))
            .withColumn("_of_fields", digest(F.col("_fields"))).withColumn("_of_text", digest(F.col("_text")))
            .withColumn("_meta_id", kind("metadata")).withColumn("_text_id", kind("conversion")))
    return both.select("page_id", F.inline(F.array(
        _record("metadata", "_meta_id", F.col("response_id"), "application/warc-fields", "_fields", "_of_fields", None),
        _record("conversion", "_text_id", F.col("response_id"), "text/plain; charset=utf-8", "_text", "_of_text", F.col("payload_digest")))))


def write(records: DataFrame, path: str, per_file: int = 50_000) -> None:
    """WARC files: Spark's text writer puts header, block and two line ends of each record one after the other."""
    (records.select(F.concat("header", "block", F.lit(CRLF)).alias("value")).write.option("lineSep", CRLF)
     .option("maxRecordsPerFile", per_file).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of one file's bytes, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(fields, block) of every record; a file, whose size ``per_file`` bounds, is one row of the scan."""
    def run(pdfs):
        for pdf in pdfs:
            for data in pdf["content"]:
                got = list(parse(data))
                yield pd.DataFrame({"fields": [f for f, _ in got], "block": [b for _, b in got]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "fields map<string,string>, block binary")
