"""JSON and plain-text inputs (S-3, S-4), batch and stream, with everything unreadable kept as a reject.

Readers enforce a fixed schema and are permissive: a line that is no JSON object of that schema becomes a row
with ``error`` and its text in ``record``, never a failed job and never a lost row. Rows without their
sentences have the error of the request they stand for. ``valid_only`` (``sources.documents``) keeps the
good rows; ``rejects`` gives the others.

A document may bring its own ``doc_id``; one that doesn't has a hash of the file's name and its content, so that
a job that runs again gives it the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clashlens.sources.documents import document_source, pair_source

INVALID_JSON_REASON = "Invalid JSON."
_RECORD = "_corrupt_record"

DOC_JSON = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
PAIR_JSON = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("sentence1", T.StringType()),
                          T.StructField("sentence2", T.StringType())])


def _json(spark: SparkSession, path: str, schema: T.StructType, stream: bool, whole_files: bool) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType())]))
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD).option("multiLine", whole_files).json(path)
    return df.withColumn("_file", F.col("_metadata.file_path"))


def _with_rejects(checked: DataFrame) -> DataFrame:
    """The error of a broken record goes before that of missing text."""
    return checked.withColumn("error", F.when(F.col("record").isNotNull(), F.lit(INVALID_JSON_REASON)).otherwise(F.col("error")))


def _identified(df: DataFrame, key: str, *content: str) -> DataFrame:
    own = F.xxhash64("_file", *(F.coalesce(c, F.lit("")) for c in content), F.coalesce(F.col(_RECORD), F.lit("")))
    return df.withColumn(key, F.coalesce(F.col(key), own)).withColumn("record", F.col(_RECORD)).drop(_RECORD, "_file")


def json_documents(spark: SparkSession, path: str, stream: bool = False, whole_files: bool = False) -> DataFrame:
    """(doc_id, text, error, record): one JSON object a line (or a file, ``whole_files``) with the field ``text``."""
    raw = _identified(_json(spark, path, DOC_JSON, stream, whole_files), "doc_id", "text")
    return _with_rejects(document_source(raw, keep=["record"])).select("doc_id", "text", "error", "record")


def json_pairs(spark: SparkSession, path: str, stream: bool = False, whole_files: bool = False) -> DataFrame:
    """(pair_id, sentence1, sentence2, error, record): one JSON object a line with the two sentences of a request."""
    raw = _identified(_json(spark, path, PAIR_JSON, stream, whole_files), "pair_id", "sentence1", "sentence2")
    return _with_rejects(pair_source(raw, keys=("pair_id", "record"))).select("pair_id", "sentence1", "sentence2", "error", "record")


def text_documents(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(doc_id, text, error, record): one document a file, read whole; ``record`` is NULL."""
    df = (spark.readStream if stream else spark.read).text(path, wholetext=True)
    raw = df.select(F.xxhash64("_metadata.file_path", "value").alias("doc_id"), F.col("value").alias("text"), F.lit(None).cast("string").alias("record"))
    return document_source(raw, keep=["record"]).select("doc_id", "text", "error", "record")


def rejects(source: DataFrame) -> DataFrame:
    """The rows that can't be checked, with the reason and, where it was no JSON, the text that was read."""
    return source.where(F.col("error").isNotNull())
