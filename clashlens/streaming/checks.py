"""Continuous checking (ST-1, ST-2) with Structured Streaming.

ST-1: each incoming pair is independent, so the pair report is a stateless projection of the stream
(append mode, no state, no watermark needed).
ST-2: each incoming document is self-contained, but the document check needs joins and aggregations
over the batch; ``foreachBatch`` runs the unchanged batch job on every micro-batch and writes it under
``batch_id=<id>`` with overwrite, so a replayed batch (after a failure) replaces its own output.
Checkpoints go to the shared folder named by ``spark.checkpoint.dir`` unless a location is given.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clashlens.config import DEFAULT, Settings
from clashlens.plans.document_check import check_documents
from clashlens.plans.pair_check import pair_report
from clashlens.session import ensure_checkpoint_dir
from clashlens.sources.documents import document_source, pair_source, valid_only
from clashlens.sources.files import json_documents, json_pairs, rejects, text_documents

PAIR_SCHEMA = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("sentence1", T.StringType()),
                            T.StructField("sentence2", T.StringType())])
DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def document_stream(spark: SparkSession, source_dir: str, source: str = "parquet") -> DataFrame:
    """(doc_id, text, error, record) of files as they come: ``parquet``, ``json`` (an object a line) or ``text`` (a document a file)."""
    if source == "parquet":
        return document_source(spark.readStream.schema(DOC_SCHEMA).parquet(source_dir)).withColumn("record", F.lit(None).cast("string"))
    return {"json": json_documents, "text": text_documents}[source](spark, source_dir, stream=True)


def pair_stream(spark: SparkSession, source_dir: str, source: str = "parquet") -> DataFrame:
    """(pair_id, sentence1, sentence2, error, record) of files as they come: ``parquet`` or ``json``."""
    if source == "parquet":
        pairs = pair_source(spark.readStream.schema(PAIR_SCHEMA).parquet(source_dir), keys=("pair_id",))
        return pairs.withColumn("record", F.lit(None).cast("string"))
    return {"json": json_pairs}[source](spark, source_dir, stream=True)


def _checkpoint(spark: SparkSession, name: str, sink: str, location: str | None) -> str:
    """Without a given location a folder of the sink's own, so two streams never share their state."""
    return location or os.path.join(ensure_checkpoint_dir(spark), "streams", name, hashlib.sha256(sink.encode()).hexdigest()[:16])


def checked_pairs(pairs: DataFrame, settings: Settings = DEFAULT, scorer=None, encoder=None) -> DataFrame:
    """The report of every pair of ``pair_stream``: one that can't be checked has its reason in ``error`` and no scores."""
    good = pair_report(valid_only(pairs), ("pair_id",), settings, scorer, encoder).withColumn("error", F.lit(None).cast("string"))
    bad = pairs.where(F.col("error").isNotNull())
    bad = bad.select(*(F.col(f.name) if f.name in ("pair_id", "error") else F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema), "record")
    return good.withColumn("record", F.lit(None).cast("string")).unionByName(bad)


def stream_pair_reports(spark: SparkSession, source_dir: str, sink_dir: str, settings: Settings = DEFAULT,
                        checkpoint: str | None = None, fmt: str = "parquet", available_now: bool = True, scorer=None, encoder=None,
                        source: str = "parquet"):
    """ST-1: files of (pair_id, sentence1, sentence2) -> pair reports in ``sink_dir``, one row for every pair.

    A pair that lacks a sentence, or is no JSON, has its reason in ``error`` and no scores. With an ``encoder`` every
    micro-batch is a batch job (its distinct sentences are encoded once) that overwrites ``batch_id=<id>``; else the
    check is a projection of the stream, in append mode.
    """
    pairs = pair_stream(spark, source_dir, source)
    w = pairs.writeStream if encoder else checked_pairs(pairs, settings, scorer).writeStream.format(fmt).outputMode("append").option("path", sink_dir)
    if encoder:
        def run(batch: DataFrame, batch_id: int) -> None:
            out = checked_pairs(batch, settings, scorer, encoder)
            out.write.mode("overwrite").format(fmt).save(os.path.join(sink_dir, f"batch_id={batch_id}"))

        w = w.foreachBatch(run)
    w = w.option("checkpointLocation", _checkpoint(spark, "pairs", sink_dir, checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def stream_doc_reports(spark: SparkSession, source_dir: str, sink_dir: str, settings: Settings = DEFAULT,
                       checkpoint: str | None = None, available_now: bool = True, scorer=None, encoder=None, source: str = "parquet"):
    """ST-2: files of documents -> nested document reports, one folder per micro-batch.

    Documents without text, and lines that are no JSON, go to the folder ``<sink>-rejected``, with the reason.
    """
    docs = document_stream(spark, source_dir, source)

    def run(batch: DataFrame, batch_id: int) -> None:
        out = check_documents(valid_only(batch), settings, scorer, encoder=encoder).report(nested=True)
        out.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))
        rejects(batch).write.mode("overwrite").parquet(os.path.join(f"{sink_dir.rstrip('/')}-rejected", f"batch_id={batch_id}"))

    w = (docs.writeStream.foreachBatch(run)
         .option("checkpointLocation", _checkpoint(spark, "docs", sink_dir, checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
