"""Result sinks (S-7, S-8, S-9 lives with the model in plans.training).

Writers are idempotent: a target path is overwritten as a whole, and the streaming jobs write one
sub-folder per micro-batch id, so a retried batch replaces its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_RECORD_FIELDS = ("similarity", "threshold", "passed_filter", "entailment", "neutral", "contradiction",
                      "verdict", "confidence", "filtered_reason")


def pair_records_json(report: DataFrame, keys) -> DataFrame:
    """(keys, json): the pair API record, NULL fields written as ``null`` (not dropped)."""
    rec = F.to_json(F.struct(*PAIR_RECORD_FIELDS), {"ignoreNullFields": "false"})
    return report.select(*keys, rec.alias("json"))


def write_doc_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S-8: nested per-document report (stats + contradictions array) to parquet or json."""
    report.write.mode("overwrite").format(fmt).save(path)
