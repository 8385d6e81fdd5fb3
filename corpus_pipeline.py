"""The corpus pipeline: documents through five operators, each stage written and reread.

Stages take (spark, docs, sf_dir), work on all rows of ``docs`` and, but for the last, return its columns:

1. language_id       drops documents without a recognisable language (no letter at all)
2. near_duplicates   keeps one document of every group linked by word 5-grams at a Jaccard of 0.8
3. decontamination   drops documents that hold ten consecutive words of a benchmark item (or all of a shorter one)
4. mixing            draws documents by rates that keep good text, half of the poor and none of the toxic
5. token_ids         writes token ids in directly addressable codes and returns the index read back from them

Models are fitted on the labelled rows of the given tables; the stages themselves see only their input.

Defined results: a null or empty text has no language and goes at the first stage. Rows that repeat an id are
told apart by their texts; of rows that repeat both one stays. Rows with a null id stay in every stage that has
no other reason to drop them: they are no near duplicates of anything, and mixing keeps them. Without labels all
domains are equally likely, without benchmark items nothing is dropped for them; empty documents give an empty
index. Further columns of any name go through the filtering stages as they are; the last returns its own.

A stage's intermediate tables lie in a folder of its own in ``spark.checkpoint.dir``. As every stage's result is
written before the next one begins, a stage first drops the folders of those before it that ``docs`` doesn't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from clashlens.llm import decontaminate, jaccard_join, language_id, mixing, token_codes
from clashlens.llm.common import bounded_batches, drop, saved, shared_path, table, workspace
from clashlens.llm.queries import tokenizer_file

#: Targets of the mixing stage, as multiples of what a domain has. The good domain's lies a little above
#: what there is, so that its rates reach their bound of 1.
KEEP = {"good": 1.02, "poor": 0.5, "toxic": 0.0}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_folders: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage whose intermediate tables go when a later one begins; a folder that its input still reads stays."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        for old in [x for x in _folders if not any(x in file for file in read)]:
            drop(spark, old)
            _folders.remove(old)
        bounded_batches(spark)
        with workspace(shared_path(spark, f.__name__)) as path:
            _folders.append(path)
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.train(table(spark, sf_dir, "documents")))


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, n=5, percent=80)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mixing.train(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")))
    return mixing.drawn(docs, mixing.mix(docs, model, KEEP, of_own=True, max_rate=1.0))


@stage
def token_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_codes.round_trip(docs, tokenizer_file(), end=2)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_id_stage),
]

#: Models and token codes are not SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = saved(f(spark, docs, sf_dir), name)
    return docs
