"""Replaceable model hooks (U-1 encoder, U-3 generator; U-2 scorer is ``operators.nli.model_scorer``).

Each hook is a plain Python callable that a user supplies; Spark feeds it Arrow batches through an
iterator ``mapInPandas``, so the model is loaded once per Python worker and never per row. The
built-in, SQL-checkable defaults (term vectors, lexical scorer, word-drop paraphraser) need no hook.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clashlens.config import BATCH_SIZE

MOST_MODELS = 4
_CACHE: dict = {}


def model_key(load: Callable[[], object]) -> str:
    """Key of a loader, made on the driver: a digest of the loader as it is sent to the tasks, so two
    loaders of one factory differ and the same loader keeps its model; a fresh key if it can't be pickled."""
    try:
        return hashlib.sha256(cloudpickle.dumps(load)).hexdigest()
    except Exception:
        return uuid.uuid4().hex


def model_of(load: Callable[[], object], key: str):
    """The loaded model, one for each key in a Python worker; the oldest goes beyond MOST_MODELS."""
    if key not in _CACHE:
        while len(_CACHE) >= MOST_MODELS:
            _CACHE.pop(next(iter(_CACHE)))
        _CACHE[key] = load()
    return _CACHE[key]


def encode_with(df: DataFrame, load_encoder: Callable[[], object], text: str = "sentence", out: str = "embedding",
                batch_size: int = BATCH_SIZE) -> DataFrame:
    """U-1: adds ``out`` ARRAY<FLOAT>, unit length, from ``encoder(list_of_text) -> array[n, d]``.

    The result feeds ``dense_candidates`` (tiled similarity) exactly like the embeddings table.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    key = model_key(load_encoder)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = model_of(load_encoder, key)
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[s:s + batch_size].copy()
                v = np.asarray(enc(chunk[text].fillna("").tolist()), dtype=np.float64)
                norms = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(norms > 0, norms, 1.0)
                chunk[out] = [row.astype(np.float32) for row in v]
                yield chunk

    return df.mapInPandas(run, schema)


def generate_with(sentences: DataFrame, load_generator: Callable[[], object], n: int, col: str = "sentence") -> DataFrame:
    """U-3: (sentence, rank, paraphrase) from ``generator(list_of_prompts, n) -> list of lists``.

    Pass the distinct sentences (A-3); one input row becomes up to n output rows.
    """
    from clashlens.config import PARAPHRASE_PROMPT
    schema = T.StructType([T.StructField(col, T.StringType()), T.StructField("rank", T.IntegerType()),
                           T.StructField("paraphrase", T.StringType())])

    key = model_key(load_generator)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = model_of(load_generator, key)
        for pdf in it:
            prompts = [PARAPHRASE_PROMPT + s for s in pdf[col].fillna("").tolist()]
            outs = gen(prompts, n)
            rows = [(s, r + 1, p) for s, ps in zip(pdf[col].tolist(), outs) for r, p in enumerate(ps[:n])]
            yield pd.DataFrame(rows, columns=[col, "rank", "paraphrase"])

    return sentences.select(col).mapInPandas(run, schema)
