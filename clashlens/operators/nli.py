"""Pair scorers (N-1, N-4, U-2) and the replaceable model hooks (U-1, U-3 live with their users).

A scorer maps a DataFrame of pairs to the same DataFrame plus ``entailment, neutral, contradiction``.
The built-in ``lexical_scorer`` is three linear logits over features that the similarity step
already computed (cosine, token Jaccard, negation on exactly one side), followed by a softmax; it
stays inside the JVM. ``model_scorer`` attaches any user model through ``mapInPandas``: the model is
loaded once per Python worker and fed Arrow batches of ``batch_size`` pairs.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clashlens.config import BATCH_SIZE, DEFAULT, LABEL_ORDER, SCORER_WEIGHTS, Settings
from clashlens.functions import text as tx
from clashlens.functions.scores import softmax3
from clashlens.operators.hooks import model_key, model_of


def _logit(w, cos: Column, jac: Column, neg: Column) -> Column:
    b0, wc, wj, wn = w
    return F.lit(b0) + F.lit(wc) * cos + F.lit(wj) * jac + F.lit(wn) * neg.cast("double")


def lexical_scores(cos: Column, jac: Column, neg: Column, weights: dict | None = None):
    w = weights or SCORER_WEIGHTS
    z = [_logit(w[k], cos, jac, neg) for k in LABEL_ORDER]
    return softmax3(*z)


def lexical_scorer(pairs: DataFrame, weights: dict | None = None, cos: str = "cos", jac: str = "jac",
                   neg: Column | None = None) -> DataFrame:
    """Adds entailment, neutral, contradiction to pairs that carry cos, jac and a negation flag."""
    if neg is None:
        neg = F.col("neg") if "neg" in pairs.columns else (F.col("neg_i") != F.col("neg_j"))
    e, n, c = lexical_scores(F.col(cos), F.col(jac), neg, weights)
    return pairs.withColumn("entailment", e).withColumn("neutral", n).withColumn("contradiction", c)


def within_budget(pairs: DataFrame, budget: int, s1: str = "sentence1", s2: str = "sentence2") -> DataFrame:
    """T-4 before a model: both sentences cut together to ``budget`` word tokens, the longer side first.

    A cut sentence keeps its own characters up to its last kept token; one that fits is as it was.
    """
    d = pairs.withColumn("_na", F.coalesce(tx.word_count(F.col(s1)), F.lit(0))).withColumn("_nb", F.coalesce(tx.word_count(F.col(s2)), F.lit(0)))
    a, b = tx.truncate_pair(F.col("_na"), F.col("_nb"), budget)
    d = d.withColumn("_ka", a).withColumn("_kb", b)
    for col, n, k in ((s1, "_na", "_ka"), (s2, "_nb", "_kb")):
        d = d.withColumn(col, F.when(F.col(k) < F.col(n), tx.first_words(col, k)).otherwise(F.col(col)))
    return d.drop("_na", "_nb", "_ka", "_kb")


def model_scored(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame], settings: Settings = DEFAULT, s1: str = "sentence1",
                 s2: str = "sentence2") -> DataFrame:
    """The pairs with a model's three probabilities. The model gets the sentences cut to ``settings.max_seq_len``
    tokens less the three marks of a pair encoding; the rows keep them whole."""
    cut = within_budget(pairs.withColumn("_s1", F.col(s1)).withColumn("_s2", F.col(s2)), settings.max_seq_len - 3, s1, s2)
    return scorer(cut).withColumn(s1, F.col("_s1")).withColumn(s2, F.col("_s2")).drop("_s1", "_s2")


def model_scorer(pairs: DataFrame, load_model: Callable[[], object], labels: Sequence[str],
                 s1: str = "sentence1", s2: str = "sentence2", batch_size: int = BATCH_SIZE) -> DataFrame:
    """Hook U-2: score pairs with a user model ``model(list_s1, list_s2) -> array[n, k] of probabilities``.

    ``labels`` names the model's output columns; they are remapped *by name* onto the canonical
    order entailment, neutral, contradiction, so a model with another class order is still right.
    """
    missing = set(LABEL_ORDER) - set(labels)
    if missing:
        raise ValueError(f"model labels lack {sorted(missing)}")
    pos = [list(labels).index(k) for k in LABEL_ORDER]
    key = model_key(load_model)
    schema = T.StructType(pairs.schema.fields + [T.StructField(k, T.DoubleType()) for k in LABEL_ORDER])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(load_model, key)
        for pdf in it:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size].copy()
                probs = model(chunk[s1].fillna("").tolist(), chunk[s2].fillna("").tolist())
                for k, p in zip(LABEL_ORDER, pos):
                    chunk[k] = [float(r[p]) for r in probs]
                yield chunk

    return pairs.mapInPandas(run, schema)
