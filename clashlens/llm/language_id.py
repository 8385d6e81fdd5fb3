"""Language identification by mixture inference (operator 4).

Each language has a model of hashed letter n-grams. A text is cut into runs of words; every run has a
likelihood under every language, and expectation-maximisation estimates the proportions of the languages
in the text. The language set grows from the single best language, one language at a time, while the
log-likelihood gains more than a penalty that grows with the logarithm of the number of runs.

Defined results: a null text and a text without letters (marks alone are none) are ``und`` with score 0 and
no proportions. Ties between languages go to the first name in sort order. Repeated rows get equal rows. An empty table gives
an empty table. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.llm.common import PieceTable, Words, as_batch, blocks, code_points, columns_only, held_out, words_of

LETTER = r"\p{L}|\p{M}"
WORD = regex.compile(rf"(?:{LETTER})+")
ANY_LETTER = regex.compile(r"\p{L}")
BUCKETS = 1 << 16
RUN_WORDS = 8
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray            # (BUCKETS, languages), log probability of an n-gram bucket

    def __post_init__(self):
        self._known = PieceTable(19)
        self._table, self._used = np.zeros((1024, len(self.langs)), np.float32), 0

    def __getstate__(self):
        return {"langs": self.langs, "logp": self.logp}

    def __setstate__(self, s):
        self.langs, self.logp = s["langs"], s["logp"]
        self.__post_init__()

    def _forget(self) -> None:
        self._used = 0

    def _learn(self, words: list[str]) -> np.ndarray:
        """Rows of the table for new words: the sums of their n-grams' log probabilities."""
        each = [grams(w) for w in words]
        starts = np.cumsum([0, *map(len, each)])
        while self._used + len(words) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        for a in range(0, len(words), 4096):
            part = each[a:a + 4096]
            flat = np.fromiter((k for g in part for k in g), np.int64, int(starts[a + len(part)] - starts[a]))
            self._table[self._used + a:self._used + a + len(part)] = np.add.reduceat(self.logp[flat], starts[a:a + len(part)] - starts[a], axis=0)
        self._used += len(words)
        return np.arange(self._used - len(words), self._used)

    def rows(self, words: Words) -> np.ndarray:
        """(words, languages) log-likelihoods."""
        at = words.numbers(self._known, self._learn, self._forget)      # may replace the table
        return self._table[at]


def grams(word: str) -> list[int]:
    """Buckets of the letter n-grams (1 to 4 letters) of a word between marks."""
    b = f"^{word}$"
    return [crc32(b[i:i + n].encode()) % BUCKETS for n in (1, 2, 3, 4) for i in range(len(b) - n + 1)]


def train(docs: DataFrame, rows_per_lang: int = 2000, lang: str = "lang") -> LanguageModel:
    """N-gram models from the rows that are not held out.

    Fits on at most about ``rows_per_lang`` texts of each language: the rows whose hashed id falls below
    the share that this number is of the language's rows. N-gram counts are summed by Spark; the driver
    receives at most BUCKETS numbers for each language.
    """
    d = columns_only(docs, doc_id="long", text="string", **{lang: "string"}).withColumnRenamed(lang, "lang")
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, rows_per_lang / counts[x]))) for x in langs))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / F.lit(float(1 << 53))
    sample = d.where(unit < share).select("text", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int").alias("k"))

    def count(batches):
        words: dict[int, Counter] = {}
        for b in blocks(batches):
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(k, Counter()).update(WORD.findall(t.lower()))
        schema = pa.schema([("k", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])
        for k, c in words.items():
            total = np.zeros(BUCKETS, np.int64)
            for w, n in c.items():
                np.add.at(total, grams(w), n)
            at = np.flatnonzero(total)
            yield as_batch(schema, np.full(len(at), k, np.int32), at.astype(np.int32), total[at])

    got = sample.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros((BUCKETS, len(langs)))
    c[got["bucket"].to_numpy(), got["k"].to_numpy() - 1] = got["n"].to_numpy()
    c += 0.5
    return LanguageModel(langs, np.log(c / c.sum(axis=0)).astype(np.float32))


def expectation_maximisation(ll: np.ndarray, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``ll`` (items x languages, log-likelihoods) and the log-likelihood.

    Goes on until no proportion moves by ``tolerance``; the moves shrink to nothing, as the likelihood is concave.
    """
    top = ll.max(axis=1, keepdims=True)
    lik = np.exp(ll - top)
    p = np.full(ll.shape[1], 1.0 / ll.shape[1])
    moved = 1.0
    while moved > tolerance:
        r = lik * p
        r /= r.sum(axis=1, keepdims=True)
        q = r.mean(axis=0)
        moved, p = float(np.abs(q - p).max()), q
    return p, float((np.log((lik * p).sum(axis=1)) + top[:, 0]).sum())


def mixture(ll: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of all languages for one text; languages outside the selected set have 0.

    ``weight``: the number of words of each run, by which the proportions count them. Adds languages while the likelihood gains more than ``penalty``. No set gains more than giving each
    run its best language, so a text where even that gains less keeps its one language without any rounds.
    """
    total = ll.sum(axis=0)
    best = int(total.argmax())
    out = np.zeros(ll.shape[1])
    chosen, p, have = [best], np.ones(1), float(total[best])
    limit = float(ll.max(axis=1).sum())
    while len(chosen) < ll.shape[1] and limit - have > penalty:
        tried = []
        for k in range(ll.shape[1]):
            if k not in chosen:
                q, value = expectation_maximisation(ll[:, [*chosen, k]])
                tried.append((value, -k, q))
        value, k, q = max(tried, key=lambda x: x[:2])
        if value - have <= penalty:
            break
        chosen, p, have = [*chosen, -k], q, value
    if len(chosen) > 1:
        r = np.exp(ll[:, chosen] - ll[:, chosen].max(axis=1, keepdims=True)) * p
        p = weight @ (r / r.sum(axis=1, keepdims=True)) / weight.sum()
    out[chosen] = p
    return out


def infer(model: LanguageModel, texts: list[str | None]) -> list[tuple[str, float, np.ndarray | None]]:
    """(language, score, proportions) of each text.

    The score is the proportion of the predicted language times how surely the likelihood tells the
    selected languages from every other one.
    """
    words = words_of([t.lower() if t and ANY_LETTER.search(t) else "" for t in texts], code_points(LETTER))
    out: list[tuple[str, float, np.ndarray | None]] = []
    if not len(words.hash) or not model.langs:
        return [(UNDETERMINED, 0.0, None)] * len(texts)
    ll = model.rows(words).astype(np.float64)
    sizes = words.sizes.tolist()
    starts = np.concatenate([np.arange(a, a + n, RUN_WORDS) for a, n in zip(np.cumsum([0, *sizes[:-1]]), sizes)])
    runs = np.add.reduceat(ll, starts, axis=0)
    a = 0
    for n in sizes:
        if not n:
            out.append((UNDETERMINED, 0.0, None))
            continue
        m = -(-n // RUN_WORDS)
        one = runs[a:a + m]
        a += m
        total = one.sum(axis=0)
        p = mixture(one, np.diff(np.append(np.arange(0, n, RUN_WORDS), n)).astype(float), 3.0 + 0.5 * np.log(m))
        k = max(range(len(p)), key=lambda x: (round(p[x], 9), total[x], -x))
        rest = total[p == 0]
        lead = one[:, p > 0].max(axis=1).sum() - rest.max() if len(rest) else 30.0
        sure = float(1 / (1 + np.exp(-min(lead / np.sqrt(n), 30))))
        out.append((model.langs[k], float(p[k]) * sure, p))
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, proportions): proportions maps each selected language to its share."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("proportions", pa.map_(pa.string(), pa.float64()))])

    def run(batches):
        for b in blocks(batches):
            got = infer(model, b.column(1).to_pylist())
            yield as_batch(schema, b.column(0), [g[0] for g in got], [g[1] for g in got],
                           [None if g[2] is None else [(x, float(v)) for x, v in zip(model.langs, g[2]) if v > 0] for g in got])

    return columns_only(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language, or several: all but those that are ``und``."""
    at = docs.columns.index("text")

    def run(batches):
        for b in blocks(batches, "text"):
            yield b.filter(pa.array([g[0] != UNDETERMINED for g in infer(model, b.column(at).to_pylist())]))

    return docs.mapInArrow(run, docs.schema)
