"""Quality classifier on supervised subword embeddings (operator 8).

Every word has a vector, the sum of learned vectors of hash buckets: the word itself and its character
n-grams. A text's vector is the average over all buckets of all its words; a softmax layer gives its
classes. Vectors and layer are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows. As the layer is linear, a word adds a fixed amount to a text's margin, so scoring a text
adds one number for each of its words.

Defined results: a text without words, or null, has the score of the training rows' share of label 1.
Repeated rows get equal rows; an empty table gives an empty table; with no labelled row every score is
0.5. An id with several labels has the largest. Other columns, whatever their names, aren't read. Texts
are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clashlens.llm import common
from clashlens.llm.common import PieceTable, as_batch, blocks, checked_broadcast, code_points, columns_only, labelled_sample, saved

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4)
AGAIN = "\x02"              # a word that repeats the one before it counts as this word as well


def words_of(text: str) -> list[str]:
    return text.lower().split()


def buckets_of(word: str) -> list[int]:
    b = f"<{word}>"
    return [crc32(word.encode()) % BUCKETS, *(crc32(b[i:i + n].encode(), n) % BUCKETS for n in GRAMS for i in range(len(b) - n + 1))]


def repeats(words: list[str]) -> int:
    return sum(map(str.__eq__, words[1:], words))


@dataclass
class QualityModel:
    margin: np.ndarray          # of each bucket, towards label 1
    bias: float
    prior: float

    def __post_init__(self):
        self._known, self._used = PieceTable(19), 0
        self._sum, self._count = np.zeros(1024), np.zeros(1024)

    def __getstate__(self):
        return {"margin": np.asarray(self.margin, np.float32), "bias": self.bias, "prior": self.prior}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _forget(self) -> None:
        self._used = 0

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of new words' sums of margins and bucket counts."""
        each = [buckets_of(w) for w in words]
        count = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((k for b in each for k in b), np.int64, int(count.sum()))
        while self._used + len(words) > len(self._sum):
            self._sum, self._count = (np.concatenate([x, np.zeros_like(x)]) for x in (self._sum, self._count))
        new = np.arange(self._used, self._used + len(words))
        self._sum[new] = np.add.reduceat(np.asarray(self.margin, float)[flat], np.cumsum(count) - count)
        self._count[new] = count
        self._used += len(words)
        return new

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = common.words_of([t.lower() if t else "" for t in texts], code_points(r"\S"))
        out = np.full(len(texts), self.prior)
        if not len(words.hash):
            return out
        at = words.numbers(self._known, self._learn, self._forget)
        of = np.repeat(np.arange(len(texts)), words.sizes)
        again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])) + 1
        k = buckets_of(AGAIN)
        repeated = np.bincount(of[again], minlength=len(texts))
        total = np.bincount(of, self._sum[at], len(texts)) + repeated * float(np.asarray(self.margin, float)[k].sum())
        n = np.bincount(of, self._count[at], len(texts)) + repeated * len(k)
        some = n > 0
        out[some] = 1 / (1 + np.exp(-np.clip(total[some] / n[some] + self.bias, -30, 30)))
        return out


def features(docs: DataFrame) -> DataFrame:
    """(label, buckets, counts) of rows (text, label)."""
    schema = pa.schema([("label", pa.string()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        for b in blocks(batches):
            rows = []
            for t in b.column(0).to_pylist():
                words = words_of(t)
                c: Counter = Counter()
                for w, n in [*Counter(words).items(), (AGAIN, repeats(words))]:
                    for k in buckets_of(w) if n else ():
                        c[k] += n
                rows.append(c)
            yield as_batch(schema, b.column(1), [list(c) for c in rows], [list(c.values()) for c in rows])

    return docs.select("text", "label").mapInArrow(run, "label string, buckets array<int>, counts array<int>")


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32, rate: float = 8.0, seed: int = 1) -> QualityModel:
    """Stochastic gradient descent on (label 0 or 1, buckets, counts)."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            part = [rows[i] for i in order[a:a + batch]]
            at = np.concatenate([r[1] for r in part])
            n = [len(r[1]) for r in part]
            weight = np.concatenate([r[2] / r[2].sum() for r in part]).astype(np.float32)[:, None]
            starts = np.cumsum([0, *n[:-1]])
            h = np.add.reduceat(vec[at] * weight, starts, axis=0)
            z = h @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [r[0] for r in part]] -= 1
            lr = rate * (1 - step / steps) / len(part)
            back = p @ layer.T
            layer -= lr * (h.T @ p)
            bias -= lr * 0.1 * p.sum(axis=0)
            # a bucket's share of a text is small, so its vector moves by the root of the share
            np.subtract.at(vec, at, lr * np.sqrt(weight) * np.repeat(back, n, axis=0))
            step += 1
    prior = float(np.mean([r[0] for r in rows]))
    return QualityModel(vec @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), prior)


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = 1500) -> QualityModel:
    """Fits on about ``rows_per_label`` whole texts at most of either label, none of them held out."""
    sample = checked_broadcast(saved(labelled_sample(labels.where("quality in (0, 1)"), "quality", rows_per_label, "quality"), "sample"))
    texts = columns_only(docs, doc_id="long", text="string").where("text is not null").join(sample, "doc_id")
    got = features(texts).toArrow()
    rows = sorted(((int(y), np.array(b, np.int64), np.array(c, np.float32)) for y, b, c in zip(
        got["label"].to_pylist(), got["buckets"].to_pylist(), got["counts"].to_pylist()) if b), key=lambda r: (r[0], len(r[1]), r[1].sum()))
    if not rows:
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0, 0.5)
    return descend(rows)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in blocks(batches):
            s = model.scores(b.column(1).to_pylist())
            yield as_batch(schema, b.column(0), s, (s >= threshold).astype(np.int32))

    return columns_only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, predicted int")
