"""Mixing to target weights with soft domains (operator 1).

A softmax classifier, fitted on a labelled table, gives every document a posterior over domains: from the
tokens and word beginnings that it has, of those that the labelled texts show to tell domains apart. Five
fits that each leave out a fifth of them say how sure the classifier may be (the temperature, at which the
texts left out are likeliest); the labels' own shares set the constants.

Each document then gets a nonnegative rate (its expected number of copies) so that the expected tokens of
every domain, sum of rate * tokens * posterior, match the targets. The rates solve

    minimise  |totals - targets|^2 / 2  +  ridge / 2 * sum of tokens * (rate - 1)^2,   0 <= rate [<= max_rate]

by projected gradient steps. Misses are measured in the inverse of the domains' gram matrix (tokens *
posterior * posterior), so a domain's miss counts by the domain's own size. The gradient of a rate depends
on its document only through k multipliers, one a domain, and so do the rates after a projection: they are
1 - posterior . multipliers, cut to the bounds. A step goes against the gradient in the metric of the rates
that no bound holds (their gram matrix, and some share of the whole one); one distributed sum gives the
gradients after several such steps, and the best is taken. No rate is stored, so a lost executor costs only its own part of one sum. The
steps end when no domain's gradient is above ``tolerance`` of its own tokens, which is where the bounded
problem has its minimum. If the steps can't get there that is an error, not a result.

Defined results: a null or empty text has no tokens, the posterior of the label shares and a rate like any
other, which adds nothing to the totals. Repeated rows get equal rows. With no labelled row every domain of
the targets is equally likely. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clashlens.llm.common import (_U, _pow, as_batch, blocks, checked_broadcast, code_points, columns_only, held_out, labelled_sample, mix as mixed,
                                  saved)

BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)      # letters of a longer word's beginnings that are features
TELLING = 4.0               # standard errors by which a feature's share in a domain differs from that elsewhere
LEAST_TEXTS = 4
FOLDS = 5
#: Shares of the whole gram matrix added to that of the free rates; with the last one a step always lowers the misses.
CAUTION = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)


# --- features and the classifier -----------------------------------------------------------------

@cache
def _kinds() -> np.ndarray:
    """1 letters and digits, 2 other signs, 3 underscores, 0 blanks; by code point."""
    out = code_points(r"[^\W_]").astype(np.int8)
    out[code_points(r"[^\w\s]")] = 2
    out[ord("_")] = 3
    return out


def _tokens(texts: list[str | None]):
    """(text number, bucket, whether it is a whole token) of all tokens and beginnings, and the tokens of each text."""
    lowered = [t.lower() if t else "" for t in texts]
    text = "\n".join([*lowered, ""])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(texts)) + 1) - 1
    kind = _kinds()[code]
    kind[ends] = 0
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    last = np.concatenate([new[1:], [True]])
    first, end = np.flatnonzero(new & (kind > 0)), np.flatnonzero(last & (kind > 0)) + 1
    doc = np.searchsorted(ends, first)
    power, inverse_power = _pow(len(code))
    run = np.concatenate([[_U(0)], np.cumsum(mixed(code.astype(_U), 43) * power)])
    hashed = lambda a, z, salt: (mixed((run[z] - run[a]) * inverse_power[a], salt) % _U(BUCKETS)).astype(np.int64)
    of, bucket = [doc], [hashed(first, end, 1)]
    for n in BEGINNINGS:
        longer = (end - first > n) & (kind[first] == 1)
        of.append(doc[longer])
        bucket.append(hashed(first[longer], first[longer] + n, 100 + n))
    whole = np.repeat([True, *[False] * len(BEGINNINGS)], [len(x) for x in of])
    return np.concatenate(of), np.concatenate(bucket), whole, np.bincount(doc, minlength=len(texts))


def token_bucket(token: str) -> int:
    """The bucket of a whole token."""
    return int(_tokens([token])[1][0])


def _repetition(of: np.ndarray, bucket: np.ndarray, whole: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often a text's tokens stand in it on average, as a logarithm."""
    distinct = np.bincount(np.unique(of[whole] * BUCKETS + bucket[whole]) // BUCKETS, minlength=len(n))
    return np.log1p(n / np.maximum(1, distinct))


@dataclass
class DomainModel:
    domains: list[str]
    features: np.ndarray        # ascending buckets that have weights
    weights: np.ndarray         # (features + 2, domains); the last two: repetition, constant

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and posteriors."""
        of, bucket, whole, n = _tokens(texts)
        z = _repetition(of, bucket, whole, n)[:, None] * self.weights[-2] + self.weights[-1]
        z[n == 0] = self.weights[-1]
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, bucket), len(self.features) - 1)
            here = self.features[at] == bucket
            each = np.unique(of[here] * len(self.features) + at[here])
            doc = each // len(self.features)
            for k in range(z.shape[1]):
                z[:, k] += np.bincount(doc, weights=self.weights[each % len(self.features), k], minlength=len(texts))
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return n, p / p.sum(axis=1, keepdims=True)


def _telling(rows: list, k: int) -> np.ndarray:
    """The buckets whose share of a domain's texts differs from that of the other texts, ascending."""
    count, total = np.zeros((BUCKETS, k)), np.zeros(k)
    for y, at, _ in rows:
        count[at, y] += 1
        total[y] += 1
    n, all_ = total.sum(), count.sum(axis=1)
    some = np.flatnonzero(all_ >= LEAST_TEXTS)
    share = all_[some] / n
    best = np.zeros(len(some))
    for d in range(k):
        if 0 < total[d] < n:
            inside, outside = count[some, d] / total[d], (all_[some] - count[some, d]) / (n - total[d])
            error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / total[d] + 1 / (n - total[d])))
            best = np.maximum(best, np.abs(inside - outside) / error)
    return some[best >= TELLING]


def _fitted(rows: list, features: np.ndarray, k: int, epochs: int, decay: float = 1e-3) -> np.ndarray:
    """Weights by gradient descent with a rate of its own for each weight, in a fixed order of the rows."""
    w = np.zeros((len(features) + 2, k))
    square, rng = np.full_like(w, 1e-2), np.random.default_rng(1)
    places = [(y, np.append(np.searchsorted(features, at[np.isin(at, features)]), [len(features), len(features) + 1]), rep) for y, at, rep in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(places)):
            y, at, rep = places[i]
            x = np.ones(len(at))
            x[-2] = rep
            z = x @ w[at]
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p + decay * w[at]
            square[at] += g * g
            w[at] -= 0.2 * g / np.sqrt(square[at])
    return w


def _logits(rows: list, features: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), w.shape[1]))
    for i, (_, at, rep) in enumerate(rows):
        out[i] = w[np.searchsorted(features, at[np.isin(at, features)])].sum(axis=0) + rep * w[-2] + w[-1]
    return out


def _temperature(rows: list, folds: list[int], k: int, epochs: int) -> float:
    """The number to divide weights by at which texts are likeliest that were no part of the fit."""
    z, y = [], []
    for fold in range(FOLDS):
        fit, out = ([r for r, f in zip(rows, folds) if (f == fold) == left_out] for left_out in (False, True))
        if fit and out:
            features = _telling(fit, k)
            z.append(_logits(out, features, _fitted(fit, features, k, epochs)))
            y += [r[0] for r in out]
    if not z:
        return 1.0
    z = np.concatenate(z)

    def loss(t):
        s = z / t
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(y)), y]).mean())

    return min((0.5 * 1.1 ** i for i in range(25)), key=loss)


def train(docs: DataFrame, labels: DataFrame, domain: str = "domain", rows_per_domain: int = 1500, epochs: int = 8) -> DomainModel:
    """Softmax regression on about ``rows_per_domain`` whole texts at most of every domain (``labels``: doc_id, domain).

    Labels of ids that are held out aren't read. The fifths that calibrate are dealt by a hash of the id.
    """
    sample = checked_broadcast(saved(labelled_sample(labels, domain, rows_per_domain, "domain"), "sample"))
    texts = columns_only(docs, doc_id="long", text="string").join(sample, "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("at", pa.list_(pa.int32())), ("rep", pa.float64())])

    def run(batches):
        for b in blocks(batches):
            of, bucket, whole, n = _tokens(b.column(1).to_pylist())
            key = np.unique(of * BUCKETS + bucket)
            cuts = np.searchsorted(key, np.arange(b.num_rows + 1) * BUCKETS)
            at = (key % BUCKETS).astype(np.int32)
            yield as_batch(schema, b.column(0), b.column(2), [at[x:y] for x, y in zip(cuts[:-1], cuts[1:])], _repetition(of, bucket, whole, n))

    got = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label string, at array<int>, rep double").toArrow()
    names = sorted(set(got["label"].to_pylist()))
    k = len(names)
    rows = sorted(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), (np.array(a, np.int64) for a in got["at"].to_pylist()), got["rep"].to_pylist()),
                  key=lambda r: (r[0], r[1], len(r[2]), int(r[2].sum())))
    if not rows:
        return DomainModel([], np.zeros(0, np.int64), np.zeros((2, 0)))
    folds = [crc32(f"calibrate{i}".encode()) % FOLDS for i, *_ in rows]
    rows = [(names.index(y), at, rep) for _, y, at, rep in rows]
    features = _telling(rows, k)
    w = _fitted(rows, features, k, epochs) / _temperature(rows, folds, k, epochs)
    # the sample has other shares than the labels
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    here = np.bincount([r[0] for r in rows], minlength=k)
    w[-1] += np.log([count[x] for x in names]) - np.log(np.maximum(here, 1))
    return DomainModel(names, features, w)


# --- the rates -----------------------------------------------------------------------------------

@dataclass
class Mixture:
    documents: DataFrame        # doc_id, n_tokens, posterior map, rate
    targets: dict[str, float]
    totals: dict[str, float]    # expected tokens by domain at these rates
    steps: int


def rates_at(p: np.ndarray, multipliers: np.ndarray, most: float) -> np.ndarray:
    return np.clip(1 - p @ multipliers, 0, most)


def sums_at(p: np.ndarray, n: np.ndarray, multipliers: np.ndarray, most: float) -> np.ndarray:
    """Totals by domain, the gram matrix of the rates between their bounds, and the documents' part of the dual function."""
    x = rates_at(p, multipliers, most)
    free = n * ((x > 0) & (x < most))
    s = p @ multipliers
    return np.concatenate([(n * x) @ p, ((p.T * free) @ p).ravel(), [float(n @ ((x * x - 1) / 2 - x * (s - 1 + x)))]])


def inverse(gram: np.ndarray) -> np.ndarray:
    """The gram matrix inverted, each domain in its own scale; without the directions that posteriors don't tell apart."""
    d = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    return np.linalg.pinv(gram / np.outer(d, d), rcond=1e-9, hermitian=True) / np.outer(d, d)


def descended(sums, gram: np.ndarray, goal: np.ndarray, n_all: float, own: np.ndarray, ridge: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(multipliers, totals, steps) at the minimum. ``sums`` gives ``sums_at`` of all documents for several multipliers at once."""
    k = len(goal)

    def value(at, got):
        return ridge / 2 * at @ gram @ at + got[-1] / n_all + goal @ at / n_all

    told = gram @ inverse(gram)     # without the directions that posteriors don't tell apart, in which nothing can be done
    at, steps = np.zeros(k), 0
    got = sums([at])[0]
    while True:
        gradient = ridge * gram @ at - (got[:k] - goal) / n_all
        missing = np.where(own > 0, np.abs(told @ gradient) * n_all, 0.0)
        if (missing <= tolerance * own).all():
            return at, got[:k], steps
        free = got[k:-1].reshape(k, k) / n_all
        tried = [at - inverse((ridge + c) * gram + free) @ gradient for c in CAUTION]
        results = sums(tried)
        best = min(range(len(tried)), key=lambda i: value(tried[i], results[i]))
        if not value(tried[best], results[best]) < value(at, got):
            if (missing <= 100 * tolerance * own).all():
                return at, got[:k], steps       # as near as the numbers' precision allows
            raise RuntimeError(f"no step lowers the misses any more, which are still {missing.tolist()} tokens off their minimum")
        at, got, steps = tried[best], results[best], steps + 1


def mix(docs: DataFrame, model: DomainModel, weights: dict[str, float], total: float | None = None, of_own: bool = False,
        max_rate: float | None = None, ridge: float = 1e-4, tolerance: float = 1e-4) -> Mixture:
    """Rates whose expected domain totals match ``total`` (default: all tokens) shared out by ``weights``.

    With ``of_own`` a domain's target is its weight times the tokens it has at a rate of 1 everywhere. ``totals``
    beside ``targets`` tell what is met; where bounds keep a target out of reach, the rates are those that miss least.
    """
    names = model.domains or sorted(weights)
    k = len(names)
    if not model.domains:
        model = DomainModel(names, np.zeros(0, np.int64), np.zeros((2, k)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((f"p{i}", pa.float64()) for i in range(k))])

    def predict(batches):
        for b in blocks(batches):
            n, p = model.posteriors(b.column(1).to_pylist())
            yield as_batch(schema, b.column(0), n, *p.T)

    cols = ", ".join(f"p{i} double" for i in range(k))
    slim = saved(columns_only(docs, doc_id="long", text="string").mapInArrow(predict, f"doc_id long, n_tokens long, {cols}"), "posteriors")
    mass = slim.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col(f"p{i}")).alias(f"o{i}") for i in range(k)),
                    *(F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).collect()[0]
    n_all = float(mass["n"] or 0) or 1.0
    own = np.array([mass[f"o{i}"] or 0.0 for i in range(k)])
    gram = np.array([[mass[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) / n_all
    share = np.array([weights.get(x, 0.0) for x in names])
    goal = share * own if of_own else share * (n_all if total is None else total) / (share.sum() or 1.0)
    most = np.inf if max_rate is None else max_rate
    size = k + k * k + 1

    def sums(tried: list[np.ndarray]) -> np.ndarray:
        fields = [(f"t{i}", pa.float64()) for i in range(size * len(tried))]

        def run(batches):
            out = np.zeros((len(tried), size))
            for b in batches:
                p, n = np.column_stack([b.column(1 + i).to_numpy() for i in range(k)]), b.column(0).to_numpy()
                out += [sums_at(p, n, at, most) for at in tried]
            yield as_batch(pa.schema(fields), *([v] for v in out.ravel()))

        got = (slim.select("n_tokens", *(f"p{i}" for i in range(k))).mapInArrow(run, ", ".join(f"{f} double" for f, _ in fields))
               .agg(*(F.sum(f).alias(f) for f, _ in fields)).collect()[0])
        return np.array([v or 0.0 for v in got]).reshape(len(tried), size)

    at, totals, steps = descended(sums, gram, goal, n_all, own, ridge, tolerance)
    done = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("posterior", pa.map_(pa.string(), pa.float64())), ("rate", pa.float64())])

    def rates(batches):
        for b in batches:
            p = np.column_stack([b.column(2 + i).to_numpy() for i in range(k)])
            yield as_batch(done, b.column(0), b.column(1), [list(zip(names, row)) for row in p.tolist()], rates_at(p, at, most))

    out = slim.mapInArrow(rates, "doc_id long, n_tokens long, posterior map<string,double>, rate double")
    return Mixture(out, dict(zip(names, goal.tolist())), dict(zip(names, totals.tolist())), steps)


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxicity marks: toxic, else poor, else good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
                         .when(F.col("quality") == 1, "good").alias("domain"))


def drawn(docs: DataFrame, mixture: Mixture, salt: str = "mixing") -> DataFrame:
    """Rows of ``docs``, all columns, by their rates of 0 to 1: kept where a hash of the id lies below the rate.

    Rows that repeat an id are all kept if one of them is; rows with a null id are kept.
    """
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id"), 11) / F.lit(float(1 << 53))
    kept = saved(mixture.documents.where((unit < F.col("rate")) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    return (docs.join(checked_broadcast(kept), docs["doc_id"].cast("long") == kept["kept_id"], "left_semi")
            .unionByName(docs.where(F.col("doc_id").isNull())))
