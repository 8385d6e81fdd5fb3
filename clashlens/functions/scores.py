"""Scalar score expressions (N-3..N-9, L-1, L-2, E-6, T-7). Pure Column arithmetic, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clashlens.config import (CONTRADICTION_THRESHOLD, EXPECTED_SCORE_WEIGHTS, LABEL_ORDER,
                              STS_CONSISTENT_MIN, STS_CONTRADICTION_MAX)


def rounded(x: Column, digits: int) -> Column:
    """x rounded to ``digits`` decimals as Python's ``round``: by its exact binary value, ties to even.

    The product p = x * 10^d is itself rounded, by far less than 1e-6; that can only matter where p lies about on a
    half. There its error, from cutting x into two halves whose products with 10^d are exact, decides.
    """
    s = F.lit(float(10 ** digits))
    a = F.abs(x)
    p = a * s
    whole = F.floor(p).cast("double")
    rest = p - whole
    t = a * F.lit(134217729.0)          # 2^27 + 1
    high = t - (t - a)
    error = (high * s - p) + (a - high) * s
    tie_up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    out = F.when(F.abs(rest - 0.5) > 1e-6, F.floor(p + 0.5).cast("double")).otherwise(whole + F.when(tie_up, 1.0).otherwise(0.0)) / s
    return F.when(x < 0, F.lit(0.0) - out).otherwise(out)


def softmax3(z0: Column, z1: Column, z2: Column):
    """Three probabilities from three logits; the maximum is subtracted first, so 1000 stays finite."""
    m = F.greatest(z0, z1, z2)
    e0, e1, e2 = F.exp(z0 - m), F.exp(z1 - m), F.exp(z2 - m)
    s = e0 + e1 + e2
    return e0 / s, e1 / s, e2 / s


def argmax_label(e: Column, n: Column, c: Column) -> Column:
    """Label of the largest probability; ties go to the first label in LABEL_ORDER."""
    m = F.greatest(e, n, c)
    return (F.when(e == m, F.lit(LABEL_ORDER[0])).when(n == m, F.lit(LABEL_ORDER[1]))
            .otherwise(F.lit(LABEL_ORDER[2])))


def is_contradiction(c: Column, threshold: float = CONTRADICTION_THRESHOLD) -> Column:
    return F.coalesce(c, F.lit(0.0)) >= F.lit(threshold)


def verdict(c: Column, threshold: float = CONTRADICTION_THRESHOLD) -> Column:
    return F.when(is_contradiction(c, threshold), F.lit("CONTRADICTION")).otherwise(F.lit("CONSISTENT"))


def verdict_confidence(e: Column, n: Column, c: Column, threshold: float = CONTRADICTION_THRESHOLD) -> Column:
    """P(contradiction) for a contradiction, else the larger of P(entailment) and P(neutral)."""
    z = F.lit(0.0)
    return F.when(is_contradiction(c, threshold), F.coalesce(c, z)).otherwise(
        F.greatest(F.coalesce(e, z), F.coalesce(n, z)))


def expected_score(e: Column, n: Column, c: Column) -> Column:
    we, wn, wc = EXPECTED_SCORE_WEIGHTS
    return e * F.lit(we) + n * F.lit(wn) + c * F.lit(wc)


def to_05_scale(score: Column, score_scale: str = "0-5") -> Column:
    if score_scale == "0-5":
        return score
    if score_scale == "0-1":
        return score * F.lit(5.0)
    raise ValueError(f"unknown score scale {score_scale!r}")


def score_label(score05: Column) -> Column:
    """Graded score on the 0-5 scale -> consistent / neutral / contradiction."""
    return (F.when(score05 >= F.lit(STS_CONSISTENT_MIN), F.lit("consistent"))
            .when(score05 <= F.lit(STS_CONTRADICTION_MAX), F.lit("contradiction"))
            .otherwise(F.lit("neutral")))
