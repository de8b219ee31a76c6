"""Item response functions as columns of theta and item parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def p_1pl(theta: Column, b: Column) -> Column:
    return sigmoid(theta - b)


def p_2pl(theta: Column, a: Column, b: Column) -> Column:
    return sigmoid(a * (theta - b))


def p_3pl(theta: Column, a: Column, b: Column, c: Column) -> Column:
    return c + (1 - c) * p_2pl(theta, a, b)


def p_4pl(theta: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return c + (d - c) * p_2pl(theta, a, b)


def p_5pl(theta: Column, a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    return c + (d - c) * F.pow(p_2pl(theta, a, b), e)


def p_cll(theta: Column, a: Column, b: Column) -> Column:
    return 1 - F.exp(-F.exp(a * (theta - b)))


def p_nll(theta: Column, a: Column, b: Column) -> Column:
    return F.exp(-F.exp(-(a * (theta - b))))


def p_ideal_point(theta: Column, a: Column, delta: Column, h: Column) -> Column:
    return h * F.exp(-a * (theta - delta) * (theta - delta))


def p_graded(theta: Column, a: Column, thresholds: Column) -> Column:
    """Category probabilities: differences of cumulative curves at the thresholds (an array)."""
    above = F.concat(F.array(F.lit(1.0)), F.transform(thresholds, lambda b: p_2pl(theta, a, b)), F.array(F.lit(0.0)))
    return F.transform(F.sequence(F.lit(1), F.size(above) - 1), lambda k: F.element_at(above, k) - F.element_at(above, k + 1))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def p_partial_credit(theta: Column, a: Column, steps: Column) -> Column:
    """Generalised partial credit: softmax of cumulated a (theta - step), the first logit 0."""
    sums = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.aggregate(F.slice(steps, 1, k), F.lit(0.0), lambda s, d: s + a * (theta - d)))
    return softmax(sums)


def p_nominal(theta: Column, slopes: Column, intercepts: Column) -> Column:
    return softmax(F.zip_with(slopes, intercepts, lambda a, c: a * theta + c))


def information_2pl(theta: Column, a: Column, b: Column) -> Column:
    p = p_2pl(theta, a, b)
    return a * a * p * (1 - p)


def clip(p: Column, eps: float = 1e-10) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
