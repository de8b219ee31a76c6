"""Response functions of further model families, as columns. Arrays hold what a family has several of: thresholds, slopes, traits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from latentia.functions.irf import p_2pl, p_4pl, sigmoid, softmax


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda s, x: s * x)


def running(values: Column) -> Column:
    """Sums up to each place, a 0 in front; values has a handful of entries."""
    return F.transform(F.sequence(F.lit(0), F.size(values)), lambda k: total(F.slice(values, 1, k)))


def p_unipolar(theta: Column, a: Column, b: Column) -> Column:
    """Rises to 0.25 where theta meets b, and falls again."""
    p = p_2pl(theta, a, b)
    return p * (1 - p)


def information(p: Column, slope: Column) -> Column:
    """Fisher information of any right-or-wrong model from its probability and that one's derivative."""
    return slope * slope / (p * (1 - p))


# categories


def p_rating(theta: Column, b: Column, taus: Column) -> Column:
    """Rating scale: all items share the steps taus."""
    return softmax(running(F.transform(taus, lambda t: theta - b - t)))


def p_graded_rating(theta: Column, a: Column, b: Column, taus: Column) -> Column:
    """Graded rating scale: cumulative curves at b + tau."""
    above = F.concat(F.array(F.lit(1.0)), F.transform(taus, lambda t: p_2pl(theta, a, b + t)), F.array(F.lit(0.0)))
    return F.transform(F.sequence(F.lit(1), F.size(above) - 1), lambda k: F.element_at(above, k) - F.element_at(above, k + 1))


def p_nested_logit(theta: Column, a: Column, b: Column, c: Column, d: Column, slopes: Column, intercepts: Column) -> Column:
    """The key's probability, then those of the distractors, which share the rest by a softmax."""
    p = p_4pl(theta, a, b, c, d)
    return F.concat(F.array(p), F.transform(softmax(F.zip_with(slopes, intercepts, lambda s, i: s * theta + i)), lambda x: (1 - p) * x))


def p_sequential(theta: Column, a: Column, steps: Column) -> Column:
    """Each step is taken once the one before has been passed; a category is where the first failure stops it."""
    passed = F.transform(steps, lambda b: p_2pl(theta, a, b))
    reach = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: product(F.slice(passed, 1, k)))
    fail = F.concat(F.transform(passed, lambda p: 1 - p), F.array(F.lit(1.0)))
    return F.zip_with(reach, fail, lambda r, f: r * f)


def p_adjacent(theta: Column, a: Column, steps: Column) -> Column:
    """Adjacent categories: the logit between neighbours is a (theta - step)."""
    return softmax(running(F.transform(steps, lambda b: a * (theta - b))))


def expected_category(ps: Column) -> Column:
    return total(F.transform(ps, lambda p, k: p * k))


# several traits


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def p_compensatory(thetas: Column, slopes: Column, d: Column) -> Column:
    return sigmoid(dot(thetas, slopes) + d)


def p_bifactor(general: Column, specific: Column, a_general: Column, a_specific: Column, d: Column) -> Column:
    return sigmoid(a_general * general + a_specific * specific + d)


def trait_curves(thetas: Column, slopes: Column, bs: Column) -> Column:
    z = F.zip_with(F.zip_with(thetas, bs, lambda t, b: t - b), slopes, lambda x, a: x * a)
    return F.transform(z, sigmoid)


def p_noncompensatory(thetas: Column, slopes: Column, bs: Column) -> Column:
    return product(trait_curves(thetas, slopes, bs))


def p_partially_compensatory(thetas: Column, slopes: Column, bs: Column, weights: Column) -> Column:
    return product(F.zip_with(trait_curves(thetas, slopes, bs), weights, lambda p, c: F.pow(p, c)))


def p_disjunctive(thetas: Column, slopes: Column, bs: Column) -> Column:
    return 1 - product(F.transform(trait_curves(thetas, slopes, bs), lambda p: 1 - p))


# mixtures of answering and not answering


def p_zero_inflated(p: Column, share: Column) -> Column:
    """Any curve p, where a share of persons never scores."""
    return (1 - share) * p


def p_hurdle(theta: Column, a: Column, b: Column, alpha: Column, beta: Column) -> Column:
    return sigmoid(alpha + beta * theta) * p_2pl(theta, a, b)


# unfolding


def p_generalised_unfolding(theta: Column, a: Column, delta: Column, taus: Column) -> Column:
    """Graded unfolding: each category is met from both sides of delta; taus has a threshold for each category but the first."""
    top = F.size(taus)
    cumulated = running(taus)
    below = F.transform(cumulated, lambda t, k: a * (k * (theta - delta) - t))
    above = F.transform(cumulated, lambda t, k: a * ((2 * top + 1 - k) * (theta - delta) - t))
    logit = F.zip_with(below, above, lambda x, y: F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))
    return softmax(logit)


def p_hyperbolic(t: Column) -> Column:
    return 2 * t / ((1 + t) * (1 + t))


# structures over items


def p_testlet(theta: Column, a: Column, b: Column, d: Column, variance: Column, nodes: int = 11) -> Column:
    """The average over a normal testlet effect, by quadrature."""
    x, w = np.polynomial.hermite.hermgauss(nodes)
    effect = [sigmoid(a * theta - b + d * F.sqrt(variance) * F.lit(float(v * math.sqrt(2)))) * F.lit(float(u / math.sqrt(math.pi))) for v, u in zip(x, w, strict=True)]
    return sum(effect[1:], effect[0])


def p_tree(thetas: Column, path: Column) -> Column:
    """The product over a path's nodes; a node is a struct of trait (from 1), a, b and whether it is passed."""
    node = lambda n: p_2pl(F.element_at(thetas, n["trait"]), n["a"], n["b"])
    return product(F.transform(path, lambda n: F.when(n["passed"], node(n)).otherwise(1 - node(n))))


def p_facets(theta: Column, b: Column, severities: Column) -> Column:
    return sigmoid(theta - b - total(severities))


def p_facets_categories(theta: Column, b: Column, severities: Column, taus: Column) -> Column:
    base = theta - b - total(severities)
    return softmax(F.transform(running(taus), lambda t, k: k * base - t))


def difficulty_of_features(features: Column, weights: Column) -> Column:
    """Linear logistic test model: an item's difficulty is the weighted sum of its features."""
    return dot(features, weights)


def log_time_density(log_time: Column, tau: Column, beta: Column, alpha: Column) -> Column:
    """Log density of a log response time: normal around beta - tau with deviation 1 / alpha."""
    z = alpha * (log_time - beta + tau)
    return F.log(alpha) - F.lit(0.5 * math.log(2 * math.pi)) - 0.5 * z * z


def expected_time(tau: Column, beta: Column, alpha: Column) -> Column:
    return F.exp(beta - tau + 1 / (2 * alpha * alpha))


# curves without a parametric form


def p_kernel(theta: Column, points: Column, values: Column, bandwidth: float) -> Column:
    """Weighted mean of values at points, with Gaussian weights."""
    w = F.transform(points, lambda x: F.exp(-0.5 * (theta - x) * (theta - x) / (bandwidth * bandwidth)))
    return dot(w, values) / total(w)


def p_bernstein(theta: Column, coefficients: list[Column], low: float, high: float) -> Column:
    """A polynomial in Bernstein form over [low, high]; rising coefficients give a rising curve."""
    t = F.least(F.greatest((theta - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    n = len(coefficients) - 1
    return sum((c * math.comb(n, k) * F.pow(t, F.lit(k)) * F.pow(1 - t, F.lit(n - k)) for k, c in enumerate(coefficients)), F.lit(0.0))


def p_linear_spline(theta: Column, knots: list[float], values: list[Column]) -> Column:
    """Straight lines between knots, level outside."""
    out = F.when(theta <= knots[0], values[0])
    for k in range(1, len(knots)):
        share = (theta - knots[k - 1]) / (knots[k] - knots[k - 1])
        out = out.when(theta <= knots[k], values[k - 1] + share * (values[k] - values[k - 1]))
    return out.otherwise(values[-1])
