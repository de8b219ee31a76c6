"""Queries that lay the response functions over a grid of abilities, each with SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.functions import families as fam
from latentia.functions import irf
from latentia.sources import responses as src


def grid(spark: SparkSession) -> DataFrame:
    """theta from -3 to 3 by 0.5, for each item of the bank."""
    t = spark.range(13).select((F.col("id") * 0.5 - 3).alias("theta"))
    return t.join(F.broadcast(src.bank(spark)))


def stacked(df: DataFrame, curves: dict[str, Column]) -> DataFrame:
    """A row for each model and category; a curve is a probability or an array of them."""
    rows = [F.struct(F.lit(name).alias("model"), (c if name.startswith("cat_") else F.array(c)).alias("ps")) for name, c in curves.items()]
    long = df.select("item_id", "theta", F.explode(F.array(*rows)).alias("x")).select("item_id", "theta", "x.model", F.posexplode("x.ps").alias("category", "p"))
    return long.withColumns({"theta": F.round("theta", 3), "p": F.round("p", 8) + 0.0})


def dichotomous_curves(spark, d):
    t, a, b, c = (F.col(x) for x in ("theta", "a", "b", "c"))
    hi, asym = F.lit(0.95), F.lit(1.3)
    return stacked(grid(spark), {"1pl": irf.p_1pl(t, b), "2pl": irf.p_2pl(t, a, b), "3pl": irf.p_3pl(t, a, b, c), "4pl": irf.p_4pl(t, a, b, c, hi), "5pl": irf.p_5pl(t, a, b, c, hi, asym), "cll": irf.p_cll(t, a, b), "nll": irf.p_nll(t, a, b), "unipolar": fam.p_unipolar(t, a, b)})


def category_curves(spark, d):
    t, a, b, c = (F.col(x) for x in ("theta", "a", "b", "c"))
    taus = F.array(F.lit(-0.6), F.lit(0.1), F.lit(0.7))
    steps = F.transform(taus, lambda x: b + x)
    slopes, cuts = F.array(F.lit(0.0), a, 1.5 * a), F.array(F.lit(0.2), b, -b)
    return stacked(grid(spark), {"cat_graded": irf.p_graded(t, a, steps), "cat_partial": irf.p_partial_credit(t, a, steps), "cat_rating": fam.p_rating(t, b, taus), "cat_graded_rating": fam.p_graded_rating(t, a, b, taus), "cat_nominal": irf.p_nominal(t, slopes, cuts), "cat_nested": fam.p_nested_logit(t, a, b, c, F.lit(0.95), slopes, cuts), "cat_sequential": fam.p_sequential(t, a, steps), "cat_adjacent": fam.p_adjacent(t, a, steps)})


def trait_curves(spark, d):
    t, a, b = (F.col(x) for x in ("theta", "a", "b"))
    thetas, slopes, bs = F.array(t, 0.5 * t - 0.2), F.array(a, a - 0.3), F.array(b, b + 0.4)
    return stacked(grid(spark), {"compensatory": fam.p_compensatory(thetas, slopes, b), "bifactor": fam.p_bifactor(t, 0.5 * t, a, a - 0.3, b), "noncompensatory": fam.p_noncompensatory(thetas, slopes, bs), "partially": fam.p_partially_compensatory(thetas, slopes, bs, F.array(F.lit(0.7), F.lit(1.2))), "disjunctive": fam.p_disjunctive(thetas, slopes, bs)})


def unfolding_curves(spark, d):
    t, a, b = (F.col(x) for x in ("theta", "a", "b"))
    return stacked(grid(spark), {"cat_unfolding": fam.p_generalised_unfolding(t, a, b, F.array(F.lit(-1.2), F.lit(-0.7), F.lit(-0.3))), "ideal": irf.p_ideal_point(t, a, b, F.lit(0.9)), "hyperbolic": fam.p_hyperbolic(F.exp(a * (t - b)))})


def structured_curves(spark, d):
    t, a, b, c = (F.col(x) for x in ("theta", "a", "b", "c"))
    severities, taus = F.array(F.lit(0.3), F.lit(-0.1)), F.array(F.lit(-0.5), F.lit(0.5))
    path = F.array(F.struct(F.lit(1).alias("trait"), a.alias("a"), b.alias("b"), F.lit(True).alias("passed")), F.struct(F.lit(2).alias("trait"), (a + 0.1).alias("a"), (b - 0.5).alias("b"), F.lit(False).alias("passed")))
    features = F.array(F.col("item_id") % 2, F.col("item_id") % 3)
    return stacked(grid(spark), {"zero_inflated": fam.p_zero_inflated(irf.p_3pl(t, a, b, c), F.lit(0.2)), "hurdle": fam.p_hurdle(t, a, b, F.lit(0.5), F.lit(0.8)), "testlet": fam.p_testlet(t, a, b, F.lit(0.9), F.lit(0.5)), "tree": fam.p_tree(F.array(t, -t), path), "facets": fam.p_facets(t, b, severities), "cat_facets": fam.p_facets_categories(t, b, severities, taus), "features": irf.p_1pl(t, fam.difficulty_of_features(features, F.array(F.lit(0.4), F.lit(-0.3)))), "log_time": fam.log_time_density(F.lit(1.2), t, b, a), "expected_time": fam.expected_time(t, b, a)})


KNOTS = [-2.0, -0.5, 1.0, 2.5]


def free_curves(spark, d):
    t, b = F.col("theta"), F.col("b")
    points, values = F.array(*[F.lit(x) for x in KNOTS]), [0.1 + 0.0 * b, 0.3 + 0.02 * b, F.lit(0.6), F.lit(0.9)]
    return stacked(grid(spark), {"kernel": fam.p_kernel(t, points, F.array(*values), 0.7), "bernstein": fam.p_bernstein(t, values, -3.0, 3.0), "spline": fam.p_linear_spline(t, KNOTS, values)})


QUERIES = {f"irt_{f.__name__}": f for f in (dichotomous_curves, category_curves, trait_curves, unfolding_curves, structured_curves, free_curves)}

GRID = "bank as (select cast(i as int) as item_id, 0.6::double + 0.2::double*i as a, -1.5::double + 0.5::double*i as b, 0.1::double as c from range(1, 8) t(i)), grid as (select bank.*, 0.5::double*j - 3 as theta from bank, range(13) t(j))"


def s(z: str) -> str:
    return f"(1/(1+exp(-({z}))))"


def long(parts: dict[str, list[str]], source: str = "grid") -> str:
    rows = [f"select item_id, round(theta,3) as theta, '{m}' as model, cast({k} as int) as category, round({p},8)+0.0 as p from {source}" for m, ps in parts.items() for k, p in enumerate(ps)]
    return " union all ".join(rows)


def shares(logits: list[str]) -> list[str]:
    whole = "+".join(f"exp({x})" for x in logits)
    return [f"exp({x})/({whole})" for x in logits]


_Z = "a*(theta-b)"
_T = ["-0.6", "0.1", "0.7"]
_above = ["1.0::double", *[s(f"a*(theta-b-({x}))") for x in _T], "0.0::double"]
_cum = [" + ".join(["0.0::double", *[f"a*(theta-b-({x}))" for x in _T[:k]]]) for k in range(4)]
_rate = [" + ".join(["0.0::double", *[f"(theta-b-({x}))" for x in _T[:k]]]) for k in range(4)]
_pass = [s(f"a*(theta-b-({x}))") for x in _T]
_seq = ["*".join([*_pass[:k], *([f"(1-{_pass[k]})"] if k < 3 else [])]) for k in range(4)]
_nominal = ["0.2::double", "a*theta+b", "1.5*a*theta-b"]
_key = f"(0.1::double+0.85::double*{s(_Z)})"
_f1, _f2 = s(_Z), s("(a-0.3::double)*(0.5*theta-0.2::double-b-0.4::double)")
_tau = ["0.0::double", "-1.2::double", "-1.9::double", "-2.2::double"]
_both = [f"(exp(a*({k}*(theta-b)-({t})))+exp(a*({7 - k}*(theta-b)-({t}))))" for k, t in enumerate(_tau)]
_x, _w = np.polynomial.hermite.hermgauss(11)
_testlet = "+".join(f"{float(w / math.sqrt(math.pi))!r}::double*{s(f'a*theta-b+0.9::double*sqrt(0.5::double)*({float(x * math.sqrt(2))!r}::double)')}" for x, w in zip(_x, _w, strict=True))
_values = ["(0.1::double+0.0*b)", "(0.3::double+0.02::double*b)", "0.6::double", "0.9::double"]
_kern = [f"exp(-0.5*(theta-({x}))^2/(0.7::double*0.7::double))" for x in KNOTS]
_bern = "+".join(f"{v}*{math.comb(3, k)}*pow((theta+3)/6,{k})*pow(1-(theta+3)/6,{3 - k})" for k, v in enumerate(_values))
_spline = f"case when theta<=-2 then {_values[0]} " + " ".join(f"when theta<={KNOTS[k]} then {_values[k - 1]}+(theta-({KNOTS[k - 1]}))/1.5*({_values[k]}-{_values[k - 1]})" for k in (1, 2, 3)) + f" else {_values[3]} end"

ORACLES = {
    "irt_dichotomous_curves": f"with {GRID} " + long({"1pl": [s("theta-b")], "2pl": [s(_Z)], "3pl": [f"c+(1-c)*{s(_Z)}"], "4pl": [f"c+(0.95::double-c)*{s(_Z)}"], "5pl": [f"c+(0.95::double-c)*pow({s(_Z)},1.3::double)"], "cll": [f"1-exp(-exp({_Z}))"], "nll": [f"exp(-exp(-({_Z})))"], "unipolar": [f"{s(_Z)}*(1-{s(_Z)})"]}),
    "irt_category_curves": f"with {GRID} " + long({"cat_graded": [f"{_above[k]}-{_above[k + 1]}" for k in range(4)], "cat_partial": shares(_cum), "cat_rating": shares(_rate), "cat_graded_rating": [f"{_above[k]}-{_above[k + 1]}" for k in range(4)], "cat_nominal": shares(_nominal), "cat_nested": [_key, *[f"(1-{_key})*{x}" for x in shares(_nominal)]], "cat_sequential": _seq, "cat_adjacent": shares(_cum)}),
    "irt_trait_curves": f"with {GRID} " + long({"compensatory": [s("theta*a+(0.5*theta-0.2::double)*(a-0.3::double)+b")], "bifactor": [s("a*theta+(a-0.3::double)*0.5*theta+b")], "noncompensatory": [f"{_f1}*{_f2}"], "partially": [f"pow({_f1},0.7::double)*pow({_f2},1.2::double)"], "disjunctive": [f"1-(1-{_f1})*(1-{_f2})"]}),
    "irt_unfolding_curves": f"with {GRID} " + long({"cat_unfolding": [f"{x}/({'+'.join(_both)})" for x in _both], "ideal": ["0.9::double*exp(-a*(theta-b)^2)"], "hyperbolic": [f"2*exp({_Z})/((1+exp({_Z}))^2)"]}),
    "irt_structured_curves": f"with {GRID} " + long({"zero_inflated": [f"0.8::double*(c+(1-c)*{s(_Z)})"], "hurdle": [f"{s('0.5::double+0.8::double*theta')}*{s(_Z)}"], "testlet": [_testlet], "tree": [f"{s(_Z)}*(1-{s('(a+0.1::double)*(-theta-b+0.5)')})"], "facets": [s("theta-b-0.2::double")], "cat_facets": shares(["0.0::double", "(theta-b-0.2::double)+0.5", "2*(theta-b-0.2::double)"]), "features": [s("theta-0.4::double*(item_id%2)+0.3::double*(item_id%3)")], "log_time": ["ln(a)-0.5*ln(2*pi())-0.5*(a*(1.2::double-b+theta))^2"], "expected_time": ["exp(b-theta+1/(2*a*a))"]}),
    "irt_free_curves": f"with {GRID} " + long({"kernel": ["(" + "+".join(f"{k}*{v}" for k, v in zip(_kern, _values, strict=True)) + ")/(" + "+".join(_kern) + ")"], "bernstein": [_bern], "spline": [_spline]}),
}
